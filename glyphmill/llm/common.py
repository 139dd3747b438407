"""Helpers shared by the training-data operators: the shared work folder, Arrow row maps and word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.sources.storage import file_system, work_dir  # noqa: F401

#: Words of every operator here: maximal runs of bytes outside space and U+0009..U+000D.
#: ``bytes.split()`` without an argument splits at exactly these six characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch while a table is written to the shared folder. Python sees two batches of a task at a time,
#: and the JVM's buffers of one take several times its size.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path, before = work_dir(spark, name), spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def binary_values(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column's values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).to_pylist()


#: What a worker keeps from task to task, by owner: how to drop it. Only the owner that ran last keeps anything, so a
#: worker that serves many operators in turn holds the memory of one.
_KEPT: dict[str, Callable[[], None]] = {}
_OWNER = ""


def claim(owner: str, drop: Callable[[], None] | None = None) -> None:
    global _OWNER
    if drop is not None:
        _KEPT[owner] = drop
    if owner != _OWNER:
        _OWNER = owner
        for name, clear in _KEPT.items():
            if name != owner:
                clear()
        pa.default_memory_pool().release_unused()


#: Rows of one slice of an Arrow batch that is turned into Python objects at a time; bounds memory, not work.
SLICE_ROWS = 512


def map_rows(
    df: DataFrame,
    inputs: list[str],
    out: str,
    out_type: str,
    make: Callable[[], Callable[..., list]],
    keep: bool = True,
    owner: str = "",
) -> DataFrame:
    """Append column ``out``, computed in Python from ``inputs`` in batches.

    ``make`` runs once in each task and returns a function from lists of values (strings as UTF-8 bytes)
    to a list of results. With ``keep=False`` only ``out`` is returned. ``owner`` names what the worker may keep.
    """
    field = T.StructType.fromDDL(f"v {out_type}").fields[0].dataType
    schema = T.StructType([*(df.schema.fields if keep else []), T.StructField(out, field)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                values = []
                for c in inputs:
                    v = batch.column(batch.schema.get_field_index(c))
                    values.append(binary_values(v) if pa.types.is_string(v.type) or pa.types.is_large_string(v.type) else v.to_pylist())
                made = pa.array(f(*values), type=arrow_type)
                columns = [*batch.columns, made] if keep else [made]
                names = [*batch.schema.names, out] if keep else [out]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))


#: Rows of a hot key that stay together in ``spread_join``: a key's rows are dealt to so many tasks.
SALTS = 32


def spread_join(df: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on ``key`` with a table of one slim row a key, which is repeated ``SALTS`` times.

    Rows of one key are dealt by ``by`` to as many tasks, so a key that holds a large share of ``df`` isn't one task's.
    """
    salt = free_name(df, "salt")
    dealt = df.withColumn(salt, F.pmod(F.xxhash64(by, F.lit(29)), F.lit(SALTS)).cast("int"))
    return dealt.join(small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, salt]).drop(salt)


def let(value, body):
    """``body`` of a value that is computed once: a lambda variable stands for it.

    A plain reference would not do: the optimiser may put the value's expression in its place, inside other lambdas
    too, where it would be computed anew for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
