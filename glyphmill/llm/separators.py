"""Token counts of flat token files by a scan for end-of-document ids.

A flat file is nothing but ids, two or four bytes each, with ``end_id`` after each document: no index, no offsets.
Files are read in blocks of equal size, each a row that any task can take. In a block NumPy finds all separators at
once; what a block can't know, where the document began that its first separator ends and how many documents came
before it, follows from a prefix scan over the blocks of the file (maximum of the last separators, sum of counts).
A document may span any number of blocks; a block may hold no separator. Ids after the last separator are an
unfinished document and count as none. Null and empty texts have no ids; rows with the same or no id are counted each;
an empty table has no files and no counts; only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.bpe import coder
from glyphmill.llm.common import SLICE_ROWS, binary_values, file_system, materialise, work_dir
from glyphmill.sources.storage import open_output

#: Bytes of a block, blocks that a task reads one after the other.
BLOCK_BYTES, BLOCKS_A_TASK = 8 << 20, 4


def write_flat(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each partition's documents as one flat file in the shared folder; no shuffle.

    Returns rows (uri, first, doc_ids, n_bytes): the documents of a run in the file's order, from ordinal ``first``.
    Strings of special tokens in a text are encoded as ordinary text, so ``end_id`` stands only between documents.
    Null text has no ids.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    folder = work_dir(d.sparkSession, "flat")
    schema = pa.schema([("uri", pa.string()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        uri = f"{folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.bin"
        c = coder(path, special=False)
        dtype, sink, first = np.dtype("<u2"), None, 0
        if max(max(c.name), end_id) >= 1 << 16:
            dtype = np.dtype("<u4")
        end = dtype.type(end_id).tobytes()
        rows = []
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                if sink is None:
                    sink = open_output(uri)
                n = 0
                for text in binary_values(part.column(1)):
                    data = np.frombuffer(b"".join(c.encode_parts(text)), "<u4").astype(dtype).tobytes() + end
                    sink.write(data)
                    n += len(data)
                rows.append({"uri": uri, "first": first, "doc_ids": part.column(0).to_pylist(), "n_bytes": n})
                first += part.num_rows
        if sink is not None:
            sink.close()  # rows go out only once the whole file is written
            yield pa.RecordBatch.from_pylist(rows, schema)

    return materialise(d.mapInArrow(run, "uri string, first bigint, doc_ids array<bigint>, n_bytes bigint"), "flat-manifest")


def scan_counts(files: DataFrame, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uri, ordinal, n_tokens) of every finished document of flat files given as (uri, n_bytes)."""
    step = block_bytes - block_bytes % width
    blocks = files.where("n_bytes > 0").select("uri", "n_bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / step))).alias("block"))
    blocks = blocks.select("uri", "block", F.least(F.lit(step), F.col("n_bytes") - F.col("block") * step).alias("size"))
    n_blocks = files.agg(F.sum(F.ceil(F.col("n_bytes") / step))).first()[0] or 0
    blocks = blocks.repartition(max(1, int(n_blocks) // BLOCKS_A_TASK))
    dtype = np.dtype("<u2" if width == 2 else "<u4")
    schema = pa.schema([("uri", pa.string()), ("block", pa.int64()), ("n_sep", pa.int64()), ("first_sep", pa.int64()), ("last_sep", pa.int64()), ("inner", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, p = file_system(row["uri"])
                with system.open_input_file(p) as source:
                    ids = np.frombuffer(source.read_at(row["size"], row["block"] * step), dtype)
                at = np.flatnonzero(ids == end_id) + row["block"] * (step // width)
                some = len(at) > 0
                out = {"uri": row["uri"], "block": row["block"], "n_sep": len(at), "first_sep": int(at[0]) if some else None, "last_sep": int(at[-1]) if some else None, "inner": (np.diff(at) - 1).tolist()}
                yield pa.RecordBatch.from_pylist([out], schema)

    found = blocks.mapInArrow(run, "uri string, block bigint, n_sep bigint, first_sep bigint, last_sep bigint, inner array<bigint>")
    before = W.partitionBy("uri").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    stitched = found.withColumns({"docs_before": F.coalesce(F.sum("n_sep").over(before), F.lit(0)), "sep_before": F.coalesce(F.max("last_sep").over(before), F.lit(-1))})
    lengths = F.concat(F.array(F.col("first_sep") - F.col("sep_before") - 1), F.col("inner"))
    return (
        stitched.where("n_sep > 0")
        .select("uri", "docs_before", F.posexplode(lengths).alias("k", "n_tokens"))
        .select("uri", (F.col("docs_before") + F.col("k")).alias("ordinal"), "n_tokens")
    )


def token_counts(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens (without the separator) of each row: written flat, scanned, stitched, joined to its ids."""
    runs = write_flat(docs, path, end_id, id_col, text_col)
    width = 2 if max(max(coder(path, special=False).name), end_id) < 1 << 16 else 4
    files = runs.groupBy("uri").agg(F.sum("n_bytes").alias("n_bytes"))
    order = runs.select("uri", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("uri", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    # Merge, for the optimiser takes the exploded ids to be as small as their compressed file and would broadcast them.
    return scan_counts(files, end_id, width, block_bytes).hint("merge").join(order.hint("merge"), ["uri", "ordinal"]).select("doc_id", "n_tokens")
