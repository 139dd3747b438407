"""Connected components of an edge table, in rounds of large-star and small-star steps.

Each round is two joins and two aggregations over the edges that are left; nothing is collected but two numbers that
tell whether the round changed anything. Edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import materialise

MOST_ROUNDS = 60


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the vertex's least neighbour or to itself."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the least of these."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of ``edges`` (u, v): root is the least vertex that can be reached.

    Null ends and loops are ignored; repeated edges count once. An empty table gives an empty table.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, "edges")
    state = _state(e)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        e = materialise(_small_star(_large_star(e)), "edges")
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    # Settled: every edge leads from a vertex to its root.
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("root"))).distinct()
