"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one grouping of the edges by a vertex and one join with the groups' least neighbours. These are
written before the join: both its sides are then plain shuffles, which Spark's adaptive execution
splits where one vertex has very many neighbours, so a star's centre isn't one task. A step's edges are written to
the shared folder too, and the tables of the step before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._common import discard, mark, stored


def _to_least(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each vertex to the least of them and the vertex itself."""
    if large:  # all neighbours count; those above the vertex are linked
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # those below count and are linked, with the vertex
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = both.join(least, "u").select("u", "v", F.least("m", "u").alias("m"))
    if large:
        linked = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return linked.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component): the least id reachable, for each vertex of ``edges`` (u, v); loops ignored.

    Ids are longs. Vertices without an edge are absent. An empty edge table gives an empty result.
    """
    e, since = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges"), mark() - 1
    for _ in range(most):
        # done when all are stars: no vertex has two lesser neighbours, or both a lesser and a greater one
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        if not ends.groupBy("x").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).filter("low > 1 or (low > 0 and high > 0)").limit(1).count():
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        e = stored(_to_least(stored(_to_least(e, True), "edges"), False), "edges")
        discard(since, 1)
    raise RuntimeError(f"components did not settle in {most} steps")
