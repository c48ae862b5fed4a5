"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """Link what ``keep`` selects of each u's neighbours to the least of u and its neighbours.

    The least is a partial aggregate, and the join that brings it back is one whose hot side Spark can split: a hub
    with a third of all vertices is neither collected nor sorted in one task.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, *, max_rounds: int = 50, edges_per_file: int = 200_000, most_edges: int | None = None) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (u, v); component is the least vertex reachable.

    Each round is written to the shared folder, so lineage stays short and only counts reach the driver. Null ends and
    loops are dropped; an empty table gives no rows. Rounds never have more edges than vertices and edges together, so the
    number of their files follows a bound of the edges: ``most_edges`` if it is known, else a count of the first ones.
    """

    def files(n: int) -> int:
        return max(1, -(-n // edges_per_file))

    first = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(first if most_edges is None else first.coalesce(files(most_edges)), "edges")
    parts = files(2 * e.count()) if most_edges is None else files(most_edges)
    for _ in range(max_rounds):
        large = _star(_neighbours(e), "v > u")
        # each vertex's smaller neighbours, and the vertex itself, go to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(small.coalesce(parts), "edges")
        # done when all are stars: no vertex is both an end and a centre, and none has two centres
        ends = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if ends.where("n > 1").isEmpty() and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
