"""Orders over whole tables without a task that holds them (sections A, F of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import write_through


def global_index(df: DataFrame, *order: str | Column, name: str = "index") -> DataFrame:
    """``df`` with its place (1, 2, ...) in the order of all rows; strings compare by their bytes.

    Rows are sorted within ranges and numbered there; the ranges' counts, one row each, say where a range begins. The
    ranges are written first, so both passes see the same ones.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    d = write_through(parts.select(F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__id"), *df.columns), "ranges")
    sizes = d.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = sizes.withColumn("__before", before).select("__range", "__first", "__before")
    return d.join(F.broadcast(starts), "__range").select(*df.columns, (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias(name))


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """``df`` with its place in a random order that hangs on ``key`` and ``seed`` only."""
    mixed = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return global_index(df.withColumn("__mix", mixed), "__mix", key).drop("__mix")


def name_store(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(read_name, id) with dense ids in the order of names, and (mp_id, id) of the reads of each path."""
    ids = global_index(reads.select("read_name").distinct(), "read_name", name="id")
    return ids, reads.select("mp_id", "read_name").distinct().join(ids, "read_name").select("mp_id", "id")
