"""Interval operators on closed intervals (contig, strand, lend, rend).

Every overlap join goes through bins: an interval is listed in each bin that it touches and two intervals meet in the
first bin that they share, so each pair comes once and the join is an equi-join that Spark can shuffle, broadcast or
split. Sweeps along a contig are cut into ranges; a small row for each range hands on what the next ones need, so no task
sorts a contig. Row ids of section D, E, H and N of the survey are named in each docstring.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

SPOT = ("contig", "strand")


def overlap_bp(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    """Shared bases of two closed intervals, 0 if none."""
    return F.greatest(F.lit(0), F.least(r1, r2) - F.greatest(l1, l2) + 1)


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = SPOT, *, bin_size: int = 1024, how: str = "inner", min_overlap: int = 1, where: Column | None = None) -> DataFrame:
    """Pairs that overlap by ``min_overlap`` bases or more; ``how`` is inner, left_semi or left_anti.

    ``left`` has lend and rend, ``right`` has lend2 and rend2, and both have ``keys``; other columns must not clash.
    ``where`` is a further condition on an inner join's pairs, tested before they leave it. Adds ``overlap`` to an inner join. Null bounds meet nothing.
    """
    b = F.lit(bin_size)
    r = right.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("lend2") / b), F.floor(F.col("rend2") / b))))
    bins = F.explode(F.sequence(F.floor(F.col("lend") / b), F.floor(F.col("rend") / b)))
    pair = (F.col("lend") <= F.col("rend2")) & (F.col("rend") >= F.col("lend2"))
    if where is not None:
        pair &= where
    amount = overlap_bp(F.col("lend"), F.col("rend"), F.col("lend2"), F.col("rend2"))
    if how == "inner":
        first = F.col("__bin") == F.floor(F.greatest("lend", "lend2") / b)
        out = left.withColumn("__bin", bins).join(r, [*keys, "__bin"]).where(pair & first)
        return out.withColumn("overlap", amount).where(F.col("overlap") >= min_overlap).drop("__bin")
    # semi and anti joins look at each left row once, however many bins it touches
    tagged = left.withColumn("__id", F.monotonically_increasing_id())
    hits = tagged.select("__id", "lend", "rend", *keys, bins.alias("__bin")).join(r.select(*keys, "lend2", "rend2", "__bin"), [*keys, "__bin"]).where(pair & (amount >= min_overlap)).select("__id").distinct()
    return tagged.join(hits, "__id", how).drop("__id")


#: Bases of one cut of a sweep. A sweep looks at positions, each once, so a task holds so many rows of a cut at most.
CUT = 1 << 16


#: Rows of one task where a step's memory grows with its rows.
TASK_ROWS = 250_000


def task_count(df: DataFrame) -> int:
    """Tasks for the rows of ``df``, which are counted: as many as the session asks for, and more where they would be large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def cut_column(pos: str, cut: int | None) -> Column:
    return F.lit(0).cast("long") if cut is None else F.floor(F.col(pos) / F.lit(cut))


def handed_over(df: DataFrame, keys: Sequence[str], per_cut: dict[str, Column], columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """``df`` (keys, __cut) with what each cut gets from the other cuts of its keys.

    ``per_cut`` sums a cut up in one row; ``columns`` makes from these rows, over cuts in order, what is handed over.
    """
    order = Window.partitionBy(*keys).orderBy("__cut")
    small = df.groupBy(*keys, "__cut").agg(*[c.alias(n) for n, c in per_cut.items()])
    small = small.select(*[F.col(k).alias(f"__key{n}") for n, k in enumerate([*keys, "__cut"])], *[c.alias(n) for n, c in columns(order).items()])
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"__key{n}")) for n, k in enumerate([*keys, "__cut"])])
    return df.join(small, same).drop(*[f"__key{n}" for n in range(len(keys) + 1)])


def latest_start(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, cut: int | None = CUT) -> DataFrame:
    """``df`` with ``__island``: the latest ``__start`` that isn't null up to each row; ``__start`` never falls along ``order``."""
    before = Window.unboundedPreceding
    d = df.withColumn("__cut", cut_column(order[0], cut))
    own = F.max("__start").over(Window.partitionBy(*keys, "__cut").orderBy(*order).rowsBetween(before, 0))
    if cut is not None:
        d = handed_over(d, keys, {"__last": F.max("__start")}, lambda w: {"__carried": F.max("__last").over(w.rowsBetween(before, -1))})
        own = F.coalesce(own, "__carried")
    return d.withColumn("__island", own).drop("__cut", "__carried")


def island_starts(df: DataFrame, keys: Sequence[str] = SPOT, *, gap: int = 1, cut: int | None = CUT) -> DataFrame:
    """``df`` with ``__island``: where each interval's island begins; intervals less than ``gap`` + 1 apart are in one."""
    before = Window.unboundedPreceding
    d = df.withColumn("__cut", cut_column("lend", cut))
    reach = F.max("rend").over(Window.partitionBy(*keys, "__cut").orderBy("lend", "rend").rowsBetween(before, -1))
    if cut is not None:
        d = handed_over(d, keys, {"__top": F.max("rend")}, lambda w: {"__reach": F.max("__top").over(w.rowsBetween(before, -1))})
        reach = F.greatest(reach, "__reach")
    d = d.withColumn("__start", F.when(F.col("lend") - reach <= gap, None).otherwise(F.col("lend")))
    return latest_start(d.drop("__cut", "__reach"), keys, ["lend", "rend"], cut=cut).drop("__start")


def merge_intervals(df: DataFrame, keys: Sequence[str] = SPOT, *, gap: int = 1, cut: int | None = CUT, tasks: int | None = None) -> DataFrame:
    """Islands of intervals that overlap or lie less than ``gap`` + 1 apart; gap 1 joins touching ones.

    Intervals with one start are one row before the sweep, and a sweep is cut every ``cut`` bases, with the reach of what
    lies before handed over; the rows are the same for every cut. None (for many small groups) is one sweep for each key,
    after one shuffle into ``tasks`` tasks (by default, :func:`task_count`).
    """
    d = df.where("lend IS NOT NULL AND rend IS NOT NULL")
    if cut is None:
        d = d.select(*keys, "lend", "rend").repartition(tasks or task_count(d), *keys)
    starts = d.groupBy(*keys, "lend").agg(F.max("rend").alias("rend"), F.count(F.lit(1)).alias("n_merged"))
    islands = island_starts(starts, keys, gap=gap, cut=cut).groupBy(*keys, "__island")
    return islands.agg(F.min("lend").alias("lend"), F.max("rend").alias("rend"), F.sum("n_merged").alias("n_merged")).drop("__island")


def coverage_runs(df: DataFrame, keys: Sequence[str] = SPOT, *, cut: int = CUT) -> DataFrame:
    """Runs of equal coverage (lend, rend, coverage > 0) by a sweep over starts and ends, without a row for each base.

    Events at one position are summed before the sweep, so a hot position is one row in it; each cut gets the sum of all
    steps before it and the first position after it.
    """
    n = F.when(F.col("lend") <= F.col("rend"), 1).otherwise(0)  # others cut, but cover nothing
    ends = df.select(*keys, F.inline(F.array(F.struct(F.col("lend").alias("pos"), n.alias("step")), F.struct((F.col("rend") + 1).alias("pos"), (-n).alias("step")))))
    steps = ends.where("pos IS NOT NULL").groupBy(*keys, "pos").agg(F.sum("step").alias("step")).withColumn("__cut", cut_column("pos", cut))
    d = handed_over(
        steps, keys, {"__sum": F.sum("step"), "__first": F.min("pos")},
        lambda w: {"__base": F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), "__next": F.lead("__first").over(w)},
    )
    w = Window.partitionBy(*keys, "__cut").orderBy("pos")
    depth = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("__base", F.lit(0))
    runs = d.select(*keys, F.col("pos").alias("lend"), (F.coalesce(F.lead("pos").over(w), "__next") - 1).alias("rend"), depth.alias("coverage"))
    return runs.where("coverage > 0 AND rend >= lend")


def mean_coverage(spans: DataFrame, runs: DataFrame, keys: Sequence[str] = SPOT, *, id_col: str, bin_size: int = 1024) -> DataFrame:
    """Mean coverage of each span (``id_col``, lend, rend); 0 where nothing covers it."""
    r = runs.select(*keys, F.col("lend").alias("lend2"), F.col("rend").alias("rend2"), "coverage")
    got = interval_join(spans.select(id_col, *keys, "lend", "rend"), r, keys, bin_size=bin_size).groupBy(id_col).agg(F.sum(F.col("coverage") * F.col("overlap")).alias("bases"))
    return spans.join(got, id_col, "left").select(id_col, (F.coalesce("bases", F.lit(0)) / (F.col("rend") - F.col("lend") + 1)).alias("mean_coverage"))


def segment(df: DataFrame, cuts: DataFrame, keys: Sequence[str] = SPOT, *, cut: int = CUT) -> DataFrame:
    """H3: covered stretches, from one zero to the next, cut at the positions of ``cuts``, which begin a new segment."""
    merged = merge_intervals(df, keys, cut=cut)
    at = merged.select(*keys, F.col("lend").alias("pos")).unionByName(merged.select(*keys, (F.col("rend") + 1).alias("pos"))).unionByName(cuts.select(*keys, "pos")).distinct()
    at = handed_over(at.withColumn("__cut", cut_column("pos", cut)), keys, {"__first": F.min("pos")}, lambda w: {"__next": F.lead("__first").over(w)})
    w = Window.partitionBy(*keys, "__cut").orderBy("pos")
    pieces = at.select(*keys, F.col("pos").alias("lend"), (F.coalesce(F.lead("pos").over(w), "__next") - 1).alias("rend")).where("rend >= lend")
    return interval_join(pieces, merged.select(*keys, F.col("lend").alias("lend2"), F.col("rend").alias("rend2")), keys, how="left_semi")


def with_halo(df: DataFrame, before: int, after: int, *, cut: int = CUT) -> DataFrame:
    """``df`` (pos) listed in every cut (``__cut``) in which a position sees it: from ``before`` below itself to ``after`` above.

    ``__own`` marks the one listing of a row in its own cut.
    """
    low, high = (F.floor((F.col("pos") + F.lit(d)) / F.lit(cut)) for d in (-after, before))
    return df.withColumn("__cut", F.explode(F.sequence(low, high))).withColumn("__own", F.col("__cut") == F.floor(F.col("pos") / F.lit(cut)))


def exon_segments(exons: DataFrame, keys: Sequence[str] = SPOT, *, cut: int = CUT) -> DataFrame:
    """Unique segments that all exon bounds cut the exons into.

    Every bound of an exon is a step of the sweep, so the runs of coverage are the segments.
    """
    return coverage_runs(exons, keys, cut=cut).select(*keys, "lend", "rend")


def masked_reads(reads: DataFrame, mask: DataFrame, keys: Sequence[str] = SPOT, *, min_share: float = 0.5) -> DataFrame:
    """Reads (read_id, lend, rend) without those of which one mask interval covers ``min_share`` or more."""
    m = mask.select(*keys, F.col("lend").alias("lend2"), F.col("rend").alias("rend2")).distinct()
    bad = interval_join(reads.select("read_id", *keys, "lend", "rend"), m, keys).where(F.col("overlap") >= min_share * (F.col("rend") - F.col("lend") + 1)).select("read_id").distinct()
    return reads.join(bad, "read_id", "left_anti")


def pair_overlap(exons: DataFrame, id_col: str, keys: Sequence[str] = SPOT) -> DataFrame:
    """Shared bases of each pair of transcripts, from their merged exons; ``id_col`` < ``id_col``_2."""
    tasks, two, size = task_count(exons), f"{id_col}_2", F.lit(1024)
    own = merge_intervals(exons, [*keys, id_col], cut=None, tasks=tasks).select(*keys, id_col, "lend", "rend")
    # one shuffle into bins, from which both sides of the join are read; pairs are summed in each bin before they are moved
    bins = own.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("lend") / size), F.floor(F.col("rend") / size)))).repartition(tasks, *keys, "__bin")
    other = bins.select(*keys, "__bin", F.col(id_col).alias(two), F.col("lend").alias("lend2"), F.col("rend").alias("rend2"))
    first = F.col("__bin") == F.floor(F.greatest("lend", "lend2") / size)
    met = (F.col(id_col) < F.col(two)) & (F.col("lend") <= F.col("rend2")) & (F.col("rend") >= F.col("lend2")) & first
    pairs = bins.join(other, [*keys, "__bin"]).where(met).withColumn("overlap", overlap_bp(F.col("lend"), F.col("rend"), F.col("lend2"), F.col("rend2"))).where("overlap >= 1")
    sums = pairs.groupBy(*keys, "__bin", id_col, two).agg(F.sum("overlap").alias("overlap"))
    return sums.select(id_col, two, "overlap").repartition(2 * tasks, id_col, two).groupBy(id_col, two).agg(F.sum("overlap").alias("overlap"))


def best_overlap(reads: DataFrame, exons: DataFrame, keys: Sequence[str] = SPOT) -> DataFrame:
    """For each read (read_id) the transcript (tx_id) with the most shared bases; ties go to the least tx_id."""
    own = merge_intervals(exons, [*keys, "tx_id"], cut=None).select(*keys, "tx_id", F.col("lend").alias("lend2"), F.col("rend").alias("rend2"))
    # a read stands in one bin, whose size fits its length, and exons in all bins whose reads they can meet: sums and the
    # best are then made where pairs meet, and only each read's best is shuffled
    length = F.greatest(F.col("rend") - F.col("lend") + 1, F.lit(64))
    r = reads.where("lend IS NOT NULL AND rend IS NOT NULL").select("read_id", *keys, "lend", "rend", F.ceil(F.log2(length)).cast("long").alias("__level"))
    r = r.withColumn("__bin", F.floor(F.col("lend") / F.pow(F.lit(2.0), "__level")))
    size = F.pow(F.lit(2.0), "__level")
    e = own.crossJoin(F.broadcast(r.select("__level").distinct())).withColumn("__bin", F.explode(F.sequence(F.floor(F.col("lend2") / size) - 1, F.floor(F.col("rend2") / size))))
    spot = [*keys, "__level", "__bin"]
    spread = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but many pairs
    pairs = r.repartition(spread, *spot).join(e.repartition(spread, *spot), spot).where("lend <= rend2 AND rend >= lend2").withColumn("overlap", overlap_bp(F.col("lend"), F.col("rend"), F.col("lend2"), F.col("rend2"))).where("overlap >= 1")
    sums = pairs.groupBy(*spot, "read_id", "tx_id").agg(F.sum("overlap").alias("overlap"))
    return sums.groupBy("read_id").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "tx_id")).alias("m")).select("read_id", "m.tx_id", (-F.col("m.o")).alias("overlap"))


def nearest_site(points: DataFrame, sites: DataFrame, keys: Sequence[str] = SPOT, *, window: int = 25) -> DataFrame:
    """D3: the nearest site (site_id, site, support) within ``window`` of each point (point_id, pos).

    By distance, then support from high to low, then site_id.
    """
    p = points.withColumns({"lend": F.col("pos") - window, "rend": F.col("pos") + window})
    s = sites.withColumns({"lend2": F.col("site"), "rend2": F.col("site")})
    rank = F.struct(F.abs(F.col("pos") - F.col("site")).alias("distance"), (-F.col("support")).alias("s"), F.col("site_id"))
    return interval_join(p, s, keys, bin_size=max(64, window)).groupBy("point_id").agg(F.min(rank).alias("m")).select("point_id", F.col("m.site_id").alias("site_id"), F.col("m.distance").alias("distance"))


def adjacency(exons: DataFrame, introns: DataFrame, keys: Sequence[str] = SPOT) -> DataFrame:
    """Edges (src, dst) from exon to intron to exon and between touching exons; nodes have node_id, lend, rend."""

    def touch(a: DataFrame, b: DataFrame) -> DataFrame:
        left = a.select(*keys, F.col("node_id").alias("src"), (F.col("rend") + 1).alias("at"))
        return left.join(b.select(*keys, F.col("node_id").alias("dst"), F.col("lend").alias("at")), [*keys, "at"]).select("src", "dst")

    return touch(exons, introns).unionByName(touch(introns, exons)).unionByName(touch(exons, exons))


def in_region(df: DataFrame, contig: str, lend: int, rend: int, *, strand: str | None = None, contained: bool = False) -> DataFrame:
    """Rows that overlap the region, or lie inside it; plain comparisons, which reach the Parquet scan."""
    d = df.where((F.col("contig") == contig) & ((F.col("lend") >= lend) & (F.col("rend") <= rend) if contained else (F.col("lend") <= rend) & (F.col("rend") >= lend)))
    return d if strand is None else d.where(F.col("strand") == strand)
