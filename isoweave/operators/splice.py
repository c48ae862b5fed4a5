"""Alignment filters, introns, boundary sites and their support (sections A, C, E and F of the survey)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cigar_segments, introns_of, percent_identity
from .intervals import interval_join, island_starts, with_halo

#: Bits of the flag field.
PAIRED, PROPER, UNMAPPED, REVERSE, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x1, 0x2, 0x4, 0x10, 0x100, 0x200, 0x400, 0x800


def has_flag(bit: int) -> Column:
    return F.col("flag").bitwiseAND(bit) != 0


def discard_reason(*, min_mapq: int = 0, min_identity: float = 80.0, secondary: bool = True) -> Column:
    """Why an alignment (flag, mapq, cigar, nm) is dropped, null if it stays; the first reason counts."""
    identity = percent_identity(F.col("cigar"), F.col("nm"))
    return (
        F.when(has_flag(UNMAPPED), "unmapped")
        .when(F.col("mapq") < min_mapq, "min_mapping_quality")
        .when(has_flag(PAIRED) & ~has_flag(PROPER), "improper_pair")
        .when(has_flag(DUPLICATE), "duplicate")
        .when(has_flag(QC_FAIL), "qcfail")
        .when(has_flag(SECONDARY) & F.lit(not secondary), "secondary")
        .when(has_flag(SUPPLEMENTARY), "supplementary")
        .when(F.col("nm").isNotNull() & (identity < min_identity), "low_perID")
    )


def pretty_alignments(alignments: DataFrame, *, gap: int = 10) -> DataFrame:
    """A2-A4: exon segments and introns of each alignment (pos is 1-based)."""
    d = alignments.withColumn("segments", cigar_segments(F.col("cigar"), F.col("pos"), gap))
    return d.withColumn("introns", introns_of(F.col("segments")))


def splice_type(segments: str = "segments") -> Column:
    """C4: ME for more than one segment, else SE."""
    return F.when(F.size(segments) > 1, "ME").otherwise("SE")


def prune_long_terminal_introns(segments: Column, longest: int = 200_000) -> Column:
    """Without the first or last segment where the intron next to it is too long; one on each side."""
    n = F.size(segments)
    left = (n > 1) & (F.get(segments, F.lit(1))["lend"] - F.get(segments, F.lit(0))["rend"] - 1 > longest)
    once = F.when(left, F.slice(segments, 2, F.greatest(n - 1, F.lit(0)))).otherwise(segments)
    m = F.size(once)
    right = (m > 1) & (F.get(once, m - 1)["lend"] - F.get(once, m - 2)["rend"] - 1 > longest)
    return F.when(right, F.slice(once, 1, F.greatest(m - 1, F.lit(0)))).otherwise(once)


def intron_support(reads: DataFrame, *, least: int = 2) -> DataFrame:
    """Reads of each intron (contig, strand, lend, rend), with ``least`` or more."""
    x = reads.select("contig", "strand", F.explode("introns").alias("i"))
    return x.groupBy("contig", "strand", "i.lend", "i.rend").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)


def site_counts(reads: DataFrame, *, max_clip: int = 0) -> DataFrame:
    """Reads that start and end at each position (kind, contig, strand, pos, n); strand-aware."""
    first, last = F.element_at("segments", 1)["lend"], F.element_at("segments", -1)["rend"]
    plus = F.col("strand") == "+"
    tss = F.struct(F.lit("TSS").alias("kind"), F.when(plus, first).otherwise(last).alias("pos"), F.when(plus, F.col("left_sc")).otherwise(F.col("right_sc")).alias("clip"))
    end = F.struct(F.lit("POLYA").alias("kind"), F.when(plus, last).otherwise(first).alias("pos"), F.when(plus, F.col("right_sc")).otherwise(F.col("left_sc")).alias("clip"))
    d = reads.select("contig", "strand", F.explode(F.array(tss, end)).alias("s")).where(F.col("s.clip") <= max_clip)
    return d.groupBy("s.kind", "contig", "strand", "s.pos").agg(F.count(F.lit(1)).alias("n"))


def prune_alternative_introns(introns: DataFrame, *, min_share: float = 0.03) -> DataFrame:
    """H5, H6: introns whose share of those at the same left bound, then at the same right bound, is ``min_share`` or more.

    The right pass sees what the left pass left. Reference introns (is_ref) stay.
    """
    d = introns
    for side in ("lend", "rend"):
        w = Window.partitionBy("contig", "strand", side)
        d = d.withColumn("__s", F.col("support") / F.sum("support").over(w)).where((F.col("__s") >= min_share) | F.col("is_ref")).drop("__s")
    return d


def introns_with_sides(introns: DataFrame, exons: DataFrame) -> DataFrame:
    """H9: introns that touch an exon on both sides."""
    left = exons.select("contig", "strand", (F.col("rend") + 1).alias("lend"))
    right = exons.select("contig", "strand", (F.col("lend") - 1).alias("rend"))
    return introns.join(left, ["contig", "strand", "lend"], "left_semi").join(right, ["contig", "strand", "rend"], "left_semi")


def exons_inside_introns(exons: DataFrame, introns: DataFrame, *, min_share: float = 0.01, longest: int = 10_000) -> DataFrame:
    """H7: exons (node_id, support, is_ref) without those that lie in a well supported intron and have too little support.

    They touch neither of its bounds.
    """
    i = introns.where((F.col("rend") - F.col("lend") + 1 <= longest) & (F.col("support") >= 1 / min_share + 1)).select("contig", "strand", F.col("lend").alias("lend2"), F.col("rend").alias("rend2"), F.col("support").alias("support2"))
    pairs = interval_join(exons, i).where("lend > lend2 AND rend < rend2 AND NOT is_ref").where(F.col("support") / F.col("support2") < min_share)
    return exons.join(pairs.select("node_id").distinct(), "node_id", "left_anti")


def aggregate_sites(sites: DataFrame, *, window: int = 50, least: int = 5) -> DataFrame:
    """peaks (contig, strand, pos, n) that take in the counts within ``window``; greedy, so a position counts once.

    By count, then total within the window, then position from high to low. Positions more than a window apart never
    meet, so each stretch of positions without a larger gap is a group of its own.
    """
    keys = ["contig", "strand"]
    s = island_starts(sites.withColumns({"lend": F.col("pos"), "rend": F.col("pos")}), keys, gap=window).withColumnRenamed("__island", "__stretch").drop("lend", "rend")

    def greedy(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("pos")
        pos, n = df["pos"].to_numpy(), df["n"].to_numpy()
        lo, hi = np.searchsorted(pos, pos - window), np.searchsorted(pos, pos + window, "right")
        sums = np.concatenate([[0], np.cumsum(n)])
        order = np.lexsort((-pos, -(sums[hi] - sums[lo]), -n))
        free, peaks = np.ones(len(pos), bool), []
        for k in order:
            if free[k]:
                own = np.arange(lo[k], hi[k])[free[lo[k] : hi[k]]]
                free[own] = False
                peaks.append((pos[k], int(n[own].sum())))
        out = pd.DataFrame(peaks, columns=["pos", "n"])
        return out[out["n"] >= least].assign(contig=df["contig"].iloc[0], strand=df["strand"].iloc[0])[["contig", "strand", "pos", "n"]]

    return s.groupBy(*keys, "__stretch").applyInPandas(greedy, "contig string, strand string, pos long, n long")


def window_totals(sites: DataFrame, *, window: int = 50) -> DataFrame:
    """F1 (bound): counts within ``window`` of each position."""
    w = Window.partitionBy("contig", "strand", "__cut").orderBy("pos").rangeBetween(-window, window)
    return with_halo(sites, window, window).withColumn("window_total", F.sum("n").over(w)).where("__own").drop("__cut", "__own")


def peak_sites(sites: DataFrame, *, window: int = 50, ratio: float = 5.0) -> DataFrame:
    """Sites whose (count + 1) is ``ratio`` times (median of the neighbours' counts and two zeros + 1) or more.

    Neighbours lie from ``window`` before to ``window`` - 1 after the site.
    """
    w = Window.partitionBy("contig", "strand", "__cut").orderBy("pos").rangeBetween(-window, window - 1)
    near = F.array_sort(F.concat(F.filter(F.collect_list(F.struct("pos", "n")).over(w), lambda x: F.lit(True)).getField("n"), F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))))
    d = with_halo(sites, window, window - 1).withColumn("__near", near).where("__own")
    own = F.array_position("__near", F.col("n")).cast("int")
    rest = F.concat(F.slice("__near", F.lit(1), own - 1), F.slice("__near", own + 1, F.size("__near")))
    d = d.withColumn("__rest", rest).withColumn("__m", (F.get("__rest", F.floor((F.size("__rest") - 1) / 2).cast("int")) + F.get("__rest", F.floor(F.size("__rest") / 2).cast("int"))) / 2)
    return d.where((F.col("n") + 1) / (F.col("__m") + 1) >= ratio).select(*sites.columns)


def low_share_sites(sites: DataFrame, *, min_share: float = 0.05) -> DataFrame:
    """Sites of a component whose share of its counts is ``min_share`` or more."""
    w = Window.partitionBy("component")
    return sites.withColumn("__s", F.col("n") / F.sum("n").over(w)).where(F.col("__s") >= min_share).drop("__s")


def normalize_coverage(reads: DataFrame, *, bin_size: int = 100, most: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``most`` reads of each start bin, strand and contig, by a hash of name and seed (the limit is the feature)."""
    b = F.floor((F.col("pos") + 1) / bin_size)
    w = Window.partitionBy("strand", "contig", "__b").orderBy(F.xxhash64("read_name", F.lit(seed)), "read_name", "pos", "cigar")
    return reads.withColumn("__b", b).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__b", "__n")


def rescue_secondary(alignments: DataFrame) -> DataFrame:
    """Primaries, and secondary alignments good enough beside them (read, ordinal, flag, as_score, ms, nm_rate, longest_intron).

    A secondary stays if its mismatch rate isn't above the primary's and either its matching score is close (within 0.5)
    and it ranks first by alignment score, or the rate is lower by 0.005 and its longest intron is longer by more than
    0.03 in log2. A missing value fails. Supplementary rows go.
    """
    mapped = alignments.where(~has_flag(SUPPLEMENTARY) & ~has_flag(UNMAPPED))
    main = mapped.where(~has_flag(SECONDARY))
    best = main.groupBy("read").agg(F.min_by(F.struct("ms", "nm_rate", "longest_intron"), F.struct("ordinal")).alias("p"))
    w = Window.partitionBy("read").orderBy(F.desc_nulls_last("as_score"), "ordinal")
    s = mapped.where(has_flag(SECONDARY)).withColumn("__rank", F.row_number().over(w)).join(best, "read")
    d_nm, d_ms = F.col("nm_rate") - F.col("p.nm_rate"), F.col("ms") - F.col("p.ms")
    longer = F.log2((F.col("longest_intron") + 1) / (F.col("p.longest_intron") + 1))
    good = (d_nm <= 0) & (((d_ms > -0.5) & (F.col("__rank") == 1)) | ((d_ms <= -0.5) & (d_nm <= -0.005) & (longer > 0.03)))
    return main.unionByName(s.where(good).select(*main.columns))


def arbitrate(genome: DataFrame, transcriptome: DataFrame) -> DataFrame:
    """For each read the source that wins, from the two tables' identity; a failed genome mapping (null identity) loses."""
    g = genome.select("read", F.col("identity").alias("g"), F.lit(1).alias("has_g"))
    t = transcriptome.select("read", F.col("identity").alias("t"), F.lit(1).alias("has_t"))
    choice = F.when(F.col("has_t").isNull(), "genome").when(F.col("has_g").isNull() | F.col("g").isNull() | (F.col("t") > F.col("g")), "transcriptome").otherwise("genome")
    return g.join(t, "read", "full_outer").select("read", choice.alias("source"))


def boundary_estimate(ends: DataFrame, *, least: int = 7, percentile: float = 0.9) -> DataFrame:
    """for each path, the percentile of its reads' right ends and its mirror of the left ends.

    By the exclusive (n + 1) rule with linear steps between; fewer than ``least`` reads give the extremes.
    """

    def quantile(values: Column, q: float) -> Column:
        n = F.size(values)
        h = F.lit(q) * (n + 1)
        k = F.greatest(F.lit(1), F.least(F.floor(h).cast("int"), n - 1))
        a, b = F.get(values, k - 1), F.get(values, F.least(k, n - 1))
        return a + (h - k) * (b - a)

    d = ends.groupBy("path_id").agg(F.array_sort(F.collect_list("lend")).alias("l"), F.array_sort(F.collect_list("rend")).alias("r"))
    few = F.size("l") < least
    return d.select("path_id", F.when(few, F.array_min("l")).otherwise(quantile(F.col("l"), 1 - percentile)).cast("double").alias("lend"), F.when(few, F.array_max("r")).otherwise(quantile(F.col("r"), percentile)).cast("double").alias("rend"))


def internal_priming(flanks: DataFrame, *, least: int = 12) -> Column:
    """C17: 21 flanking bases with ``least`` A, or six in a row within the nearest eight (T on the minus strand, at the other end)."""
    plus = F.col("strand") == "+"
    s = F.when(plus, F.col("flank")).otherwise(F.reverse(F.translate("flank", "ACGT", "TGCA")))
    return (F.length(F.regexp_replace(s, "[^A]", "")) >= least) | F.substring(s, 1, 8).contains("AAAAAA")


def strand_votes(introns: DataFrame) -> DataFrame:
    """C11: strand of each read by the majority of its introns' classes (+, -, null); no majority gives the given strand."""
    d = introns.groupBy("read").agg(F.count_if(F.col("splice_class") == "+").alias("p"), F.count_if(F.col("splice_class") == "-").alias("m"), F.first("strand").alias("s"))
    return d.select("read", F.when(F.col("p") > F.col("m"), "+").when(F.col("m") > F.col("p"), "-").otherwise(F.col("s")).alias("strand"))
