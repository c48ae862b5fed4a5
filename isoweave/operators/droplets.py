"""Which barcodes hold a cell, by a test against the ambient profile (section C of the survey)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import write_through
from .statistics import benjamini_hochberg


def good_turing(counts: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Smoothed share of a species seen ``counts`` times (ascending, over 0; ``times`` species each), and that of all unseen.

    Turing's estimate r* = (r + 1) n(r + 1) / n(r) holds while it differs from the log-linear one by more than 1.65 of
    its deviations; from there on the log-linear one does. Shares of what is seen add up to one less the unseen share.
    """
    r, n = np.asarray(counts, float), np.asarray(times, float)
    total = float((r * n).sum())
    if len(r) == 0:
        return np.zeros(0), 1.0
    unseen = float(n[0] / total) if r[0] == 1 else 0.0
    before, after = np.concatenate([[0.0], r[:-1]]), np.concatenate([r[1:], [2 * r[-1] - (r[-2] if len(r) > 1 else 0.0)]])
    x, z = np.log(r), np.log(2 * n / (after - before))
    spread = ((x - x.mean()) ** 2).sum()
    slope = float(((x - x.mean()) * (z - z.mean())).sum() / spread) if spread else -1.0
    smooth = r * (1 + 1 / r) ** (slope + 1)
    star, linear = smooth.copy(), False
    for i in range(len(r)):
        following = n[i + 1] if i + 1 < len(r) and r[i + 1] == r[i] + 1 else 0.0
        if linear or not following:
            break
        turing = (r[i] + 1) * following / n[i]
        linear = abs(turing - smooth[i]) <= 1.65 * math.sqrt((r[i] + 1) ** 2 * following / n[i] ** 2 * (1 + following / n[i]))
        if not linear:
            star[i] = turing
    if unseen >= 1:  # all seen once: nothing tells seen from unseen
        unseen = 0.5
    return (1 - unseen) * star / (star * n).sum(), unseen


def ambient_counts(counts: DataFrame, *, lower: float | None = 100) -> DataFrame:
    """(feature, r): counts of every feature in barcodes of ``lower`` counts or fewer (None: in all)."""
    d = counts.where("cell IS NOT NULL AND feature IS NOT NULL AND n > 0")
    small = d.groupBy("cell").agg(F.sum("n").alias("t"))
    small = small if lower is None else small.where(F.col("t") <= lower)
    seen = d.join(small.select("cell"), "cell", "left_semi").groupBy("feature").agg(F.sum("n").cast("long").alias("r"))
    return d.select("feature").distinct().join(seen, "feature", "left").fillna(0, ["r"])


def ambient_profile(counts: DataFrame, *, lower: float | None = 100) -> DataFrame:
    """(feature, p): the expected share of each feature in barcodes of ``lower`` counts or fewer, by Good-Turing.

    ``counts`` has cell, feature, n (whole numbers). Features that only larger barcodes have share the unseen part
    equally. Only how many features have each sum reaches the driver: at most the root of twice all counts.
    """
    both = write_through(ambient_counts(counts, lower=lower), "ambient")
    times = both.groupBy("r").agg(F.count(F.lit(1)).alias("n")).orderBy("r").toPandas()
    known = times[times["r"] > 0]
    if known.empty:
        raise ValueError("no counts available for the ambient profile")
    share, unseen = good_turing(known["r"].to_numpy(), known["n"].to_numpy())
    missing = int(times.loc[times["r"] == 0, "n"].sum())
    if not missing:
        share, unseen = share / (1 - unseen), 0.0
    rows = [(int(a), float(b)) for a, b in zip(known["r"], share, strict=True)] + ([(0, max(unseen, 1e-12) / missing)] if missing else [])
    table = counts.sparkSession.createDataFrame(rows, "r long, p double")
    return both.join(table, "r").select("feature", "p")


@F.pandas_udf(T.DoubleType())
def log_factorial(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """log n! of a whole number."""
    for s in batches:
        values, at = np.unique(s.to_numpy(float), return_inverse=True)
        yield pd.Series(np.array([math.lgamma(v + 1) for v in values])[at] if len(values) else s.astype(float))


def running_log_chance(p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Log multinomial chance of the counts of the first 1, 2, ... draws (indexes into ``p``) of a sequence."""
    order = np.argsort(draws, kind="stable")
    s = draws[order]
    first = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1]
    place = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    nth = np.empty(len(s))
    nth[order] = place + 1
    return np.cumsum(np.log(p[draws]) + np.log(np.arange(1, len(draws) + 1)) - np.log(nth))


def simulated_chances(profile: DataFrame, totals: DataFrame, *, rounds: int, seed: int, at_once: int = 100) -> DataFrame:
    """(total, block, sims): log chances of random barcodes of each ``totals.total`` counts, ``at_once`` sequences in a block.

    A sequence is drawn once for the largest total; its beginnings serve the smaller ones. Each sequence has its own
    generator, so the rows don't depend on partitions. A task reads the profile (one number a feature) and the distinct
    totals as arrays, and holds ``at_once`` numbers for each total.
    """
    spark = profile.sparkSession
    p = profile.agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "p"))), lambda x: x["p"]).alias("p"))
    t = totals.select("total").distinct().agg(F.array_sort(F.collect_list("total")).alias("totals"))
    blocks = spark.range(0, -(-rounds // at_once), 1, numPartitions=max(1, -(-rounds // at_once)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for block, share, wanted in zip(df["id"], df["p"], df["totals"], strict=True):
                share, wanted = np.asarray(share, float), np.asarray(wanted, dtype=np.int64)
                if not len(wanted):
                    continue
                share = share / share.sum()
                edges = np.cumsum(share)
                out = []
                for k in range(block * at_once, min(rounds, (block + 1) * at_once)):
                    u = np.random.default_rng([seed, k]).random(int(wanted[-1]))
                    draws = np.minimum(np.searchsorted(edges, u, side="right"), len(share) - 1)
                    out.append(running_log_chance(share, draws)[wanted - 1])
                yield pd.DataFrame({"total": wanted, "block": int(block), "sims": list(np.array(out).T)})

    return blocks.join(F.broadcast(p.join(t, F.lit(True))), F.lit(True)).mapInPandas(run, "total long, block long, sims array<double>")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _ranks(values: pd.Series, sims: pd.Series) -> pd.Series:
    """For each value of a list, how many of ``sims`` are not above it."""
    return pd.Series([np.searchsorted(np.sort(b), np.asarray(a) + 1e-7, side="right") for a, b in zip(values, sims, strict=True)])


def _places(tested: DataFrame, sims: DataFrame, *, at_once: int = 4096) -> DataFrame:
    """(total, log_chance, n_below) of each distinct pair; a total's chances meet each block in lists of about ``at_once``."""
    pairs = tested.select("total", "log_chance").distinct()
    size = pairs.groupBy("total").agg(F.ceil(F.count(F.lit(1)) / at_once).alias("__k"))
    lists = pairs.join(size, "total").groupBy("total", F.pmod(F.xxhash64("log_chance"), F.col("__k")).alias("__k")).agg(F.collect_list("log_chance").alias("c"))
    met = lists.join(sims, "total").select("total", F.explode(F.arrays_zip(F.col("c"), _ranks("c", "sims").alias("n"))).alias("x"))
    return met.groupBy("total", F.col("x.c").alias("log_chance")).agg(F.sum("x.n").alias("n_below"))


def empty_droplets(counts: DataFrame, *, lower: float | None = 100, retain: float | None = None, rounds: int = 10_000, seed: int = 100) -> DataFrame:
    """(cell, total, log_chance, n_below, p_value, adj_p_value) of barcodes with more than ``lower`` counts.

    ``n_below`` of ``rounds`` simulated barcodes of the same total are no likelier under the ambient profile;
    p_value = (n_below + 1) / (rounds + 1). The model is the multinomial. Barcodes of ``retain`` or more counts
    are cells without a test: their p_value is 0 and n_below null. Chances are rounded to seven places, and nearer ones are ties.
    Nulls and counts below one are left out. With ``lower`` None all barcodes are tested, against the profile of them all.
    """
    d = counts.where("cell IS NOT NULL AND feature IS NOT NULL AND n > 0").groupBy("cell", "feature").agg(F.sum("n").cast("long").alias("n"))
    d = write_through(d, "counts")
    profile = write_through(ambient_profile(d, lower=lower), "profile")
    big = d.groupBy("cell").agg(F.sum("n").alias("total")).where(F.col("total") > (lower or 0))
    own = d.join(big.select("cell"), "cell", "left_semi").join(profile, "feature")
    part = own.groupBy("cell").agg(F.sum(F.col("n") * F.log("p") - log_factorial("n")).alias("__s"), F.sum("n").alias("total"))
    cells = write_through(part.select("cell", "total", F.round(F.col("__s") + log_factorial("total"), 7).alias("log_chance")), "barcodes")
    tested = cells if retain is None else cells.where(F.col("total") < retain)
    sims = simulated_chances(profile, tested, rounds=rounds, seed=seed)
    sims = write_through(sims, "simulated")
    below = _places(tested, sims)
    out = tested.join(below, ["total", "log_chance"], "left").select("cell", "total", "log_chance", F.coalesce("n_below", F.lit(0)).cast("long").alias("n_below"))
    out = out.withColumn("p_value", (F.col("n_below") + 1) / F.lit(rounds + 1.0))
    if retain is not None:
        out = out.unionByName(cells.where(F.col("total") >= retain).select("cell", "total", "log_chance", F.lit(None).cast("long").alias("n_below"), F.lit(0.0).alias("p_value")))
    return benjamini_hochberg(write_through(out, "tests"))


def good_cells(counts: DataFrame, *, fdr: float = 0.01, lower: float = 100, rounds: int = 10_000, seed: int = 100) -> DataFrame:
    """``counts`` of the barcodes whose adjusted p-value is ``fdr`` or less.

    Where no barcode is small enough to show the ambient profile, a second try takes the profile of all barcodes (a limit
    of 0 leaves none to take it from).
    """
    d = write_through(counts.where("cell IS NOT NULL AND feature IS NOT NULL AND n > 0"), "matrix")
    small = d.groupBy("cell").agg(F.sum("n").alias("t")).where(F.col("t") <= lower)
    tests = empty_droplets(d, lower=None if small.isEmpty() else lower, rounds=rounds, seed=seed)
    return d.join(tests.where(F.col("adj_p_value") <= fdr).select("cell"), "cell", "left_semi")
