"""Differential isoform usage of replicated samples by negative binomial models (section L of the survey)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import write_through
from .quantify import bulk_filter
from .statistics import benjamini_hochberg, chi2_tail

#: dispersions at which likelihoods are compared: powers of two around 0.1
GRID = 0.1 * 2.0 ** np.linspace(-6, 6, 25)


def norm_factors(counts: DataFrame, *, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """(sample, total, factor): trimmed mean of log ratios to a reference sample; the product of factors is one.

    ``counts`` has tx_id, sample, n, absent rows being zeros. The reference is the sample whose upper quartile, as a share
    of its total, is nearest to the mean of them (ties to the least name). Features seen in both samples are ranked by ratio and by
    abundance; those outside ``trim_m`` and ``trim_a`` at either end don't count, the others by the inverse of their
    variance. A window holds the features of one sample, whose number the annotation bounds.
    """
    d = counts.where("n > 0").select("tx_id", "sample", F.col("n").cast("double").alias("n"))
    features = counts.where("n > 0").agg(F.count_distinct("tx_id").alias("__m"))
    order = Window.partitionBy("sample").orderBy(F.desc("n"), "tx_id")
    total = d.groupBy("sample").agg(F.sum("n").alias("total"))
    # the upper quartile with zeros: what stands a quarter of all features below the top
    top = d.withColumn("__r", F.row_number().over(order)).join(F.broadcast(features), F.lit(True)).where(F.col("__r") == F.floor(F.col("__m") / 4) + 1)
    q = total.join(top.select("sample", F.col("n").alias("q")), "sample", "left").select("sample", "total", (F.coalesce("q", F.lit(0.0)) / F.col("total")).alias("q"))
    mean = q.agg(F.avg("q").alias("__q"))
    reference = q.join(F.broadcast(mean), F.lit(True)).agg(F.min(F.struct(F.round(F.abs(F.col("q") - F.col("__q")), 12).alias("d"), F.col("sample").alias("s"), F.col("total").alias("t"))).alias("m")).select(F.col("m.s").alias("__s"), F.col("m.t").alias("__tr"))
    ref = d.join(F.broadcast(reference), F.col("sample") == F.col("__s")).select("tx_id", F.col("n").alias("__nr"), "__tr")
    x, y = F.col("n") / F.col("total"), F.col("__nr") / F.col("__tr")
    both = d.join(total, "sample").join(ref, "tx_id").select("sample", "tx_id", F.log2(x / y).alias("m"), ((F.log2(x) + F.log2(y)) / 2).alias("a"), (1 / ((1 - x) / F.col("n") + (1 - y) / F.col("__nr"))).alias("w"))
    mean_rank = lambda c: F.rank().over(Window.partitionBy("sample").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("sample", c)) - 1) / 2
    both = both.withColumns({"__k": F.count(F.lit(1)).over(Window.partitionBy("sample")), "__rm": mean_rank("m"), "__ra": mean_rank("a")})
    inside = lambda r, t: (F.col(r) >= F.floor(F.col("__k") * t) + 1) & (F.col(r) <= F.col("__k") - F.floor(F.col("__k") * t))
    kept = both.where(inside("__rm", trim_m) & inside("__ra", trim_a) & F.col("w").isNotNull()).groupBy("sample").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("f"))
    logs = total.join(kept, "sample", "left").select("sample", "total", F.coalesce("f", F.lit(0.0)).alias("f"))
    centre = logs.agg(F.avg("f").alias("__c"))
    return logs.join(F.broadcast(centre), F.lit(True)).select("sample", "total", F.pow(F.lit(2.0), F.col("f") - F.col("__c")).alias("factor"))


def log_likelihood(y: np.ndarray, mu: np.ndarray, dispersion: np.ndarray) -> np.ndarray:
    """Negative binomial log likelihood without what depends on ``y`` and the dispersion only; Poisson's where that is 0."""
    mu = np.maximum(mu, 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.where(dispersion > 0, dispersion, 1)
        nb = y * np.log(mu / (1 + spread * mu)) - np.log1p(spread * mu) / spread
    return np.where(dispersion > 0, nb, y * np.log(mu) - mu)


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x.ravel()]).reshape(x.shape)


def group_rates(y: np.ndarray, size: np.ndarray, dispersion: np.ndarray, steps: int = 60) -> np.ndarray:
    """Rates r of rows ``y`` (rows x samples) with means r * ``size`` at most likelihood, by Newton steps on log r; 0 for rows of zeros."""
    total = y.sum(axis=1)
    rate = np.where(total > 0, total / size.sum(axis=1), 0.0)
    log_rate = np.log(np.maximum(rate, 1e-300))
    phi = np.broadcast_to(dispersion[:, None], y.shape)
    for _ in range(steps):
        mu = np.exp(log_rate)[:, None] * size
        score = ((y - mu) / (1 + phi * mu)).sum(axis=1)
        info = (mu * (1 + phi * y) / (1 + phi * mu) ** 2).sum(axis=1)
        step = np.where(total > 0, np.clip(score / np.maximum(info, 1e-300), -2, 2), 0)
        log_rate = log_rate + step
        if (np.abs(step) < 1e-12).all():
            break
    return np.where(total > 0, np.exp(log_rate), 0.0)


def adjusted_profile(y: np.ndarray, size: np.ndarray, group: np.ndarray, dispersion: float) -> np.ndarray:
    """Log likelihood of the rows at one dispersion, rates by ``group`` at their best, less half the log information of each."""
    phi = np.full(len(y), dispersion)
    out = (_lgamma(y + 1 / dispersion) - math.lgamma(1 / dispersion) + y * math.log(dispersion)).sum(axis=1)
    for g in np.unique(group):
        at = group == g
        mu = group_rates(y[:, at], size[:, at], phi)[:, None] * size[:, at]
        out += log_likelihood(y[:, at], mu, phi[:, None]).sum(axis=1)
        out -= 0.5 * np.log(np.maximum((mu / (1 + dispersion * mu)).sum(axis=1), 1e-10))
    return out


def peak(values: np.ndarray) -> float:
    """Dispersion where likelihoods on ``GRID`` are highest, by a parabola through the best point and its neighbours."""
    i = int(np.argmax(values))
    if i in (0, len(GRID) - 1):
        return float(GRID[i])
    a, b, c = values[i - 1 : i + 2]
    bend = a - 2 * b + c
    shift = 0.5 * (a - c) / bend if bend < 0 else 0.0
    return float(GRID[i] * (GRID[1] / GRID[0]) ** shift)


def usage_tests(y: np.ndarray, size: np.ndarray, second: np.ndarray, dispersion: np.ndarray) -> tuple[float, float, int, np.ndarray, np.ndarray]:
    """Of one gene (isoforms x samples): log2 change, statistic and degrees of freedom; log2 change and statistic of each isoform.

    Under the null hypothesis all isoforms change between the conditions by one factor, found by golden section on the profile likelihood;
    else each by its own. Statistics are twice the difference of log likelihoods. An isoform's own is against the gene's factor.
    """
    phi = dispersion[:, None]
    grow = second.astype(float)

    def fitted(change: np.ndarray) -> np.ndarray:
        own = size * np.exp(change[:, None] * grow)
        return log_likelihood(y, group_rates(y, own, dispersion)[:, None] * own, phi).sum(axis=1)

    rates = np.array([group_rates(y[:, at], size[:, at], dispersion) for at in (~second, second)])
    mu = np.where(second, rates[1][:, None], rates[0][:, None]) * size
    free = np.where(mu > 0, log_likelihood(y, mu, phi), 0).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.log(rates[1]) - np.log(rates[0])
    known = own[np.isfinite(own)]
    low, high = (float(known.min()), float(known.max())) if len(known) else (0.0, 0.0)
    if len(known) < len(own):  # an isoform of one condition only pulls past the others
        low, high = low - 20, high + 20
    ratio = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    at = lambda x: float(fitted(np.full(len(y), x)).sum())
    fc, fd = at(c), at(d)
    while b - a > 1e-9:
        if fc >= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = at(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = at(d)
    shared = (a + b) / 2
    each = np.maximum(0.0, 2 * (free - fitted(np.full(len(y), shared))))
    return shared / math.log(2), float(each.sum()), len(y) - 1, own / math.log(2), each


def bulk_differential_usage(
    counts: DataFrame, samples: DataFrame, *, first: str, second: str, min_cpm: float = 1.0, min_samples: int = 2, min_isoforms: int = 2, prior: float = 10.0
) -> tuple[DataFrame, DataFrame]:
    """Genes and isoforms whose usage differs between the conditions ``first`` and ``second``.

    ``counts`` has gene_id, tx_id, sample, n; ``samples`` has sample and condition (other conditions count for the filter,
    the factors and the dispersions). After :func:`bulk_filter` and :func:`norm_factors`, each isoform's dispersion has the highest sum of
    its own likelihood (adjusted for its fitted rates) and ``prior`` times the mean of all isoforms', on ``GRID``. Genes:
    gene_id, n_isoforms, log2_fc, statistic, p_value (likelihood ratio, chi-squared with one degree less than isoforms), simes_p (least of
    the isoforms' p-values times their number by rank), adj_p_value. Isoforms: gene_id, tx_id, dispersion, log2_fc (relative to the gene's; null
    where a condition has none), statistic, p_value, adj_p_value.

    Counts go to the Python side as one row for each isoform, with a list over the samples; the mean likelihood is one
    aggregate. Null ids and samples without a condition are left out, negative counts too. Likelihood-ratio tests stand in for
    the quasi-likelihood ones, so p-values aren't the same numbers.
    """
    kept = counts.where("gene_id IS NOT NULL AND tx_id IS NOT NULL AND n >= 0").join(samples.where("condition IS NOT NULL").select("sample").distinct(), "sample", "left_semi")
    kept = write_through(bulk_filter(kept.groupBy("gene_id", "tx_id", "sample").agg(F.sum("n").alias("n")), min_cpm=min_cpm, min_samples=min_samples, min_isoforms=min_isoforms), "filtered")
    factors = write_through(norm_factors(kept), "factors")
    # one row for each sample: the study's design, not its data
    design = factors.join(samples.groupBy("sample").agg(F.min("condition").alias("condition")), "sample").orderBy("sample").toPandas()
    place = {s: i for i, s in enumerate(design["sample"])}
    names, group = design["condition"].to_numpy(), pd.factorize(design["condition"])[0]
    library = (design["total"] * design["factor"]).to_numpy(float)
    library = library / library.mean() if len(library) else library
    missing = {first, second} - set(names)
    if missing and len(names):
        raise ValueError(f"no sample is of condition {sorted(missing)}")

    rows = kept.groupBy("gene_id", "tx_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", "n"))).alias("m"))
    listed = F.array(*[F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0.0)).cast("double") for s in place]) if place else F.array().cast("array<double>")
    rows = rows.select("gene_id", "tx_id", listed.alias("y"))

    def profiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            y = np.array(df["y"].tolist(), float).reshape(len(df), len(library))
            size = np.broadcast_to(library, y.shape)
            df = df.copy()
            df["likelihood"] = list(np.array([adjusted_profile(y, size, group, g) for g in GRID]).T)
            yield df

    g, t = kept.schema["gene_id"].dataType.simpleString(), kept.schema["tx_id"].dataType.simpleString()
    own = write_through(rows.mapInPandas(profiles, f"gene_id {g}, tx_id {t}, y array<double>, likelihood array<double>"), "likelihoods")
    common = own.agg(F.array(*[F.avg(F.col("likelihood")[i]) for i in range(len(GRID))]).alias("common"))
    two = np.isin(names, [first, second])

    def tests(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("tx_id")
        shrunk = np.array([peak(np.asarray(a) + prior * np.asarray(b)) for a, b in zip(df["likelihood"], df["common"], strict=True)])
        y = np.array(df["y"].tolist(), float)[:, two]
        seen = y.sum(axis=1) > 0
        nothing = np.full(len(df), np.nan)
        change, single, shared, statistic, dof = nothing.copy(), nothing.copy(), np.nan, np.nan, int(seen.sum()) - 1
        at = names[two] == second
        if dof > 0 and y[:, at].any() and y[:, ~at].any():
            shared, statistic, dof, c, s = usage_tests(y[seen], np.broadcast_to(library[two], y[seen].shape), at, shrunk[seen])
            change[seen], single[seen] = np.where(np.isfinite(c), c - shared, np.nan), s
        p = np.array([np.nan if np.isnan(x) else chi2_tail(float(x), 1) for x in single])
        ordered = np.sort(p[~np.isnan(p)])
        simes = float((ordered * len(ordered) / np.arange(1, len(ordered) + 1)).min()) if len(ordered) else np.nan
        out = df[["gene_id", "tx_id"]].copy()
        out["dispersion"], out["log2_fc"], out["statistic"], out["p_value"] = shrunk, change, single, p
        out["gene_fc"], out["gene_statistic"], out["n_isoforms"], out["simes_p"] = shared, statistic, int(seen.sum()), simes
        out["gene_p"] = np.nan if np.isnan(statistic) else chi2_tail(statistic, dof)
        return out

    schema = f"gene_id {g}, tx_id {t}, dispersion double, log2_fc double, statistic double, p_value double, gene_fc double, gene_statistic double, n_isoforms long, simes_p double, gene_p double"
    done = own.join(F.broadcast(common), F.lit(True)).groupBy("gene_id").applyInPandas(tests, schema)
    number = [c for c in ("log2_fc", "statistic", "p_value", "gene_fc", "gene_statistic", "simes_p", "gene_p")]
    done = write_through(done.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in number else c for c in done.columns]), "usage")
    genes = done.groupBy("gene_id").agg(F.first("n_isoforms").alias("n_isoforms"), F.first("gene_fc").alias("log2_fc"), F.first("gene_statistic").alias("statistic"), F.first("gene_p").alias("p_value"), F.first("simes_p").alias("simes_p"))
    isoforms = done.select("gene_id", "tx_id", "dispersion", "log2_fc", "statistic", "p_value")
    return benjamini_hochberg(genes), benjamini_hochberg(isoforms)
