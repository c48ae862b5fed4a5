"""Differential usage, breadth of expression, ranks and curves (sections F and L of the survey)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution: the regularised upper incomplete gamma function.

    A series below the mean and a continued fraction above it.
    """
    if x <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


@F.pandas_udf(T.DoubleType())
def chi2_p(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """p-value of a chi-squared statistic and its degrees of freedom."""
    for x, dof in batches:
        yield pd.Series([None if pd.isna(a) or pd.isna(d) or d < 1 else chi2_tail(float(a), int(d)) for a, d in zip(x, dof, strict=True)], dtype="float64")


def contingency(counts: DataFrame, group: list[str]) -> DataFrame:
    """L2: chi-squared statistic and degrees of freedom of each group's table (rows: count_a, count_b).

    With one degree of freedom the continuity correction takes up to a half off each difference. A row or column of
    zeros gives null.
    """
    w = Window.partitionBy(*group)
    d = counts.withColumns({"__a": F.sum("count_a").over(w), "__b": F.sum("count_b").over(w), "__n": F.count(F.lit(1)).over(w)})
    row, total = F.col("count_a") + F.col("count_b"), F.col("__a") + F.col("__b")

    def term(count: str, column: str) -> Column:
        expected = row * F.col(column) / total
        diff = F.abs(F.col(count) - expected)
        diff = F.when(F.col("__n") == 2, diff - F.least(F.lit(0.5), diff)).otherwise(diff)
        return F.when(expected > 0, diff * diff / expected)

    bad = (row == 0) | (F.col("__a") == 0) | (F.col("__b") == 0)
    d = d.withColumns({"__x": F.when(~bad, term("count_a", "__a") + term("count_b", "__b")), "__bad": bad.cast("int")})
    return d.groupBy(*group).agg(F.when(F.max("__bad") == 0, F.sum("__x")).alias("chi2"), (F.count(F.lit(1)) - 1).cast("int").alias("dof"))


def cluster_pairs(counts: DataFrame, index: DataFrame) -> DataFrame:
    """L3: (cluster_a, cluster_b, gene_id, tx_id, count_a, count_b) for every two clusters, without rows zero in both.

    Only clusters that have a transcript are paired, and the missing side is zero, so zeros are never stored. ``index``
    numbers the clusters (cluster, k).
    """
    c = counts.where("n > 0").join(F.broadcast(index), "cluster")
    per = c.groupBy("gene_id", "tx_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "n"))).alias("m"))
    names = index.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cluster"))), lambda x: x["cluster"]).alias("s"))
    every = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    some = F.filter(every, lambda q: F.map_contains_key("m", q["a"]) | F.map_contains_key("m", q["b"]))
    both = per.join(F.broadcast(names), F.lit(True)).select("gene_id", "tx_id", "m", F.explode(some).alias("q"))
    zero = F.lit(0.0)
    return both.select(F.col("q.a").alias("cluster_a"), F.col("q.b").alias("cluster_b"), "gene_id", "tx_id", F.coalesce(F.try_element_at("m", F.col("q.a")), zero).alias("count_a"), F.coalesce(F.try_element_at("m", F.col("q.b")), zero).alias("count_b"))


def isoform_usage(counts: DataFrame) -> DataFrame:
    """L1: usage in both conditions and its change for each isoform of a gene (gene_id, tx_id, count_a, count_b)."""
    w = Window.partitionBy("gene_id")
    pi = {c: F.col(f"count_{c}") / F.sum(f"count_{c}").over(w) for c in "ab"}
    d = counts.withColumns({"__ta": F.sum("count_a").over(w), "__tb": F.sum("count_b").over(w)}).where("__ta > 0 AND __tb > 0")
    return d.drop("__ta", "__tb").withColumns({"pi_a": pi["a"], "pi_b": pi["b"]}).withColumn("delta_pi", F.col("pi_b") - F.col("pi_a"))


def differential_usage(counts: DataFrame, *, min_reads: float = 25, min_delta: float = 0.1, top: int = 10) -> DataFrame:
    """Tested genes with chi2, dof, p_value and the sums of the two largest changes up and down; others with a status.

    Gates in order: a single isoform, no reads in a condition, too few reads in one, too small a change. The ``top``
    isoforms by total count are tested (ties by tx_id), which bounds the table and is part of the test.
    """
    w = Window.partitionBy("gene_id")
    d = counts.where("count_a > 0 OR count_b > 0").withColumns({"ta": F.sum("count_a").over(w), "tb": F.sum("count_b").over(w), "n_iso": F.count(F.lit(1)).over(w)})
    d = d.withColumn("delta", F.when((F.col("ta") > 0) & (F.col("tb") > 0), F.col("count_b") / F.col("tb") - F.col("count_a") / F.col("ta")))
    order = Window.partitionBy("gene_id").orderBy((-(F.col("count_a") + F.col("count_b"))), "tx_id")
    d = d.withColumn("__top", F.row_number().over(order))
    up = Window.partitionBy("gene_id").orderBy(F.desc_nulls_last("delta"), "tx_id")
    down = Window.partitionBy("gene_id").orderBy(F.asc_nulls_last("delta"), "tx_id")
    d = d.withColumns({"__u": F.row_number().over(up), "__d": F.row_number().over(down)})
    genes = d.groupBy("gene_id").agg(
        F.first("ta").alias("reads_a"), F.first("tb").alias("reads_b"), F.first("n_iso").alias("n_isoforms"),
        F.coalesce(F.sum(F.when((F.col("__u") <= 2) & (F.col("delta") > 0), F.col("delta"))), F.lit(0.0)).alias("delta_up"),
        F.coalesce(F.sum(F.when((F.col("__d") <= 2) & (F.col("delta") < 0), F.col("delta"))), F.lit(0.0)).alias("delta_down"),
    )
    status = (
        F.when(F.col("n_isoforms") < 2, "single_isoform")
        .when((F.col("reads_a") == 0) | (F.col("reads_b") == 0), "zero_total")
        .when((F.col("reads_a") < min_reads) | (F.col("reads_b") < min_reads), "too_few_reads")
        .when(~((F.col("delta_up") > min_delta) | (-F.col("delta_down") > min_delta)), "small_change")
        .otherwise("tested")
    )
    tested = contingency(d.where(F.col("__top") <= top).select("gene_id", "count_a", "count_b"), ["gene_id"])
    out = genes.withColumn("status", status).join(tested, "gene_id")
    return out.withColumns({"chi2": F.when(F.col("status") == "tested", F.col("chi2")), "dof": F.when(F.col("status") == "tested", F.col("dof"))})


def benjamini_hochberg(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """adjusted p-values over all rows, as the least of p * m / rank from there on.

    Distinct p-values are dealt to ranges of their logarithm. Each range sums its own values and one row for each range
    carries what lies below and above it, so no task sorts all tests.
    """
    d = tests.where(F.col(p).isNotNull())
    # running counts over sorted ranges: each range sums its own rows, and one row for each range carries the rest
    values = d.groupBy(p).agg(F.count(F.lit(1)).alias("c")).withColumn("part", F.floor(-F.log10(F.greatest(F.col(p), F.lit(1e-300))) * 4).cast("int"))
    parts = values.groupBy("part").agg(F.sum("c").alias("pc"))
    total = Window.orderBy(F.desc("part"))
    base = parts.select("part", (F.sum("pc").over(total) - F.col("pc")).alias("before"), F.sum("pc").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))
    run = Window.partitionBy("part").orderBy(p)
    ranked = values.join(base, "part").withColumn("raw", F.col(p) * F.col("m") / (F.sum("c").over(run) + F.col("before")))
    low = ranked.groupBy("part").agg(F.min("raw").alias("low"))
    later = low.select("part", F.min("low").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    back = Window.partitionBy("part").orderBy(F.desc(p))
    adj = ranked.join(later, "part").select(p, F.least(F.min("raw").over(back), F.coalesce("later", F.lit(1.0)), F.lit(1.0)).alias("adj_p_value"))
    return tests.join(adj, p, "left")


def significant(tests: DataFrame, *, alpha: float = 0.001, min_delta: float = 0.1) -> Column:
    """L4: adjusted p-value and change both past their limits."""
    return (F.col("adj_p_value") <= alpha) & (F.greatest(F.col("delta_up"), -F.col("delta_down")) >= min_delta)


def top_isoforms(counts: DataFrame, *, n: int = 2) -> DataFrame:
    """a gene's ``n`` largest isoforms in either condition (ties by tx_id)."""
    a = F.row_number().over(Window.partitionBy("gene_id").orderBy(F.desc("count_a"), "tx_id"))
    b = F.row_number().over(Window.partitionBy("gene_id").orderBy(F.desc("count_b"), "tx_id"))
    return counts.withColumns({"__a": a, "__b": b}).where((F.col("__a") <= n) | (F.col("__b") <= n)).drop("__a", "__b")


def dominant_isoform(fractions: DataFrame) -> DataFrame:
    """each gene's isoform with the largest fraction in each cluster (ties to the least tx_id)."""
    return fractions.groupBy("gene_id", "cluster").agg(F.min(F.struct((-F.col("fraction")).alias("f"), "tx_id")).alias("m")).select("gene_id", "cluster", "m.tx_id", (-F.col("m.f")).alias("fraction"))


def direction(log2_fc: Column, change: Column, *, min_fc: float = 0.25, min_change: float = 0.1) -> Column:
    """Up, down or neutral by fold change and change of fraction."""
    return F.when((log2_fc >= min_fc) & (change >= min_change), "up").when((log2_fc <= -min_fc) & (change <= -min_change), "down").otherwise("neutral")


def breadth(counts: DataFrame, n_clusters: int) -> DataFrame:
    """For each transcript, breadth of expression over ``n_clusters`` clusters from (tx_id, cluster, n).

    Counts become shares of the column's million first. Entropy (bits), normalised entropy, divergence from uniform,
    Simpson, Gini, tau and the largest share. Absent clusters are zeros.
    """
    column = counts.groupBy("cluster").agg(F.sum("n").alias("__t"))
    d = counts.join(F.broadcast(column), "cluster").withColumn("x", F.col("n") / F.col("__t") * 1e6).where("x > 0")
    w = Window.partitionBy("tx_id")
    d = d.withColumns({"p": F.col("x") / F.sum("x").over(w), "r": F.row_number().over(Window.partitionBy("tx_id").orderBy("x", "cluster")), "k": F.count(F.lit(1)).over(w)})
    rank = F.col("r") + (F.lit(n_clusters) - F.col("k"))  # zeros come first
    e = d.groupBy("tx_id").agg(
        (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), (1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"), F.max("p").alias("max_fraction"),
        F.sum(rank * F.col("p")).alias("__g"), F.sum("x").alias("__s"), F.max("x").alias("__m"),
    )
    k = float(n_clusters)
    return e.select(
        "tx_id", "entropy", (F.col("entropy") / math.log2(k)).alias("entropy_norm"), (math.log2(k) - F.col("entropy")).alias("kl_uniform"), "simpson",
        (2 * F.col("__g") / k - (k + 1) / k).alias("gini"), ((k - F.col("__s") / F.col("__m")) / (k - 1)).alias("tau"), "max_fraction",
    )


def first_seen_curve(rows: DataFrame, *, steps: int = 100) -> DataFrame:
    """ids first seen up to each of about ``steps`` marks of the order (ordinal, id), and their running sum.

    First rows are found by a partial aggregate and summed by mark, so only one row for each mark is sorted in one place.
    """
    last = rows.agg(F.max("ordinal").alias("last"))
    first = rows.groupBy("id").agg(F.min("ordinal").alias("ordinal"))
    size = F.greatest(F.lit(1), F.ceil((F.col("last") + 1) / steps))
    marks = first.join(F.broadcast(last), F.lit(True)).select(F.floor(F.col("ordinal") / size).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n_new"))
    return marks.withColumn("n_seen", F.sum("n_new").over(Window.orderBy("mark").rowsBetween(Window.unboundedPreceding, 0)))


def saturation_fit(x: np.ndarray, y: np.ndarray, kind: str = "mm", steps: int = 200) -> tuple[float, float, float]:
    """(vmax, k, AIC) of vmax * x / (k + x) for ``mm``, or of vmax * (1 - exp(-k x)), by damped Gauss-Newton steps."""
    x, y = np.asarray(x, float), np.asarray(y, float)

    def model(v: float, k: float) -> tuple[np.ndarray, np.ndarray]:
        if kind == "mm":
            return v * x / (k + x), np.column_stack([x / (k + x), -v * x / (k + x) ** 2])
        e = np.exp(-k * x)
        return v * (1 - e), np.column_stack([1 - e, v * x * e])

    p = np.array([y.max() * 1.2, x.mean() if kind == "mm" else 1 / x.mean()])
    loss = lambda q: ((y - model(*q)[0]) ** 2).sum()
    damp = 1e-3
    for _ in range(steps):
        f, jac = model(*p)
        a = jac.T @ jac
        step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), jac.T @ (y - f))
        if (p + step > 0).all() and loss(p + step) <= loss(p):
            p, damp = p + step, damp / 3
            if (np.abs(step) < 1e-10 * np.abs(p)).all():
                break
        else:
            damp *= 4
    rss = max(loss(p), 1e-300)
    return float(p[0]), float(p[1]), float(len(x) * math.log(rss / len(x)) + 4)


def saturation_models(points: DataFrame, key: str, *, share: float = 0.95) -> DataFrame:
    """(key, model, vmax, k, aic, x_at_95) of each key's curve (x, y): the model with the lesser AIC, mm in a tie.

    ``x_at_95`` is where the curve reaches ``share`` of vmax. A curve is a group of few points (:func:`first_seen_curve`
    has about a hundred); one with fewer than three points, or zeros only, has nulls. Null points are left out.
    """
    name = points.schema[key].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        x, y = df["x"].to_numpy(float), df["y"].to_numpy(float)
        if len(x) < 3 or not y.any():
            return pd.DataFrame({key: df[key].iloc[:1], "model": [None], "vmax": [None], "k": [None], "aic": [None], "x_at_95": [None]})
        fits = {kind: saturation_fit(x, y, kind) for kind in ("mm", "exp")}
        kind = min(fits, key=lambda f: (fits[f][2], f != "mm"))
        vmax, k, aic = fits[kind]
        at = k * share / (1 - share) if kind == "mm" else -math.log(1 - share) / k
        return pd.DataFrame({key: df[key].iloc[:1], "model": [kind], "vmax": [vmax], "k": [k], "aic": [aic], "x_at_95": [at]})

    d = points.where("x IS NOT NULL AND y IS NOT NULL").select(key, "x", "y")
    return d.groupBy(key).applyInPandas(run, f"{key} {name}, model string, vmax double, k double, aic double, x_at_95 double")


def rank_sum(values: DataFrame) -> DataFrame:
    """Wilcoxon rank-sum z of (feature, grp 0 or 1, value) for each feature, with the correction for ties."""
    tied = values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("t"), F.sum("grp").alias("k"))
    w = Window.partitionBy("feature").orderBy("value")
    mean_rank = F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("t") - 1) / 2
    d = tied.withColumn("r", mean_rank).groupBy("feature").agg(F.sum(F.col("k") * F.col("r")).alias("w"), F.sum("k").cast("double").alias("n1"), F.sum("t").cast("double").alias("n"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    n2 = F.col("n") - F.col("n1")
    var = F.col("n1") * n2 / 12 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1)))
    return d.where((F.col("n1") > 0) & (n2 > 0)).select("feature", F.when(var > 0, (F.col("w") - F.col("n1") * (F.col("n") + 1) / 2) / F.sqrt(var)).alias("z"))


def expression_ramp(items: DataFrame, *, low: int = 1, high: int = 5) -> DataFrame:
    """Each item as often as a linear ramp over the number of its place says."""
    return items.withColumn("copies", (F.lit(low) + F.col("place") % (high - low + 1)).cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def usage_report(tests: DataFrame, counts: DataFrame) -> DataFrame:
    """Tested genes with their isoforms' ids and counts as lists, by change of usage from high to low."""
    u = isoform_usage(counts)
    lists = u.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("delta_pi")).alias("d"), "tx_id", "count_a", "count_b"))).alias("x"))
    joined = lambda c: F.array_join(F.transform("x", lambda x: x[c].cast("string")), ",")
    d = tests.join(lists, "gene_id")
    return d.select(*tests.columns, joined("tx_id").alias("isoforms"), F.array_join(F.transform("x", lambda x: x["count_a"].cast("long").cast("string")), ",").alias("counts_a"), F.array_join(F.transform("x", lambda x: x["count_b"].cast("long").cast("string")), ",").alias("counts_b"))


def consecutive_pairs(counts: DataFrame, order: str) -> DataFrame:
    """Counts (gene_id, tx_id, stage, n) of each stage beside those of the next one in the order of stages."""
    stages = counts.select(F.col(order).alias("stage_a")).distinct()
    steps = stages.withColumn("stage_b", F.lead("stage_a").over(Window.orderBy("stage_a"))).where("stage_b IS NOT NULL")  # a row for each stage
    a = counts.select("gene_id", "tx_id", F.col(order).alias("stage_a"), F.col("n").alias("count_a")).join(F.broadcast(steps), "stage_a")
    b = counts.select("gene_id", "tx_id", F.col(order).alias("stage_b"), F.col("n").alias("count_b")).join(F.broadcast(steps), "stage_b")
    d = a.join(b, ["gene_id", "tx_id", "stage_a", "stage_b"], "full")
    return d.fillna(0.0, ["count_a", "count_b"])


def expression_contrast(values: DataFrame, *, min_pct: float = 0.1, min_cells: int = 3) -> DataFrame:
    """(feature, pct_1, pct_2, avg_log2_fc) of two groups (grp 1 and 0), for features that enough cells express.

    The fold change is that of the means plus one. A feature needs ``min_cells`` cells in all, and ``min_pct`` of them
    in one group.
    """
    one, two = F.col("grp") == 1, F.col("grp") == 0
    d = values.groupBy("feature").agg(F.count_if(one).alias("n1"), F.count_if(two).alias("n2"), F.count_if(one & (F.col("value") > 0)).alias("k1"), F.count_if(two & (F.col("value") > 0)).alias("k2"), F.sum(F.when(one, F.col("value"))).alias("s1"), F.sum(F.when(two, F.col("value"))).alias("s2")).where("n1 > 0 AND n2 > 0")
    d = d.withColumns({"pct_1": F.col("k1") / F.col("n1"), "pct_2": F.col("k2") / F.col("n2")}).where((F.col("k1") + F.col("k2") >= min_cells) & (F.greatest("pct_1", "pct_2") >= min_pct))
    return d.select("feature", "pct_1", "pct_2", (F.log2(F.col("s1") / F.col("n1") + 1) - F.log2(F.col("s2") / F.col("n2") + 1)).alias("avg_log2_fc"))


@F.pandas_udf(T.DoubleType())
def normal_p(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Two-sided p-value of a z statistic."""
    for z in batches:
        yield z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))
