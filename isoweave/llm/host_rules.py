"""Host-level quality rules, in DataFrame functions only.

Each document is measured from its whole text. For each rule, failures are summed by host (the domain, here
``source``), the host's failure rate is shrunk by a beta prior that is fitted to all hosts by moments, and a host whose
shrunk rate for any rule passes a limit is rejected. Verdicts are joined back to the documents.

Measures are made once and written to the shared folder without the text. Sums by host are partial aggregates, and the
join back is one whose hot side Spark can split, so a host with a third of all rows is no burden. A few numbers for
each rule (the prior) reach the driver.

Edge cases: a null text has no words and fails the base rule; documents with a null host get no host verdict; repeated
rows count and come back once each; null ids are carried; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .spans import BLANK, words_of

#: Words of a window, and the base limits.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Rules whose failures are counted by host; conditions on the measures.
RULES = {
    "base": f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "letters": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}


def measure(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A window's words are repeated if its hash occurs twice in the text: windows are sorted by hash with their position,
    those equal to a neighbour are put back in order, and each adds the words up to the next one.
    """
    t = docs.select("doc_id", F.col(host_col).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = t.withColumn("w", words_of(F.col("t")))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0)
    d = d.select(
        "doc_id", "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    spots = F.sequence(F.lit(0), F.size("h") - WINDOW)
    window = F.transform(spots, lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(WINDOW)]))
    d = d.withColumn("g", F.when(F.size("h") >= WINDOW, window))
    repeats = F.size(F.array_distinct("g")) < F.size("g")
    d = d.withColumn("s", F.when(repeats, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twin = F.filter("s", lambda x, i: (x["x"] == F.get(F.col("s"), i + 1)["x"]) | (x["x"] == F.get(F.col("s"), F.when(i > 0, i - 1))["x"]))
    d = d.withColumn("p", F.sort_array(F.transform(twin, lambda x: x["i"])))
    steps = F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), i + 1) - x, F.lit(WINDOW))).cast("long"))
    return d.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def host_verdicts(measures: DataFrame, limit: float = 0.5) -> DataFrame:
    """host, host_failed, and each rule's shrunk failure rate (rate_<rule>).

    The prior's mean is the mean of the hosts' rates and its weight follows from their variance; with too little
    variance the weight is held at 1000 documents, with too much at 1.
    """
    fails = [F.sum(F.expr(f"CAST({rule} AS BIGINT)")).alias(name) for name, rule in RULES.items()]
    hosts = measures.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *fails)
    hosts = materialize(hosts, "hosts")
    moments = hosts.agg(*[f(F.col(r) / F.col("n")).alias(f"{k}_{r}") for r in RULES for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    rates = []
    for r in RULES:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        weight = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
        rates.append(((F.col(r) + F.lit(m * weight)) / (F.col("n") + F.lit(weight))).alias(f"rate_{r}"))
    out = hosts.select("host", *rates)
    return out.withColumn("host_failed", F.greatest(*[F.col(f"rate_{r}") for r in RULES], F.lit(0.0)) > limit)


def judge(docs: DataFrame, host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """The measures of every row with base_failed and kept."""
    measures = materialize(measure(docs, host_col), "measures")
    verdicts = host_verdicts(measures, limit).select("host", "host_failed")
    out = measures.join(verdicts, "host", "left")
    failed = F.expr(RULES["base"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.coalesce("host_failed", F.lit(False))).alias("kept"))
