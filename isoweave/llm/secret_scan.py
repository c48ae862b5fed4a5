"""Secret scanning with fixed patterns and character Markov models, in DataFrame functions only.

Base patterns find assignments, access keys and hex runs. Then every run of 12 or more key-like characters is scored by
the log-likelihood ratio of two first-order character models, one of random strings and one of ordinary identifiers, both
trained from labelled samples. Runs whose summed ratio passes the odds against a secret, so that a short run needs as
much evidence as a long one, and that overlap no base span, become ``markov`` spans. A pair of characters counts once in
a run, as repeating it is a pattern.

The scan is one pass without a shuffle. The model is a table of 128 x 128 pairs whatever the input, so it travels in
the expression.

Edge cases: a null text is empty and gives no spans (digest of the empty string); a null id is carried; repeated rows are
scanned once each; spans that begin together stand in the order of the kinds; a very long text's matches are folded in
blocks; an empty table gives no rows; other columns are not read by ``scan_secrets`` and are kept as they are
by ``redact_secrets``.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name
from .spans import bind, match_spans, running, words_of

# The base patterns, their order and the least length of what they find.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: What the Markov models look at.
RUN = r"[A-Za-z0-9+/_=-]{12,}"
#: The sum of the log ratios of a run's distinct pairs has to pass the log of the odds against a secret, and more for
#: each pair.
LEAST_EVIDENCE, LEAST_MEAN = 10.0, 0.4
SPAN_TYPE = "array<struct<start:int,kind:int,end:int>>"


def random_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """(text, label 1): strings in the alphabets of keys and hashes, from a counter's digest."""
    s = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), F.sha2(F.concat(F.lit("k"), F.col("id").cast("string")), 512).alias("g"))
    kinds = F.array(F.col("h"), F.base64(F.unhex("h")), F.base64(F.unhex("g")), F.translate(F.upper(F.base64(F.unhex("g"))), "+/=", "XYZ"))
    return s.select(F.explode(kinds).alias("text"), F.lit(1).alias("label"))


def ordinary_samples(docs: DataFrame, labels: DataFrame | None, n_docs: int = 200) -> DataFrame:
    """(text, label 0): identifiers from the words of ``n_docs`` documents labelled as good, least hash first.

    Words are taken as they are and joined to their neighbour in the ways of ordinary identifiers. The number of
    documents is the bound of the sample; without labels no document is read.
    """
    spark = docs.sparkSession
    common = ["get_user_name", "maxRetryCount", "index.html", "content-type", "README", "HTTP_STATUS_CODE", "application/json", "background-color", "java/util/concurrent", "node_modules", "2024-01-31", "version=1", "user_id=12", "utf-8", "isReady", "name=content", "width=device-width", "charset=utf-8", "key=value", "content=width", "rel=stylesheet", "secret=token", "DatabaseConnectionFactory"]
    patterns = [c * 12 for c in string.ascii_letters + string.digits + "+/_=-"]
    # numbers, dates and times are not secrets
    numbers = [f"{(k * 2654435761) % 10**n:0{n}d}" for n in (4, 8, 12, 16) for k in range(1, 101)]
    dates = [f"20{y:02d}-{m:02d}-{d:02d}T{m + 8:02d}-{2 * d:02d}" for y in range(10, 30, 3) for m in range(1, 13, 2) for d in range(1, 29, 5)]
    fixed = spark.createDataFrame([(x, 0) for x in [*common, *patterns, *numbers, *dates]], "text string, label int")
    if labels is None:
        return fixed
    ids = [r[0] for r in labels.where("quality = 1").groupBy("doc_id").agg(F.lit(1).alias("one")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs).select("doc_id").collect()]
    words = docs.where(F.col("doc_id").isin(ids)).select(words_of(F.col("text")).alias("w"))
    plain = F.filter(F.transform("w", lambda x: F.regexp_replace(x, "[^A-Za-z0-9]", "")), lambda x: (F.length(x) > 1) & ~x.rlike("[0-9]"))
    words = words.select(plain.alias("w"))
    pair = F.transform("w", lambda x, i: F.coalesce(F.get(F.col("w"), i + 1), F.lit("x")))
    forms = F.concat("w", F.zip_with("w", pair, lambda a, b: F.concat(a, F.lit("_"), b)), F.zip_with("w", pair, lambda a, b: F.concat(a, F.initcap(b))), F.zip_with("w", pair, lambda a, b: F.concat(F.upper(a), F.lit("_"), F.upper(b))), F.zip_with("w", pair, lambda a, b: F.concat(a, F.lit("/"), b)))
    return fixed.unionByName(words.select(F.explode(forms).alias("text"), F.lit(0).alias("label")))


def train_markov(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log ratios, random over ordinary, of a character given the one before it; at 128 * before + after.

    At most 128 x 128 x 2 counts reach the driver, whatever the samples.
    """
    t = samples.where("text IS NOT NULL AND length(text) > 1").select("label", "text")
    pair = t.select("label", F.col("text"), F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("i"))
    codes = pair.select("label", F.ascii(F.expr("substring(text, i, 1)")).alias("a"), F.ascii(F.expr("substring(text, i + 1, 1)")).alias("b")).where("a < 128 AND b < 128 AND a > 0 AND b > 0")
    counts = {(r.label, r.a, r.b): r.n for r in codes.groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = {}
    for (label, a, _), n in counts.items():
        rows[label, a] = rows.get((label, a), 0) + n
    alphabet = 66

    def log_p(label: int, a: int, b: int) -> float:
        return math.log((counts.get((label, a, b), 0) + smoothing) / (rows.get((label, a), 0) + smoothing * alphabet))

    return [round(log_p(1, a, b) - log_p(0, a, b), 4) for a in range(128) for b in range(128)]


def _base(text: Column, kind: int) -> Column:
    """array<struct<start, kind, end>> of a base pattern; the text is searched for positions only if it holds one."""
    name = KINDS[kind]
    pattern, group = {"assign": (ASSIGN, 2), "access": (ACCESS, None), "hex": (HEX, None)}[name]
    gate = {"assign": ASSIGN.removesuffix("+)") + "{6})", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}[name]
    # every hex run of 24 and more, as the shorter ones are dropped anyway; a run is maximal, so none is cut
    used = r"[0-9a-f]{24,}" if name == "hex" else pattern
    kept = F.filter(match_spans(text, F.lit(used), group), lambda s: s["size"] >= LEAST[name])
    out = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    return F.when(text.rlike(gate), out).otherwise(F.expr(f"CAST(array() AS {SPAN_TYPE})"))


def _markov(text: Column, ratios: Sequence[float], least: float) -> Column:
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded to a literal

    def pairs(codes: Column) -> Column:
        return F.array_distinct(F.transform(F.slice(codes, 2, F.size(codes)), lambda b, i: F.get(codes, i) * 128 + b))

    def evidence(value: Column) -> Column:  # by an array of codes, as a long string's characters are slow to reach
        own = bind(F.transform(F.split(value, ""), lambda c: F.ascii(c)), pairs)
        return F.aggregate(own, F.lit(0.0), lambda acc, x: acc + F.get(table, x) - LEAST_MEAN)

    kept = F.filter(match_spans(text, F.lit(RUN)), lambda s: evidence(s["value"]) > least)
    out = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))
    return F.when(text.rlike(RUN), out).otherwise(F.expr(f"CAST(array() AS {SPAN_TYPE})"))


def secret_spans(text: Column, ratios: Sequence[float], least: float) -> Column:
    """struct(base, spans) of a text: arrays of struct(start, kind, end), by start, then kind."""

    def both(base: Column) -> Column:
        more = F.filter(_markov(text, ratios, least), lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))

    return bind(F.array_sort(F.concat(*[_base(text, k) for k in range(3)])), both)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, ratios: Sequence[float], least: float = LEAST_EVIDENCE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    found = docs.select("doc_id", secret_spans(F.coalesce(F.col("text").cast("string"), F.lit("")), ratios, least).alias("found"))

    def count(k: int) -> Column:
        return F.size(F.filter("found.base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("found.base")), 256).alias("base_sha256"), _joined(F.col("found.spans")).alias("spans"))


def redact_secrets(docs: DataFrame, ratios: Sequence[float], least: float = LEAST_EVIDENCE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span in ``text`` replaced by ``mark``; overlapping spans become one. n_chars follows the text."""
    name = free_name(docs, "found")
    found = docs.withColumn(name, secret_spans(F.coalesce("text", F.lit("")), ratios, least)["spans"])

    def step(at: Column, s: Column) -> Column:
        return F.greatest(at, s["end"])

    def piece(at: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), at + 1, s["start"] - at)
        return F.when(s["start"] >= at, F.concat(gap, F.lit(mark))).otherwise(F.lit(""))

    end = F.aggregate(name, F.lit(0), step)
    clean = F.concat(F.array_join(running(F.col(name), F.lit(0), step, piece, "string"), ""), F.substring(F.col("text"), end + 1, F.length("text")))
    changed = F.size(name) > 0
    text = F.when(changed, clean).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
