"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path() -> str:
    """The word-level vocabulary's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back."""
    from .warc import archive_round_trip

    back = archive_round_trip(table(spark, sf_dir, "pages"))
    return back.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_page FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_page THEN first_page END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by dictionaries that are trained on labels outside the held-out fold."""
    from .compress_quality import score_quality, train_on

    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, train_on(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document."""
    from .host_rules import judge

    return judge(table(spark, sf_dir, "documents"))


_RULES = ("base", "symbols", "lines", "letters")
OP6_SQL = r"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM i),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + k AS p FROM r CROSS JOIN range(8) AS o(k)) GROUP BY 1),
m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base, 10 * n_symbols > n_words AS symbols,
        10 * n_dup_lines > 3 * n_lines AS lines, word_chars < 2 * n_words OR word_chars > 20 * n_words AS letters FROM m),
h AS (SELECT host, count(*)::DOUBLE AS n, {sums} FROM f WHERE host IS NOT NULL GROUP BY 1),
p AS (SELECT {moments} FROM h),
v AS (SELECT host, greatest({rates}) > 0.5 AS host_failed FROM h CROSS JOIN p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
  NOT base AND NOT coalesce(host_failed, false) AS kept FROM f LEFT JOIN v USING (host)
""".replace("\\\\", "\\").format(
    sums=", ".join(f"sum(CAST({r} AS INT)) AS {r}" for r in _RULES),
    moments=", ".join(f"avg({r} / n) AS m_{r}, CASE WHEN var_pop({r} / n) > 0 THEN least(1000, greatest(1, avg({r} / n) * (1 - avg({r} / n)) / var_pop({r} / n) - 1)) ELSE 1000 END AS w_{r}" for r in _RULES),
    rates=", ".join(f"({r} + m_{r} * w_{r}) / (n + w_{r})" for r in _RULES),
)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    from .decontamination import find_contained

    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 1, item_id, text FROM benchmark WHERE text IS NOT NULL),
l AS (SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM w),
s AS (SELECT DISTINCT kind, id, unnest(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS g FROM l WHERE len(w) > 0),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY 1),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.g = i.g AND d.kind = 0 AND i.kind = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / CAST(n_item AS DOUBLE) AS containment
FROM c JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
""".replace("\\\\", "\\")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the models are trained on generated keys and the words of good documents."""
    from .secret_scan import ordinary_samples, random_samples, scan_secrets, train_markov

    docs = table(spark, sf_dir, "documents")
    samples = random_samples(spark).unionByName(ordinary_samples(docs, table(spark, sf_dir, "labels")))
    return scan_secrets(docs, train_markov(samples))


def held_out(key: str = "doc_id") -> Column:
    """The rows whose labels are not learned from: crc32 of the id as text, mod 5, is 0."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a field that is trained on labels outside the held-out fold."""
    from .crf import score_toxicity, train_on

    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, train_on(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each rebuilt on the first turns of its hundred's first conversation."""
    from .prefix_trie import build_trie, share_first_turns, turns_of

    return build_trie(share_first_turns(turns_of(table(spark, sf_dir, "conversations"))))


OP11_SQL = """
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) % 6 AS h
        FROM (SELECT DISTINCT c FROM own) CROSS JOIN crc),
rebuilt AS (SELECT ids.c, o.i, o.role, o.text FROM ids JOIN own o ON o.c = ids.c - ids.c % 100 AND o.i <= h
            UNION ALL SELECT ids.c, o.i, o.role, o.text FROM ids JOIN own o ON o.c = ids.c AND o.i > h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, role, text FROM rebuilt),
whole AS (SELECT ids.c, coalesce(list({'role': role, 'text': text} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS turns FROM ids LEFT JOIN placed USING (c) GROUP BY 1),
steps AS (SELECT c, d, CAST(len(turns) AS BIGINT) AS n_turns, CAST(turns[1 : d] AS VARCHAR) || '#' || list_reduce(list_prepend('', list_transform(turns[1 : d], lambda x: length(x.role) || ',' || length(x.text) || ';')), lambda a, b: a || b) AS k,
          CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS size FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM whole)),
nodes AS (SELECT k, min(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n_turns), '')) AS ends_sha256 FROM steps GROUP BY 1),
links AS (SELECT DISTINCT a.k, b.k AS child FROM steps a JOIN steps b ON a.c = b.c AND b.d = a.d + 1),
kids AS (SELECT k, count(*) AS n_children, FROM links GROUP BY 1),
above AS (SELECT DISTINCT a.k, b.k AS under FROM steps a JOIN steps b ON a.c = b.c AND b.d >= a.d),
totals AS (SELECT above.k, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.size) AS BIGINT) AS saved_tokens FROM above JOIN nodes n ON n.k = under LEFT JOIN kids ON kids.k = under GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN totals USING (k) LEFT JOIN kids USING (k) LEFT JOIN links l ON l.child = n.k LEFT JOIN nodes p ON p.k = l.k
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors by Elkan's Lloyd rounds."""
    from .vector_codes import digest, encode, with_label_errors

    coded, books = encode(table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_NEAREST = """
n{r} AS MATERIALIZED (SELECT i, p, any_value(v) AS v, min(d * 16 + e) // 16 AS error, min(d * 16 + e) % 16 AS e FROM (
  SELECT x.i, x.p, x.v, b.e, CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda k: (x.v[k] - b.v[k]) * (x.v[k] - b.v[k]))) AS HUGEINT) AS d FROM x JOIN b{r} AS b USING (p)) GROUP BY 1, 2)"""
_REPLACED = """
b{s} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} AS b LEFT JOIN (
  SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY k) AS v FROM (
    SELECT p, e, k, sum(c) AS total, count(*) AS n FROM (SELECT p, e, unnest(range(1, len(v) + 1)) AS k, unnest(v) AS c FROM n{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2) AS m USING (p, e))"""
OP12_SQL = """
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT i, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS v FROM kept CROSS JOIN range(8) AS r(p)),
b0 AS MATERIALIZED (SELECT p, i AS e, v FROM x WHERE i < 16),{rounds},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6),
coded AS (SELECT i, string_agg(printf('%02x', CAST(e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error FROM n6 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (i) CROSS JOIN books
""".replace("{rounds}", ",".join((_NEAREST + "," + _REPLACED).format(r=r, s=r + 1) if r < 6 else _NEAREST.format(r=r) for r in range(7)))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from all documents outside the held-out fold."""
    from .language_spans import label_languages, train

    docs = table(spark, sf_dir, "documents")
    out = label_languages(docs, train(docs.where(~held_out())))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_html": op5_html,
    "op6_host_rules": op6_host_rules,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_licenses": op10_licenses,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_language": op13_language,
}

ORACLE_SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op6_host_rules": OP6_SQL, "op7_decontamination": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_vector_codes": OP12_SQL}
