"""Registered queries: operators on projections of the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalar
from ..operators import assembly, classify, graph, intervals, paths, quantify, splice, statistics
from ..runtime import write_through
from .registry import query, r6

EM_ROUNDS = 5


def em_sql(rounds: int) -> str:
    """The estimate after some rounds of equal-weight expectation-maximization (gene_id, tx_id, all_reads), as CTEs."""
    out = "p0 AS (SELECT DISTINCT gene_id, tx_id, 1.0::DOUBLE AS p FROM tracking)"
    for k in range(1, rounds + 1):
        out += f""", e{k} AS (SELECT t.gene_id, t.tx_id, t.read_id, p / sum(p) OVER (PARTITION BY t.gene_id, t.read_id) AS f FROM tracking t JOIN p{k - 1} USING (gene_id, tx_id)),
        p{k} AS (SELECT gene_id, tx_id, sum(f) AS p FROM e{k} GROUP BY ALL)"""
    return out


@query(
    f"""WITH {em_sql(EM_ROUNDS)}, c AS (SELECT gene_id, tx_id, p AS all_reads FROM p{EM_ROUNDS}),
    n AS (SELECT gene_id, read_id, count(*) AS n, min(tx_id) AS tx_id FROM tracking GROUP BY 1, 2),
    u AS (SELECT gene_id, tx_id, count(*) AS u FROM n WHERE n = 1 GROUP BY 1, 2)
    SELECT c.gene_id, c.tx_id, coalesce(u, 0)::BIGINT AS uniq_reads, round(all_reads, 6) AS all_reads,
      round(all_reads / sum(all_reads) OVER (PARTITION BY c.gene_id), 6) AS isoform_fraction,
      round(coalesce(u, 0) / sum(all_reads) OVER (PARTITION BY c.gene_id), 6) AS unique_gene_read_fraction,
      round(all_reads / sum(all_reads) OVER () * 1e6, 4) AS tpm
    FROM c LEFT JOIN u USING (gene_id, tx_id)""",
    "tracking",
)
def expression_report(t: DataFrame) -> DataFrame:
    """Flagship: estimated counts, fractions and tpm of each transcript."""
    counts = quantify.em_per_gene(quantify.path_classes(t), alpha=0.0, max_iter=EM_ROUNDS, tolerance=0.0)
    d = quantify.expression_report(t, counts)
    return d.select("gene_id", "tx_id", F.col("uniq_reads").cast("long").alias("uniq_reads"), *[r6(c).alias(c) for c in ("all_reads", "isoform_fraction", "unique_gene_read_fraction")], F.round("tpm", 4).alias("tpm"))


@query(f"WITH {em_sql(EM_ROUNDS)} SELECT gene_id, tx_id, round(p, 6) AS all_reads FROM p{EM_ROUNDS}", "tracking")
def em_dataframe_rounds(t: DataFrame) -> DataFrame:
    """K3 without grouped Python."""
    return quantify.em_rounds(t, EM_ROUNDS).select("gene_id", "tx_id", r6("all_reads").alias("all_reads"))


@query(None, "tracking")
def em_to_convergence(t: DataFrame) -> DataFrame:
    """K3 with its production parameters; the number of rounds depends on convergence."""
    return quantify.estimate(write_through(quantify.path_classes(t), "classes"))


@query("SELECT gene_id, tx_id, read_id, 1.0 / count(*) OVER (PARTITION BY gene_id, read_id) AS frac FROM tracking", "tracking")
def equal_split(t: DataFrame) -> DataFrame:
    """K4."""
    return quantify.equal_split(t).select("gene_id", "tx_id", "read_id", "frac")


@query(
    """WITH d AS (SELECT read_id AS mp_id, tx_id, CAST(tx_id % 97 AS DOUBLE) + 50 AS d, count(*) OVER (PARTITION BY read_id) AS n FROM tracking),
    r AS (SELECT mp_id, tx_id, n, d, sum(d) OVER (PARTITION BY mp_id) AS s FROM d)
    SELECT mp_id, tx_id, CASE WHEN n = 1 THEN 1.0 ELSE round((s - d) / (s * (n - 1)), 6) END AS weight FROM r""",
    "tracking",
)
def end_weights(t: DataFrame) -> DataFrame:
    """K2."""
    return quantify.end_weights(t.select(F.col("read_id").alias("mp_id"), "tx_id", (F.col("tx_id") % 97).cast("double").alias("distance"))).select("mp_id", "tx_id", r6("weight").alias("weight"))


@query(None, "tracking")
def cross_gene_em(t: DataFrame) -> DataFrame:
    """Components of genes by shared reads, then one estimate for each component."""
    split = quantify.equal_split(t)
    counts = split.groupBy("gene_id", "tx_id").agg(F.sum("frac").alias("all_reads"))
    return quantify.cross_gene_em(split.select(*t.columns, "frac"), counts)


@query(
    """WITH s AS (SELECT gene_id, tx_id, 1.0 / count(*) OVER (PARTITION BY gene_id, read_id) AS f FROM tracking),
    c AS (SELECT gene_id, tx_id, sum(f) AS n FROM s GROUP BY 1, 2), m AS (SELECT gene_id, tx_id, 2 * n AS n FROM c)
    SELECT gene_id, tx_id, round(n, 6) AS all_reads, round(n / sum(n) OVER (PARTITION BY gene_id), 6) AS isoform_fraction, round(n / sum(n) OVER () * 1e6, 4) AS tpm FROM m""",
    "tracking",
)
def merge_expression(t: DataFrame) -> DataFrame:
    """Two shards."""
    c = quantify.equal_split(t).groupBy("gene_id", "tx_id").agg(F.sum("frac").alias("all_reads"))
    return quantify.merge_expression([c, c]).select("gene_id", "tx_id", r6("all_reads").alias("all_reads"), r6("isoform_fraction").alias("isoform_fraction"), F.round("tpm", 4).alias("tpm"))


SPLIT = "s AS (SELECT gene_id, tx_id, read_id, cell, 1.0::DOUBLE / count(*) OVER (PARTITION BY gene_id, read_id) AS f FROM tracking)"


@query(
    f"""WITH {SPLIT} SELECT 'gene' AS level, CAST(gene_id AS VARCHAR) AS feature_id, cell, round(sum(f), 6) AS value FROM s GROUP BY gene_id, cell
    UNION ALL SELECT 'isoform', CAST(tx_id AS VARCHAR), cell, round(sum(f), 6) FROM s GROUP BY tx_id, cell""",
    "tracking",
)
def cell_feature_counts(t: DataFrame) -> DataFrame:
    """E10."""
    return quantify.feature_counts(quantify.equal_split(t)).select("level", "feature_id", "cell", r6("value").alias("value"))


@query("WITH o AS (SELECT read_id, min(tx_id) AS tx_id, min(cell) AS cell FROM tracking GROUP BY 1 HAVING min(tx_id) = max(tx_id)) SELECT tx_id, cell, count(*) AS n_reads FROM o GROUP BY 1, 2", "tracking")
def unique_pattern_cell_counts(t: DataFrame) -> DataFrame:
    """E11."""
    return quantify.unique_pattern_counts(t)


@query(
    f"""WITH {SPLIT}, g AS (SELECT gene_id, tx_id, cluster, sum(f) AS n FROM s JOIN cells USING (cell) GROUP BY 1, 2, 3)
    SELECT gene_id, tx_id, round(coalesce(sum(n) FILTER (cluster = 'c0'), 0), 6) AS c0, round(coalesce(sum(n) FILTER (cluster = 'c1'), 0), 6) AS c1, round(coalesce(sum(n) FILTER (cluster = 'c2'), 0), 6) AS c2 FROM g GROUP BY 1, 2""",
    "tracking", "cells",
)
def cluster_pseudobulk(t: DataFrame, c: DataFrame) -> DataFrame:
    """E12, D15, B9."""
    d = quantify.pseudobulk(quantify.equal_split(t), c, ["c0", "c1", "c2"])
    return d.select("gene_id", "tx_id", *[r6(x).alias(x) for x in ("c0", "c1", "c2")])


@query(
    f"""WITH {SPLIT}, n AS (SELECT gene_id, tx_id, cell, sum(f) AS n FROM s GROUP BY 1, 2, 3), z AS (SELECT cluster, count(*) AS z FROM cells GROUP BY 1)
    SELECT gene_id, tx_id, cluster, round(count(*) FILTER (n >= 0.5) / CAST(any_value(z) AS DOUBLE), 6) AS fraction FROM n JOIN cells USING (cell) JOIN z USING (cluster) GROUP BY 1, 2, 3""",
    "tracking", "cells",
)
def cell_detection_fraction(t: DataFrame, c: DataFrame) -> DataFrame:
    """E13."""
    return quantify.detection_fraction(quantify.equal_split(t), c).withColumn("fraction", r6("fraction"))


@query(
    """WITH r AS (SELECT gene_id, read_id, count(*) AS n FROM tracking GROUP BY 1, 2)
    SELECT gene_id, count(*) AS n_reads, count(*) FILTER (n > 1) AS n_ambiguous, round(count(*) FILTER (n > 1) / CAST(count(*) AS DOUBLE), 6) AS share FROM r GROUP BY ROLLUP (gene_id)""",
    "tracking",
)
def assignment_audit(t: DataFrame) -> DataFrame:
    """E18, B13."""
    return quantify.assignment_audit(t).withColumn("share", r6("share"))


@query("SELECT l_orderkey AS read_id, l_suppkey % 10 AS gene_id, l_suppkey AS tx_id, max(l_quantity) AS read_weight FROM lineitem GROUP BY 1, 2, 3", "lineitem")
def dedupe_tracking(d: DataFrame) -> DataFrame:
    """G2."""
    return quantify.dedupe_tracking(d.select(F.col("l_orderkey").alias("read_id"), (F.col("l_suppkey") % 10).alias("gene_id"), F.col("l_suppkey").alias("tx_id"), F.col("l_quantity").alias("read_weight")))


@query(
    """WITH i AS (SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',') AS ids FROM lineitem GROUP BY 1), x AS (SELECT unnest(string_split(ids, ',')) AS id, 1.0::DOUBLE / len(string_split(ids, ',')) AS f FROM i)
    SELECT id, round(sum(f), 6) AS "count" FROM x GROUP BY 1""",
    "lineitem",
)
def fractional_counts(d: DataFrame) -> DataFrame:
    """E15."""
    lists = d.groupBy("l_orderkey").agg(F.array_join(F.collect_set(F.col("l_suppkey").cast("string")), ",").alias("ids"))
    return quantify.fractional_counts(lists).withColumn("count", r6("count"))


def _bins(value: str, bounds: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {b} THEN {float(b)}::DOUBLE" for b in reversed(bounds[1:])) + f" ELSE {float(bounds[0])}::DOUBLE END"


@query(f"SELECT {_bins('p_retailprice * 3', [0, 500, 1000, 2000, 3000, 5000])} AS length_bin, {_bins('p_size', [0, 0.25, 1, 4, 16, 64, 256])} AS tpm_bin, count(*) AS n FROM part GROUP BY 1, 2", "part")
def length_tpm_bins(p: DataFrame) -> DataFrame:
    """E19."""
    return quantify.length_tpm_bins(p.select((F.col("p_retailprice") * 3).alias("length"), F.col("p_size").cast("double").alias("tpm")))


@query("SELECT median(o_totalprice / (o_custkey + 1)) AS scale FROM orders", "orders")
def rpm_scale(o: DataFrame) -> DataFrame:
    """K6."""
    return quantify.rpm_scale(o.select(F.col("o_totalprice").alias("rpm"), (F.col("o_custkey") + 1).alias("all_reads")))


@query(None, "tracking")
def filter_isoforms(t: DataFrame) -> DataFrame:
    """C14: iterative minimum isoform fraction."""
    return quantify.filter_isoforms(quantify.path_classes(t), min_fraction=0.09)


# --- intervals


@query(
    """SELECT a.piece_id, count(*) AS n_exons, CAST(sum(least(a.rend, b.rend) - greatest(a.lend, b.lend) + 1) AS BIGINT) AS overlap
    FROM pieces a JOIN exons b ON a.contig = b.contig AND a.strand = b.strand AND a.lend <= b.rend AND a.rend >= b.lend GROUP BY 1""",
    "pieces", "exons",
)
def overlap_join(p: DataFrame, e: DataFrame) -> DataFrame:
    """D1, D2, D20, N4."""
    e = e.select("contig", "strand", F.col("lend").alias("lend2"), F.col("rend").alias("rend2"))
    return intervals.interval_join(p, e).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n_exons"), F.sum("overlap").alias("overlap"))


@query("SELECT piece_id FROM pieces a WHERE EXISTS (SELECT 1 FROM exons b WHERE a.contig = b.contig AND a.strand <> b.strand AND a.lend <= b.rend AND a.rend >= b.lend)", "pieces", "exons")
def antisense_overlap(p: DataFrame, e: DataFrame) -> DataFrame:
    """D12."""
    flipped = e.select("contig", F.when(F.col("strand") == "O", "F").otherwise("O").alias("strand"), F.col("lend").alias("lend2"), F.col("rend").alias("rend2"))
    return intervals.interval_join(p, flipped, how="left_semi").select("piece_id")


@query(
    """SELECT piece_id FROM pieces a WHERE NOT EXISTS (SELECT 1 FROM exons b WHERE a.contig = b.contig AND a.strand = b.strand AND a.lend <= b.rend AND a.rend >= b.lend
      AND 2 * (least(a.rend, b.rend) - greatest(a.lend, b.lend) + 1) >= a.rend - a.lend + 1)""",
    "pieces", "exons",
)
def masked_reads(p: DataFrame, e: DataFrame) -> DataFrame:
    """C8."""
    d = p.select(F.col("piece_id").alias("read_id"), "contig", "strand", "lend", "rend")
    return intervals.masked_reads(d, e).select(F.col("read_id").alias("piece_id"))


ISLANDS = """m AS (SELECT *, max(rend) OVER (PARTITION BY contig, strand ORDER BY lend, rend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {0}),
    n AS (SELECT *, sum(CASE WHEN lend - reach <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY contig, strand ORDER BY lend, rend ROWS UNBOUNDED PRECEDING) AS k FROM m)"""
RUNS = """v AS (SELECT contig, strand, pos, sum(s) AS s FROM (SELECT contig, strand, lend AS pos, 1 AS s FROM {0} UNION ALL SELECT contig, strand, rend + 1, -1 FROM {0}) GROUP BY 1, 2, 3),
    w AS (SELECT contig, strand, pos AS lend, lead(pos) OVER (PARTITION BY contig, strand ORDER BY pos) - 1 AS rend, sum(s) OVER (PARTITION BY contig, strand ORDER BY pos) AS c FROM v),
    runs AS (SELECT contig, strand, lend, rend, CAST(c AS BIGINT) AS coverage FROM w WHERE c > 0 AND rend >= lend)"""


@query(f"WITH {ISLANDS.format('pieces')} SELECT contig, strand, min(lend) AS lend, max(rend) AS rend, count(*) AS n_merged FROM n GROUP BY contig, strand, k", "pieces")
def merge_intervals(p: DataFrame) -> DataFrame:
    """N5."""
    return intervals.merge_intervals(p)


@query(f"WITH {RUNS.format('pieces')} SELECT * FROM runs", "pieces")
def coverage_runs(p: DataFrame) -> DataFrame:
    """E1."""
    return intervals.coverage_runs(p)


@query(
    f"""WITH {RUNS.format('pieces')} SELECT e.contig, e.strand, e.lend, e.rend, round(coalesce(sum(coverage * (least(e.rend, r.rend) - greatest(e.lend, r.lend) + 1)), 0) / CAST(e.rend - e.lend + 1 AS DOUBLE), 6) AS mean_coverage
    FROM exons e LEFT JOIN runs r ON e.contig = r.contig AND e.strand = r.strand AND e.lend <= r.rend AND e.rend >= r.lend GROUP BY e.contig, e.strand, e.lend, e.rend""",
    "pieces", "exons",
)
def mean_coverage(p: DataFrame, e: DataFrame) -> DataFrame:
    """E2."""
    e = e.withColumn("id", F.concat_ws("|", "contig", "strand", "lend", "rend"))
    return e.join(intervals.mean_coverage(e, intervals.coverage_runs(p), id_col="id"), "id").select("contig", "strand", "lend", "rend", r6("mean_coverage").alias("mean_coverage"))


@query(
    f"""WITH {ISLANDS.format('pieces')}, i AS (SELECT contig, strand, min(lend) AS a, max(rend) AS b FROM n GROUP BY contig, strand, k),
    p AS (SELECT DISTINCT contig, strand, pos FROM (SELECT contig, strand, lend AS pos FROM pieces UNION ALL SELECT contig, strand, rend + 1 FROM pieces)),
    q AS (SELECT contig, strand, pos AS lend, lead(pos) OVER (PARTITION BY contig, strand ORDER BY pos) - 1 AS rend FROM p)
    SELECT q.contig, q.strand, lend, rend FROM q JOIN i ON q.contig = i.contig AND q.strand = i.strand AND lend >= a AND rend <= b""",
    "pieces",
)
def exon_segments(e: DataFrame) -> DataFrame:
    """H3, H18."""
    return intervals.exon_segments(e)


OWN = """g AS (SELECT DISTINCT contig, strand, tx_id, lend, rend FROM pieces), m AS (SELECT *, max(rend) OVER (PARTITION BY contig, strand, tx_id ORDER BY lend, rend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
    n AS (SELECT *, sum(CASE WHEN lend - reach <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY contig, strand, tx_id ORDER BY lend, rend ROWS UNBOUNDED PRECEDING) AS k FROM m),
    x AS (SELECT contig, strand, tx_id, min(lend) AS lend, max(rend) AS rend FROM n GROUP BY contig, strand, tx_id, k)"""


@query(
    f"""WITH {OWN} SELECT a.tx_id, b.tx_id AS tx_id_2, CAST(sum(least(a.rend, b.rend) - greatest(a.lend, b.lend) + 1) AS BIGINT) AS overlap
    FROM x a JOIN x b ON a.contig = b.contig AND a.strand = b.strand AND a.tx_id < b.tx_id AND a.lend <= b.rend AND a.rend >= b.lend GROUP BY 1, 2""",
    "pieces",
)
def pair_overlap(p: DataFrame) -> DataFrame:
    """D8."""
    return intervals.pair_overlap(p, "tx_id")


@query(
    f"""WITH {OWN}, o AS (SELECT a.piece_id, x.tx_id, sum(least(a.rend, x.rend) - greatest(a.lend, x.lend) + 1) AS o FROM pieces a JOIN x ON a.contig = x.contig AND a.strand = x.strand AND a.lend <= x.rend AND a.rend >= x.lend GROUP BY 1, 2)
    SELECT piece_id, tx_id, CAST(o AS BIGINT) AS overlap FROM o QUALIFY row_number() OVER (PARTITION BY piece_id ORDER BY o DESC, tx_id) = 1""",
    "pieces",
)
def best_overlap(p: DataFrame) -> DataFrame:
    """D18, K10."""
    reads = p.select(F.col("piece_id").alias("read_id"), "contig", "strand", "lend", "rend")
    return intervals.best_overlap(reads, p).select(F.col("read_id").alias("piece_id"), "tx_id", "overlap")


@query(
    """WITH s AS (SELECT contig, strand, lend AS site, count(*) AS support FROM pieces GROUP BY 1, 2, 3 HAVING count(*) > 4),
    h AS (SELECT piece_id, s.contig || s.strand || site AS site_id, abs(rend - site) AS distance, support FROM pieces p JOIN s ON p.contig = s.contig AND p.strand = s.strand AND site BETWEEN rend - 25 AND rend + 25)
    SELECT piece_id, site_id, distance FROM h QUALIFY row_number() OVER (PARTITION BY piece_id ORDER BY distance, support DESC, site_id) = 1""",
    "pieces",
)
def nearest_site(p: DataFrame) -> DataFrame:
    """D3."""
    s = p.groupBy("contig", "strand", F.col("lend").alias("site")).agg(F.count(F.lit(1)).alias("support")).where("support > 4").withColumn("site_id", F.concat("contig", "strand", F.col("site").cast("string")))
    points = p.select(F.col("piece_id").alias("point_id"), "contig", "strand", F.col("rend").alias("pos"))
    return intervals.nearest_site(points, s).select(F.col("point_id").alias("piece_id"), "site_id", "distance")


GAPS = """x AS (SELECT DISTINCT contig, strand, tx_id, lend, rend FROM pieces), e AS (SELECT DISTINCT contig, strand, lend, rend FROM pieces),
    i AS (SELECT DISTINCT contig, strand, rend + 1 AS lend, nxt - 1 AS rend FROM (SELECT *, lead(lend) OVER (PARTITION BY contig, strand, tx_id ORDER BY lend, rend) AS nxt FROM x) WHERE nxt > rend + 1)"""


def named(d: DataFrame, kind: str) -> DataFrame:
    return d.withColumn("node_id", F.concat(F.lit(kind), F.concat_ws("-", "contig", "strand", "lend", "rend")))


def introns_between(p: DataFrame) -> DataFrame:
    """The distinct gaps to a transcript's next piece."""
    # a copy of a piece is followed by itself, which is no gap
    nxt = F.lead("lend").over(Window.partitionBy("contig", "strand", "tx_id").orderBy("lend", "rend"))
    return p.select("contig", "strand", "tx_id", "lend", "rend").withColumn("nxt", nxt).where("nxt > rend + 1").select("contig", "strand", (F.col("rend") + 1).alias("lend"), (F.col("nxt") - 1).alias("rend")).distinct()


def gaps_of(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pieces, and the gaps to a transcript's next piece as introns; both with a node_id."""
    return named(p.select("contig", "strand", "lend", "rend").distinct(), "E:"), named(introns_between(p), "I:")


@query(
    f"""WITH {GAPS}, en AS MATERIALIZED (SELECT 'E:' || concat_ws('-', contig, strand, lend, rend) AS node, * FROM e), ni AS MATERIALIZED (SELECT 'I:' || concat_ws('-', contig, strand, lend, rend) AS node, * FROM i),
    pairs AS (SELECT a.node AS src, b.node AS dst FROM en a JOIN en b ON a.contig = b.contig AND a.strand = b.strand AND a.rend + 1 = b.lend
      UNION ALL SELECT a.node, b.node FROM en a JOIN ni b ON a.contig = b.contig AND a.strand = b.strand AND a.rend + 1 = b.lend
      UNION ALL SELECT a.node, b.node FROM ni a JOIN en b ON a.contig = b.contig AND a.strand = b.strand AND a.rend + 1 = b.lend) SELECT src, dst FROM pairs""",
    "pieces",
)
def adjacency(p: DataFrame) -> DataFrame:
    """Between all pieces, and between pieces and the gaps beside them."""
    return intervals.adjacency(*gaps_of(p))


@query("SELECT piece_id, lend, rend FROM pieces WHERE contig = 'A' AND strand = 'F' AND lend <= 9000 AND rend >= 5000", "pieces")
def region_rows(p: DataFrame) -> DataFrame:
    """C23, A17."""
    return intervals.in_region(p, "A", 5000, 9000, strand="F").select("piece_id", "lend", "rend")


# --- alignments, introns and sites

OPS = "o AS (SELECT read_id, contig, strand, pos, flag, mapq, nm, cigar, list_transform(regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1), lambda x: CAST(x AS INT)) AS n, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2) AS k FROM alignments)"
BLOCKS = f"""{OPS}, u AS (SELECT read_id, contig, strand, pos, unnest(range(1, len(n) + 1)) AS i, n, k FROM o),
    b AS (SELECT read_id, contig, strand, i, k[i] AS op, n[i] AS m, pos + coalesce(list_sum(list_transform(range(1, i), lambda j: CASE WHEN list_contains(['M', '=', 'X', 'D', 'N'], k[j]) THEN n[j] ELSE 0 END)), 0) AS lend FROM u),
    f AS (SELECT read_id, contig, strand, i, CAST(lend AS BIGINT) AS lend, CAST(lend + m - 1 AS BIGINT) AS rend FROM b WHERE op IN ('M', '=', 'X', 'D')),
    g AS (SELECT *, CASE WHEN lend - lag(rend) OVER (PARTITION BY read_id ORDER BY i) < 10 THEN 0 ELSE 1 END AS fresh FROM f),
    h AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS seg FROM g),
    segs AS (SELECT read_id, contig, strand, seg, min(lend) AS lend, max(rend) AS rend FROM h GROUP BY ALL)"""


@query(f"WITH {BLOCKS} SELECT read_id, CAST(seg AS BIGINT) AS seg, lend, rend FROM segs", "alignments")
def exon_segments_of_alignments(a: DataFrame) -> DataFrame:
    """A2, A3."""
    d = splice.pretty_alignments(a).select("read_id", F.posexplode("segments").alias("seg", "s"))
    return d.select("read_id", (F.col("seg") + 1).cast("long").alias("seg"), F.col("s.lend").cast("long").alias("lend"), F.col("s.rend").cast("long").alias("rend"))


INTRONS = "introns AS (SELECT read_id, contig, strand, rend + 1 AS lend, lead(lend) OVER (PARTITION BY read_id ORDER BY seg) - 1 AS rend FROM segs)"


@query(f"WITH {BLOCKS}, {INTRONS} SELECT contig, strand, lend, rend, count(*) AS support FROM introns WHERE rend IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2", "alignments")
def intron_support(a: DataFrame) -> DataFrame:
    """A4, E3."""
    return splice.intron_support(splice.pretty_alignments(a)).select("contig", "strand", F.col("lend").cast("long").alias("lend"), F.col("rend").cast("long").alias("rend"), "support")


@query(
    f"""WITH {BLOCKS}, {INTRONS}, s AS (SELECT contig, strand, lend, rend, count(*) AS support FROM introns WHERE rend IS NOT NULL GROUP BY 1, 2, 3, 4),
    l AS (SELECT *, support / sum(support) OVER (PARTITION BY contig, strand, lend) AS x FROM s), m AS (SELECT *, support / sum(support) OVER (PARTITION BY contig, strand, rend) AS y FROM l WHERE x >= 0.2)
    SELECT contig, strand, lend, rend, support FROM m WHERE y >= 0.2""",
    "alignments",
)
def shared_boundary_prune(a: DataFrame) -> DataFrame:
    """H6."""
    i = splice.intron_support(splice.pretty_alignments(a), least=1).withColumn("is_ref", F.lit(False))
    return splice.prune_alternative_introns(i, min_share=0.2).select("contig", "strand", F.col("lend").cast("long").alias("lend"), F.col("rend").cast("long").alias("rend"), "support")


@query(
    f"""WITH {OPS}, q AS (SELECT *, coalesce(list_sum(list_transform(list_filter(range(1, len(n) + 1), lambda i: k[i] = 'M'), lambda i: n[i])), 0) AS m FROM o),
    z AS (SELECT *, CASE WHEN m > 0 THEN m ELSE list_sum(list_transform(list_filter(range(1, len(n) + 1), lambda i: k[i] IN ('=', 'X')), lambda i: n[i])) END AS al FROM q)
    SELECT read_id, CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN mapq < 1 THEN 'min_mapping_quality' WHEN flag & 1 <> 0 AND flag & 2 = 0 THEN 'improper_pair' WHEN flag & 1024 <> 0 THEN 'duplicate' WHEN flag & 512 <> 0 THEN 'qcfail'
      WHEN flag & 256 <> 0 THEN 'secondary' WHEN flag & 2048 <> 0 THEN 'supplementary' WHEN 100.0 - nm / CAST(al AS DOUBLE) * 100.0 < 80 THEN 'low_perID' END AS reason FROM z""",
    "alignments",
)
def discard_reasons(a: DataFrame) -> DataFrame:
    """C1, C2."""
    return a.select("read_id", splice.discard_reason(min_mapq=1, secondary=False).alias("reason"))


@query(
    """SELECT read_id, coalesce(TRY_CAST(regexp_extract(cigar, '^(\\d+)S', 1) AS BIGINT), 0) AS left_clip, coalesce(TRY_CAST(regexp_extract(cigar, '(\\d+)S$', 1) AS BIGINT), 0) AS right_clip FROM alignments""",
    "alignments",
)
def soft_clips(a: DataFrame) -> DataFrame:
    """N10."""
    left, right = scalar.soft_clips(F.col("cigar"))
    return a.select("read_id", left.cast("long").alias("left_clip"), right.cast("long").alias("right_clip"))


@query("SELECT contig, strand, pos, n, CAST(sum(n) OVER (PARTITION BY contig, strand ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS BIGINT) AS window_total FROM sites", "sites")
def site_window_totals(s: DataFrame) -> DataFrame:
    """F1 (bound)."""
    return splice.window_totals(s)


@query(None, "sites")
def aggregate_sites(s: DataFrame) -> DataFrame:
    """greedy peaks."""
    return splice.aggregate_sites(s)


@query(
    """WITH w AS (SELECT *, list(n) OVER (PARTITION BY contig, strand ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 49 FOLLOWING) AS l FROM sites),
    r AS (SELECT *, list_sort(list_concat(l, [0, 0])) AS s FROM w), x AS (SELECT *, list_concat(s[1 : list_position(s, n) - 1], s[list_position(s, n) + 1 :]) AS z FROM r)
    SELECT contig, strand, pos, n FROM x WHERE (n + 1) / (list_median(z) + 1) >= 2""",
    "sites",
)
def peak_sites(s: DataFrame) -> DataFrame:
    """C19."""
    return splice.peak_sites(s, ratio=2.0)


@query("WITH c AS (SELECT contig, strand, pos // 600 AS component, pos, n FROM sites), s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY contig, component) AS DOUBLE) AS x FROM c) SELECT contig, component, pos, n FROM s WHERE x >= 0.05", "sites")
def low_share_sites(s: DataFrame) -> DataFrame:
    """C20, C21."""
    d = s.withColumn("bin", F.floor(F.col("pos") / 600)).withColumn("component", F.concat_ws("|", "contig", "bin"))
    return splice.low_share_sites(d).select("contig", F.col("bin").alias("component"), "pos", "n")


@query(
    """WITH a AS (SELECT l_orderkey AS read, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS ordinal, l_quantity AS as_score, l_discount * 10 AS ms, l_tax AS nm_rate, l_partkey AS longest FROM lineitem),
    p AS (SELECT * FROM a WHERE ordinal = 1), s AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY as_score DESC, ordinal) AS r FROM a WHERE ordinal > 1)
    SELECT read, ordinal FROM p UNION ALL SELECT s.read, s.ordinal FROM s JOIN p USING (read) WHERE s.nm_rate - p.nm_rate <= 0 AND ((s.ms - p.ms > -0.5 AND r = 1) OR (s.ms - p.ms <= -0.5 AND s.nm_rate - p.nm_rate <= -0.005 AND log2((s.longest + 1) / (p.longest + 1)) > 0.03))""",
    "lineitem",
)
def rescue_secondary(d: DataFrame) -> DataFrame:
    """C9, F3."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")
    a = d.select(F.col("l_orderkey").alias("read"), F.row_number().over(w).cast("long").alias("ordinal"), F.col("l_quantity").alias("as_score"), (F.col("l_discount") * 10).alias("ms"), F.col("l_tax").alias("nm_rate"), F.col("l_partkey").alias("longest_intron"))
    return splice.rescue_secondary(a.withColumn("flag", F.when(F.col("ordinal") == 1, 0).otherwise(256))).select("read", "ordinal")


@query(
    """WITH g AS (SELECT o_orderkey AS read, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders WHERE o_orderstatus <> 'F'), t AS (SELECT l_orderkey AS read, max(l_extendedprice) * 3 AS y FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
    SELECT coalesce(g.read, t.read) AS read, CASE WHEN t.read IS NULL THEN 'genome' WHEN g.read IS NULL OR x IS NULL OR y > x THEN 'transcriptome' ELSE 'genome' END AS source FROM g FULL JOIN t ON g.read = t.read""",
    "orders", "lineitem",
)
def arbitrate(o: DataFrame, d: DataFrame) -> DataFrame:
    """D21."""
    g = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("read"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("identity"))
    t = d.where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("read")).agg((F.max("l_extendedprice") * 3).alias("identity"))
    return splice.arbitrate(g, t)


@query(None, "alignments")
def normalize_coverage(a: DataFrame) -> DataFrame:
    """The sample hangs on a hash that SQL engines don't share."""
    return splice.normalize_coverage(a.withColumnRenamed("read_id", "read_name"), most=10).select("read_name", "contig", "strand", "pos")


# --- paths and graphs


@query(
    """WITH i AS (SELECT tx_id, list_sort(list(intron)) AS p FROM chains GROUP BY 1), n AS (SELECT tx_id, len(p) AS n FROM i)
    SELECT a.tx_id, b.tx_id AS tx_id_2 FROM (SELECT a.tx_id AS x, b.tx_id AS y, count(*) AS k FROM chains a JOIN chains b USING (intron) WHERE a.tx_id <> b.tx_id GROUP BY 1, 2) c JOIN n b ON c.y = b.tx_id AND c.k = b.n JOIN n a ON c.x = a.tx_id""",
    "chains",
)
def splice_subsets(c: DataFrame) -> DataFrame:
    """D22, K11."""
    return paths.subset_pairs(c)


EVENT_PATHS = "e AS (SELECT user_id % 500 AS read_id, list(event_type ORDER BY event_id) AS path, min(event_id) AS lend, max(event_id) AS rend FROM events GROUP BY user_id % 500, event_id // 500)"


def event_paths(e: DataFrame) -> DataFrame:
    d = e.groupBy((F.col("user_id") % 500).alias("read_id"), F.floor(F.col("event_id") / 500).alias("b")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("s"), F.min("event_id").alias("lend"), F.max("event_id").alias("rend"))
    return d.select("read_id", F.transform("s", lambda x: x["event_type"]).alias("path"), "lend", "rend")


@query(f"WITH {EVENT_PATHS} SELECT array_to_string(path, '>') AS path, count(DISTINCT read_id) AS n_reads, min(lend) AS lend, max(rend) AS rend FROM e GROUP BY 1", "events")
def path_counts(e: DataFrame) -> DataFrame:
    """E5, E21."""
    return paths.count_paths(event_paths(e)).withColumn("path", F.array_join("path", ">"))


@query(
    """WITH n AS (SELECT DISTINCT l_suppkey AS gene_id, l_partkey AS node FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS path_id, l_partkey AS node FROM lineitem),
    s AS (SELECT path_id, gene_id, count(*) AS shared FROM p JOIN n USING (node) GROUP BY 1, 2) SELECT path_id, gene_id, shared FROM s QUALIFY rank() OVER (PARTITION BY path_id ORDER BY shared DESC) = 1""",
    "lineitem",
)
def gene_anchors(d: DataFrame) -> DataFrame:
    """D5, F13."""
    p = d.groupBy(F.col("l_orderkey").alias("path_id")).agg(F.collect_set("l_partkey").alias("path"))
    t = d.groupBy(F.col("l_suppkey").alias("gene_id")).agg(F.collect_set("l_partkey").alias("path"))
    return paths.best_anchors(p, t)


@query("SELECT min(l_orderkey) AS first_tx, l_partkey AS pattern, CAST(l_returnflag AS VARCHAR) AS contig, l_suppkey % 10 AS gene_id, min(l_linenumber)::BIGINT AS lend, max(l_linenumber)::BIGINT AS rend, count(*) AS n_members FROM lineitem GROUP BY ALL", "lineitem")
def collapse_patterns(d: DataFrame) -> DataFrame:
    """E17."""
    return paths.collapse_patterns(d.select(F.col("l_returnflag").alias("contig"), (F.col("l_suppkey") % 10).alias("gene_id"), F.col("l_partkey").alias("pattern"), F.col("l_orderkey").alias("tx_id"), F.col("l_linenumber").cast("long").alias("lend"), F.col("l_linenumber").cast("long").alias("rend")))


@query("SELECT l_partkey AS pattern, count(DISTINCT l_suppkey % 10) AS n_genes FROM lineitem GROUP BY 1 HAVING n_genes > 1", "lineitem")
def pattern_conflicts(d: DataFrame) -> DataFrame:
    """E17."""
    return paths.pattern_conflicts(d.select(F.col("l_partkey").alias("pattern"), (F.col("l_suppkey") % 10).alias("gene_id")))


@query(
    """WITH RECURSIVE l AS (SELECT c_custkey AS a, c_custkey + c_nationkey % 3 AS b FROM customer WHERE c_nationkey % 3 <> 0), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r(vertex, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.vertex, e.b FROM r JOIN e ON r.seen = e.a)
    SELECT vertex, min(seen) AS component FROM r GROUP BY 1""",
    "customer",
)
def components(c: DataFrame) -> DataFrame:
    """Each customer is linked to one that follows, by a step that hangs on the nation; a step of 0 is no link."""
    return graph.connected_components(c.select(F.col("c_custkey").alias("u"), (F.col("c_custkey") + F.col("c_nationkey") % 3).alias("v")))


@query("SELECT component, path_id, n_reads, length FROM (SELECT l_suppkey AS component, l_orderkey AS path_id, count(*) AS n_reads, CAST(sum(l_quantity) AS DOUBLE) AS length FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY component ORDER BY n_reads DESC, length DESC, path_id) <= 20", "lineitem")
def top_paths(d: DataFrame) -> DataFrame:
    """C27."""
    p = d.groupBy(F.col("l_suppkey").alias("component"), F.col("l_orderkey").alias("path_id")).agg(F.count(F.lit(1)).alias("n_reads"), F.sum("l_quantity").alias("length"))
    return graph.top_paths(p, limit=20)


@query("WITH c AS (SELECT p_size AS component, p_partkey AS path_id, p_retailprice AS length FROM part) SELECT component, path_id, length FROM c WHERE component IN (SELECT component FROM c GROUP BY 1 HAVING max(length) >= 1500)", "part")
def drop_small_components(p: DataFrame) -> DataFrame:
    """C28."""
    return graph.drop_small_components(p.select(F.col("p_size").alias("component"), F.col("p_partkey").alias("path_id"), F.col("p_retailprice").alias("length")), min_length=1500)


# --- statistics

CHI = """t AS (SELECT *, sum(count_a) OVER w AS ta, sum(count_b) OVER w AS tb, count(*) OVER w AS n_iso FROM usage WHERE count_a > 0 OR count_b > 0 WINDOW w AS (PARTITION BY gene_id)),
    d AS (SELECT *, count_b / tb - count_a / ta AS delta, row_number() OVER (PARTITION BY gene_id ORDER BY count_a + count_b DESC, tx_id) AS top FROM t),
    k AS (SELECT gene_id, count_a, count_b, sum(count_a) OVER w AS xa, sum(count_b) OVER w AS xb, count(*) OVER w AS n FROM d WHERE top <= 10 WINDOW w AS (PARTITION BY gene_id)),
    x AS (SELECT *, (count_a + count_b) * xa / (xa + xb) AS ea, (count_a + count_b) * xb / (xa + xb) AS eb FROM k),
    c AS (SELECT gene_id, sum((count_a - ea) * (count_a - ea) / ea + (count_b - eb) * (count_b - eb) / eb) AS chi2, count(*) - 1 AS dof FROM x GROUP BY 1),
    u AS (SELECT gene_id, delta, row_number() OVER (PARTITION BY gene_id ORDER BY delta DESC, tx_id) AS ru, row_number() OVER (PARTITION BY gene_id ORDER BY delta, tx_id) AS rd FROM d),
    g AS (SELECT gene_id, coalesce(sum(delta) FILTER (ru <= 2 AND delta > 0), 0) AS delta_up, coalesce(sum(delta) FILTER (rd <= 2 AND delta < 0), 0) AS delta_down FROM u GROUP BY 1)"""


@query(
    f"""WITH {CHI} SELECT gene_id, round(delta_up, 6) AS delta_up, round(delta_down, 6) AS delta_down, CASE WHEN delta_up > 0.01 OR -delta_down > 0.01 THEN 'tested' ELSE 'small_change' END AS status,
    CASE WHEN delta_up > 0.01 OR -delta_down > 0.01 THEN round(chi2, 6) END AS chi2 FROM g JOIN c USING (gene_id)""",
    "usage",
)
def differential_usage(u: DataFrame) -> DataFrame:
    """L1, L2 without the p-value."""
    return statistics.differential_usage(u, min_delta=0.01).select("gene_id", r6("delta_up").alias("delta_up"), r6("delta_down").alias("delta_down"), "status", r6("chi2").alias("chi2"))


@query(None, "usage")
def differential_usage_p(u: DataFrame) -> DataFrame:
    """L1-L4 with p-values (a special function that SQL lacks), adjusted over all genes."""
    d = statistics.differential_usage(u, min_delta=0.01).withColumn("p_value", statistics.chi2_p("chi2", "dof"))
    d = statistics.benjamini_hochberg(d)
    return d.withColumn("significant", statistics.significant(d))


@query("WITH t AS (SELECT *, sum(count_a) OVER w AS ta, sum(count_b) OVER w AS tb FROM usage WINDOW w AS (PARTITION BY gene_id)) SELECT gene_id, tx_id, round(count_a / ta, 6) AS pi_a, round(count_b / tb, 6) AS pi_b, round(count_b / tb - count_a / ta, 6) AS delta_pi FROM t WHERE ta > 0 AND tb > 0", "usage")
def isoform_usage(u: DataFrame) -> DataFrame:
    """L1."""
    return statistics.isoform_usage(u).select("gene_id", "tx_id", *[r6(c).alias(c) for c in ("pi_a", "pi_b", "delta_pi")])


@query("SELECT a.cluster AS cluster_a, b.cluster AS cluster_b, gene_id, tx_id, coalesce(x.n, 0) AS count_a, coalesce(y.n, 0) AS count_b FROM (SELECT DISTINCT cluster FROM clustered) a JOIN (SELECT DISTINCT cluster FROM clustered) b ON a.cluster < b.cluster CROSS JOIN (SELECT DISTINCT gene_id, tx_id FROM clustered) t LEFT JOIN clustered x USING (gene_id, tx_id) LEFT JOIN clustered y USING (gene_id, tx_id) WHERE x.cluster = a.cluster AND y.cluster = b.cluster AND (x.n > 0 OR y.n > 0)", "clustered")
def cluster_pairs(c: DataFrame) -> DataFrame:
    """L3."""
    index = c.select("cluster").distinct().withColumn("k", F.row_number().over(Window.orderBy("cluster")))
    d = statistics.cluster_pairs(c, index)
    return d.where("count_a > 0 AND count_b > 0")


@query(
    """WITH p AS (SELECT o_orderkey AS id, round(((o_orderkey * 7919) % 1000 + 1) / 1000.0, 3)::DOUBLE AS p_value FROM orders), r AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p_value) + count(*) OVER (PARTITION BY p_value) - 1 AS k FROM p)
    SELECT id, p_value, round(least(1.0, min(p_value * m / k) OVER (ORDER BY p_value DESC)), 6) AS adj_p_value FROM r""",
    "orders",
)
def benjamini_hochberg(o: DataFrame) -> DataFrame:
    """F5."""
    p = o.select(F.col("o_orderkey").alias("id"), F.round(((F.col("o_orderkey") * 7919) % 1000 + 1) / 1000, 3).alias("p_value"))
    return statistics.benjamini_hochberg(p).select("id", "p_value", r6("adj_p_value").alias("adj_p_value"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY count_a DESC, tx_id) AS a, row_number() OVER (PARTITION BY gene_id ORDER BY count_b DESC, tx_id) AS b FROM usage) SELECT gene_id, tx_id, count_a, count_b FROM r WHERE a <= 2 OR b <= 2", "usage")
def top_isoforms(u: DataFrame) -> DataFrame:
    """F4."""
    return statistics.top_isoforms(u)


@query("WITH f AS (SELECT *, n / sum(n) OVER (PARTITION BY gene_id, cluster) AS f FROM clustered) SELECT gene_id, cluster, tx_id, round(f, 6) AS fraction FROM f QUALIFY row_number() OVER (PARTITION BY gene_id, cluster ORDER BY f DESC, tx_id) = 1", "clustered")
def dominant_isoform(c: DataFrame) -> DataFrame:
    """F9, E7."""
    f = c.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("gene_id", "cluster")))
    return statistics.dominant_isoform(f).withColumn("fraction", r6("fraction"))


@query(
    """WITH x AS (SELECT tx_id, cluster, n / sum(n) OVER (PARTITION BY cluster) * 1e6 AS x FROM clustered), p AS (SELECT *, x / sum(x) OVER (PARTITION BY tx_id) AS p, row_number() OVER (PARTITION BY tx_id ORDER BY x, cluster) + 6 - count(*) OVER (PARTITION BY tx_id) AS r FROM x WHERE x > 0)
    SELECT tx_id, round(-sum(p * log2(p)), 6) AS entropy, round(-sum(p * log2(p)) / log2(6), 6) AS entropy_norm, round(log2(6) + sum(p * log2(p)), 6) AS kl_uniform, round(1 - sum(p * p), 6) AS simpson,
      round(2 * sum(r * p) / 6 - 7 / 6, 6) AS gini, round((6 - sum(x) / max(x)) / 5, 6) AS tau, round(max(p), 6) AS max_fraction FROM p GROUP BY 1""",
    "clustered",
)
def expression_breadth(c: DataFrame) -> DataFrame:
    """L5."""
    d = statistics.breadth(c, 6)
    return d.select("tx_id", *[r6(x).alias(x) for x in d.columns[1:]])


@query("WITH f AS (SELECT user_id, min(event_id) AS o FROM events GROUP BY 1), m AS (SELECT o // greatest(1, CAST(ceil(((SELECT max(event_id) FROM events) + 1) / 100.0) AS BIGINT)) AS mark, count(*) AS n_new FROM f GROUP BY 1) SELECT mark, n_new, CAST(sum(n_new) OVER (ORDER BY mark) AS BIGINT) AS n_seen FROM m", "events")
def first_seen_curve(e: DataFrame) -> DataFrame:
    """F6."""
    return statistics.first_seen_curve(e.select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("id")))


@query(
    """WITH v AS (SELECT l_suppkey AS feature, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS g, l_quantity AS x FROM lineitem),
    t AS (SELECT feature, x, count(*) AS t, sum(g) AS k FROM v GROUP BY 1, 2), r AS (SELECT *, sum(t) OVER (PARTITION BY feature ORDER BY x) - (t - 1) / 2.0 AS r FROM t),
    s AS (SELECT feature, sum(k * r) AS w, sum(k) AS n1, sum(t) AS n, sum(t * t * t - t) AS ties FROM r GROUP BY 1)
    SELECT feature, round((w - n1 * (n + 1) / 2) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM s WHERE n1 > 0 AND n1 < n""",
    "lineitem",
)
def rank_sum(d: DataFrame) -> DataFrame:
    """L8."""
    v = d.select(F.col("l_suppkey").alias("feature"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("grp"), F.col("l_quantity").alias("value"))
    return statistics.rank_sum(v).withColumn("z", r6("z"))


@query(
    """WITH q AS (SELECT l_suppkey AS path_id, list_sort(list(l_partkey)) AS l, len(list(l_partkey)) AS n FROM lineitem GROUP BY 1), h AS (SELECT *, 0.9::DOUBLE * (n + 1) AS hr, 0.1::DOUBLE * (n + 1) AS hl FROM q),
    k AS (SELECT *, greatest(1, least(CAST(floor(hr) AS BIGINT), n - 1)) AS kr, greatest(1, least(CAST(floor(round(hl, 9)) AS BIGINT), n - 1)) AS kl FROM h)
    SELECT path_id, round(l[kl] + (hl - kl) * (l[kl + 1] - l[kl]), 4) AS lend, round(l[kr] + (hr - kr) * (l[kr + 1] - l[kr]), 4) AS rend FROM k""",
    "lineitem",
)
def boundary_estimate(d: DataFrame) -> DataFrame:
    """F2."""
    e = splice.boundary_estimate(d.select(F.col("l_suppkey").alias("path_id"), F.col("l_partkey").alias("lend"), F.col("l_partkey").alias("rend")))
    return e.select("path_id", F.round("lend", 4).alias("lend"), F.round("rend", 4).alias("rend"))


@query("WITH r AS (SELECT p_partkey AS item, unnest(range(1, 2 + p_partkey % 5)) AS copy FROM part) SELECT item, CAST(copy AS BIGINT) AS copy FROM r", "part")
def expression_ramp(p: DataFrame) -> DataFrame:
    """L12."""
    return statistics.expression_ramp(p.select(F.col("p_partkey").alias("item"), F.col("p_partkey").alias("place"))).select("item", F.col("copy").cast("long").alias("copy"))


# --- classification and scalars


def chain_tables(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = splice.pretty_alignments(a).select("read_id", "contig", "strand", "segments", "introns", "mapq")
    return d.withColumnRenamed("read_id", "feature_id"), d.where("mapq >= 50").withColumnRenamed("read_id", "tx_id")


CATEGORIES = f"""{BLOCKS}, {INTRONS}, q AS (SELECT DISTINCT read_id FROM alignments WHERE mapq >= 50),
    i AS (SELECT read_id, contig, strand, lend, rend FROM introns WHERE rend IS NOT NULL), ri AS (SELECT i.* FROM i JOIN q USING (read_id)),
    c AS (SELECT read_id, contig, strand, ',' || string_agg(lend || ':' || rend, ',' ORDER BY lend) || ',' AS chain, min(lend) AS l, arg_min(rend, lend) AS r FROM i GROUP BY 1, 2, 3),
    rc AS (SELECT DISTINCT contig, strand, chain FROM c JOIN q USING (read_id)), rx AS (SELECT DISTINCT i.contig, i.strand, i.lend, i.rend, c.chain FROM i JOIN q USING (read_id) JOIN c USING (read_id)),
    s AS (SELECT read_id, contig, strand, count(*) AS n, min(lend) AS lend, max(rend) AS rend FROM segs GROUP BY 1, 2, 3), rs AS (SELECT s.* FROM s JOIN q USING (read_id)),
    re AS (SELECT DISTINCT g.contig, g.strand, g.lend, g.rend, n = 1 AS single FROM segs g JOIN rs USING (read_id)),
    site AS (SELECT DISTINCT contig, strand, 'l' AS side, lend AS pos FROM ri UNION SELECT DISTINCT contig, strand, 'r', rend FROM ri),
    e AS (SELECT read_id, contig, strand, 'l' AS side, lend AS pos FROM i UNION ALL SELECT read_id, contig, strand, 'r', rend FROM i),
    k AS (SELECT read_id, count(site.pos) = count(*) AS all_known, count(site.pos) > 0 AS any_known FROM e LEFT JOIN site USING (contig, strand, side, pos) GROUP BY 1),
    fsm AS (SELECT read_id FROM c SEMI JOIN rc USING (contig, strand, chain)),
    ism AS (SELECT DISTINCT read_id FROM c JOIN rx ON c.contig = rx.contig AND c.strand = rx.strand AND c.l = rx.lend AND c.r = rx.rend WHERE contains(rx.chain, c.chain)),
    genic AS (SELECT DISTINCT g.read_id FROM segs g JOIN re ON g.contig = re.contig AND g.strand = re.strand AND g.lend <= re.rend AND g.rend >= re.lend),
    one AS (SELECT s.read_id, bool_or(single AND least(s.rend, re.rend) - greatest(s.lend, re.lend) + 1 >= 0.9 * (re.rend - re.lend + 1)) AS fm, bool_or(single) AS im, bool_or(s.lend >= re.lend AND s.rend <= re.rend) AS exonic
        FROM s JOIN re ON s.contig = re.contig AND s.strand = re.strand AND s.lend <= re.rend AND s.rend >= re.lend WHERE n = 1 GROUP BY 1),
    intronic AS (SELECT DISTINCT s.read_id FROM s JOIN (SELECT DISTINCT contig, strand, lend, rend FROM ri) x ON s.contig = x.contig AND s.strand = x.strand AND s.lend <= x.rend AND s.rend >= x.lend),
    antisense AS (SELECT DISTINCT s.read_id FROM s JOIN (SELECT DISTINCT contig, strand, lend, rend FROM rs) x ON s.contig = x.contig AND s.strand <> x.strand AND s.lend <= x.rend AND s.rend >= x.lend)
    SELECT read_id AS feature_id, CASE WHEN n = 1 THEN CASE WHEN one.fm THEN 'se_FM' WHEN one.im THEN 'se_IM' WHEN one.exonic THEN 'se_exonic' WHEN read_id IN (FROM genic) THEN 'se_genic' WHEN read_id IN (FROM intronic) THEN 'se_intronic' WHEN read_id IN (FROM antisense) THEN 'se_antisense' ELSE 'se_intergenic' END
      ELSE CASE WHEN read_id IN (FROM fsm) THEN 'FSM' WHEN read_id IN (FROM ism) THEN 'ISM' WHEN all_known THEN 'NIC' WHEN any_known THEN 'NNIC' WHEN read_id IN (FROM genic) THEN 'genic' WHEN read_id IN (FROM intronic) THEN 'intronic' WHEN read_id IN (FROM antisense) THEN 'antisense' ELSE 'intergenic' END END AS category
    FROM s LEFT JOIN one USING (read_id) LEFT JOIN k USING (read_id)"""


@query(f"WITH {CATEGORIES}", "alignments")
def structural_categories(a: DataFrame) -> DataFrame:
    """M1, D9-D12; the reference is what is mapped best."""
    return classify.classify(*chain_tables(a))


@query("WITH n AS (SELECT l_returnflag AS grp, l_linestatus AS category, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT grp, category, n, round(n / CAST(sum(n) OVER (PARTITION BY grp) AS DOUBLE), 6) AS fraction FROM n", "lineitem")
def category_summary(d: DataFrame) -> DataFrame:
    """B19."""
    return classify.category_summary(d.select(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("category")), ["grp"]).withColumn("fraction", r6("fraction"))


@query("WITH m AS (SELECT l_orderkey AS query, l_suppkey AS target, l_linenumber AS priority, l_partkey * 100000 + l_suppkey AS line FROM lineitem WHERE l_returnflag <> 'R') SELECT query, target FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY priority, line) = 1", "lineitem")
def choose_symbol(d: DataFrame) -> DataFrame:
    """D13, D14."""
    return classify.choose_symbol(d.select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("priority"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("line"), F.when(F.col("l_returnflag") == "R", "s").otherwise("=").alias("class_code")))


@query("SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') AS token, CASE WHEN p_retailprice = 0 THEN 0 ELSE round(p_retailprice * pow(10, 2 - floor(log10(abs(p_retailprice))))) / pow(10, 2 - floor(log10(abs(p_retailprice)))) END AS price3 FROM part", "part")
def tokens_and_figures(p: DataFrame) -> DataFrame:
    """N6, N8."""
    return p.select("p_partkey", scalar.safe_token(F.col("p_name")).alias("token"), scalar.sig_figs(F.col("p_retailprice"), 3).alias("price3"))


@query(f"WITH {BLOCKS}, {INTRONS}, s AS (SELECT read_id, contig, strand, string_agg('(' || lend || ', ' || rend || ')', ', ' ORDER BY lend) AS i FROM introns WHERE rend IS NOT NULL GROUP BY 1, 2, 3) SELECT read_id, md5(contig || ':(' || strand || ')[' || i || ']') AS chain_md5 FROM s", "alignments")
def splice_strings(a: DataFrame) -> DataFrame:
    """N2 (by MD5, which SQL has)."""
    d = splice.pretty_alignments(a).where(F.size("introns") > 0)
    return d.select("read_id", F.md5(scalar.intron_string(F.col("contig"), F.col("strand"), F.col("introns"))).alias("chain_md5"))


@query(None, "alignments")
def splice_hashes(a: DataFrame) -> DataFrame:
    """BLAKE2s of each distinct chain."""
    d = splice.pretty_alignments(a).where(F.size("introns") > 0)
    chains = d.select(scalar.intron_string(F.col("contig"), F.col("strand"), F.col("introns")).alias("chain")).groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    return chains.select("chain", "n", scalar.splice_hash("chain").alias("splice_hash"))


@query(None, "alignments")
def discover_isoforms(a: DataFrame) -> DataFrame:
    """Both passes and their filters; greedy, so without SQL."""
    d = splice.pretty_alignments(a).select("read_id", "contig", "strand", "segments", "introns")
    return assembly.discover(d, Config(min_transcript_length=30))


@query(None, "alignments")
def trellis_isoforms(a: DataFrame) -> DataFrame:
    """The chains that the trellis takes from the spliced reads' paths, with their reads; tested against all chains."""
    reads = splice.pretty_alignments(a).select("read_id", "contig", "strand", "segments", "introns").where(F.size("introns") > 0)
    d = assembly.assemble(write_through(reads, "spliced-reads"), Config(), label="m")
    return d.select("tx_id", "gene_id", "contig", "strand", F.size("path").alias("n_nodes"), "n_reads", F.array_join("path", ",").alias("path"))


@query(
    f"WITH {BLOCKS}, {INTRONS}, c AS (SELECT contig, strand, lend, rend, read_id, right(read_id, 1) AS s FROM introns WHERE rend IS NOT NULL) SELECT contig, strand, lend, rend, count(*) FILTER (s < '4') AS a, count(*) FILTER (s >= '4') AS b FROM c GROUP BY 1, 2, 3, 4",
    "alignments",
)
def intron_matrix(a: DataFrame) -> DataFrame:
    """A21, E16."""
    x = splice.pretty_alignments(a).select("contig", "strand", F.when(F.col("read_id").substr(-1, 1) < "4", "a").otherwise("b").alias("sample"), F.explode("introns").alias("i"))
    n = x.groupBy("contig", "strand", F.col("i.lend").cast("long").alias("lend"), F.col("i.rend").cast("long").alias("rend"), "sample").agg(F.count(F.lit(1)).alias("support"))
    return assembly.intron_matrix(n, ["a", "b"])


@query(f"WITH {BLOCKS}, {INTRONS}, i AS (SELECT read_id, contig, strand, string_agg(lend || '-' || rend, ',' ORDER BY lend) AS chain FROM introns WHERE rend IS NOT NULL GROUP BY 1, 2, 3), s AS (SELECT read_id, min(lend) AS l, max(rend) AS r FROM segs GROUP BY 1) SELECT contig, strand, min(l) AS lend, max(r) AS rend, count(*) AS n_sources, chain FROM i JOIN s USING (read_id) GROUP BY contig, strand, chain", "alignments")
def merge_catalogs(a: DataFrame) -> DataFrame:
    """I15, B14, B17."""
    t = splice.pretty_alignments(a).select(F.when(F.col("mapq") < 30, "x").otherwise("y").alias("source"), F.col("read_id").alias("tx_id"), "contig", "strand", F.col("segments").alias("exons"))
    m = assembly.splice_patterns(assembly.merge_catalogs(t))
    chain = F.array_join(F.transform("introns", lambda i: F.concat_ws("-", i["lend"], i["rend"])), ",")
    return m.select("contig", "strand", F.element_at("exons", 1)["lend"].cast("long").alias("lend"), F.element_at("exons", -1)["rend"].cast("long").alias("rend"), F.col("n_sources").cast("long").alias("n_sources"), chain.alias("chain"))


@query("WITH g AS (SELECT DISTINCT l_orderkey AS read_id, l_partkey AS node FROM lineitem), n AS (SELECT node, count(*) AS n FROM g GROUP BY 1) SELECT read_id, CAST(sum(n) AS BIGINT) AS weight, count(*) AS n_nodes FROM g JOIN n USING (node) GROUP BY 1", "lineitem")
def node_support(d: DataFrame) -> DataFrame:
    """Reads behind each path's nodes."""
    g = d.select(F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("node")).distinct()
    n = g.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return g.join(n, "node").groupBy("read_id").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("n_nodes"))


@query("""SELECT p_partkey, reverse(translate(upper(p_name), 'ACGT', 'TGCA')) AS rc, (length(p_name) >= 7 AND length(regexp_replace(upper(p_name), '[^A]', '', 'g')) >= 0.2 * length(p_name)) AS poly, sha256('{"p_name":"' || p_name || '","p_size":' || p_size || '}') AS digest FROM part""", "part")
def sequence_functions(p: DataFrame) -> DataFrame:
    """C6, K8, N12."""
    return p.select("p_partkey", scalar.reverse_complement(F.upper("p_name")).alias("rc"), scalar.is_poly(F.col("p_name"), share=0.2).alias("poly"), scalar.stable_digest(F.col("p_name"), F.col("p_size")).alias("digest"))
