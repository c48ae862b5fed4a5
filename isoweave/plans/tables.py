"""Registered queries: counts, statistics and table operations (sections B, D, E, G, J and L of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import intervals, quantify, statistics
from .catalog import CHI, SPLIT
from .registry import query, r6


@query(
    f"""WITH {CHI}, f AS (SELECT gene_id, tx_id, count_a, count_b, delta FROM d WHERE ta > 0 AND tb > 0), l AS (SELECT gene_id, string_agg(tx_id, ',' ORDER BY delta DESC, tx_id) AS isoforms, string_agg(CAST(count_a AS BIGINT), ',' ORDER BY delta DESC, tx_id) AS counts_a, string_agg(CAST(count_b AS BIGINT), ',' ORDER BY delta DESC, tx_id) AS counts_b FROM f GROUP BY 1)
    SELECT gene_id, CASE WHEN n_iso < 2 THEN 'single_isoform' WHEN delta_up > 0.01 OR -delta_down > 0.01 THEN 'tested' ELSE 'small_change' END AS status, isoforms, counts_a, counts_b FROM g JOIN l USING (gene_id) JOIN (SELECT gene_id, any_value(n_iso) AS n_iso FROM t GROUP BY 1) USING (gene_id)""",
    "usage",
)
def usage_report(u: DataFrame) -> DataFrame:
    """B15."""
    tests = statistics.differential_usage(u, min_reads=1, min_delta=0.01).select("gene_id", "status")
    return statistics.usage_report(tests, u)


@query(
    f"""WITH {SPLIT}, k AS (SELECT read_id, gene_id, tx_id, cell, CASE WHEN tx_id > 50 THEN f / 2 ELSE f END AS frac FROM s) SELECT gene_id, tx_id, round(sum(frac), 6) AS all_reads, round(sum(frac) / sum(sum(frac)) OVER (PARTITION BY gene_id), 6) AS isoform_fraction, round(sum(frac) / sum(sum(frac)) OVER () * 1e6, 4) AS tpm FROM k GROUP BY 1, 2""",
    "tracking",
)
def corrected_expression(t: DataFrame) -> DataFrame:
    """Reads of the later transcripts get half their fraction."""
    d = quantify.equal_split(t)
    fixes = d.where("tx_id > 50").select("read_id", "gene_id", "tx_id", (F.col("frac") / 2).alias("new_frac"))
    _, e = quantify.corrected_tables(d, fixes)
    return e.select("gene_id", "tx_id", r6("all_reads").alias("all_reads"), r6("isoform_fraction").alias("isoform_fraction"), F.round("tpm", 4).alias("tpm"))


@query(f"WITH {SPLIT} SELECT read_id, gene_id, tx_id, round(CASE WHEN tx_id > 50 THEN f / 2 ELSE f END, 6) AS frac FROM s", "tracking")
def corrected_tracking(t: DataFrame) -> DataFrame:
    """B16, D17."""
    d = quantify.equal_split(t)
    fixes = d.where("tx_id > 50").select("read_id", "gene_id", "tx_id", (F.col("frac") / 2).alias("new_frac"))
    return quantify.corrected_tables(d, fixes)[0].select("read_id", "gene_id", "tx_id", r6("frac").alias("frac"))


@query("SELECT c.gene_id, c.tx_id, c.cluster, c.n, coalesce(round(x.fraction, 6), 0) AS fraction FROM clustered c LEFT JOIN (SELECT l_suppkey % 10 AS gene_id, l_suppkey AS tx_id, l_linestatus || l_returnflag AS cluster, avg(l_discount) AS fraction FROM lineitem WHERE l_quantity > 49 GROUP BY l_suppkey, l_linestatus, l_returnflag) x USING (gene_id, tx_id, cluster)", "clustered", "lineitem")
def cluster_fractions(c: DataFrame, d: DataFrame) -> DataFrame:
    """D16."""
    own = d.where("l_quantity > 49").groupBy((F.col("l_suppkey") % 10).alias("gene_id"), F.col("l_suppkey").alias("tx_id"), F.concat("l_linestatus", "l_returnflag").alias("cluster")).agg(F.avg("l_discount").alias("fraction"))
    return quantify.cluster_fractions(c, own).withColumn("fraction", r6("fraction"))


@query(
    """WITH r AS (SELECT l_orderkey AS id, list(l_suppkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS l FROM lineitem GROUP BY 1), u AS (SELECT id, unnest(l) AS tx_id, generate_subscripts(l, 1) AS p FROM r)
    SELECT id, string_agg(tx_id, ',' ORDER BY p) AS ids, string_agg(CASE WHEN s_acctbal IS NULL THEN 'N/A' ELSE 'h' || s_suppkey END, ',' ORDER BY p) AS codes FROM u LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 3000) ON tx_id = s_suppkey GROUP BY 1""",
    "lineitem", "supplier",
)
def listed_codes(d: DataFrame, s: DataFrame) -> DataFrame:
    """D23."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber"))), lambda x: x["l_suppkey"].cast("string")), ",")
    rows = d.groupBy(F.col("l_orderkey").alias("id")).agg(ids.alias("ids"))
    codes = s.where("s_acctbal > 3000").select(F.col("s_suppkey").cast("string").alias("tx_id"), F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("code"))
    return quantify.listed_codes(rows, codes, "ids")


@query("SELECT event_type AS process, count(*) AS n_samples, max(value) AS peak_memory, round(avg(value), 6) AS mean_memory, max(user_id) AS peak_load, round(avg(user_id), 6) AS mean_load, max(event_id) - min(event_id) AS duration FROM events GROUP BY 1", "events")
def resource_summary(e: DataFrame) -> DataFrame:
    """E20."""
    d = quantify.resource_summary(e.select(F.col("event_type").alias("process"), F.col("event_id").alias("seconds"), F.col("value").alias("memory"), F.col("user_id").alias("load")))
    return d.withColumns({"mean_memory": r6("mean_memory"), "mean_load": r6("mean_load")})


@query("SELECT DISTINCT gene_id, tx_id FROM tracking", "tracking")
def id_map(t: DataFrame) -> DataFrame:
    """G5."""
    return quantify.id_map(t, "gene_id", "tx_id")


@query("SELECT n_name AS contig FROM nation WHERE n_name IN (SELECT r_name FROM region UNION SELECT n_name FROM nation WHERE n_regionkey > 1) AND n_regionkey > 0", "nation", "region")
def restricted_contigs(n: DataFrame, r: DataFrame) -> DataFrame:
    """Contigs of one table that an allowed set has."""
    allowed = r.select(F.col("r_name").alias("contig")).unionByName(n.where("n_regionkey > 1").select(F.col("n_name").alias("contig")))
    return n.where("n_regionkey > 0").select(F.col("n_name").alias("contig")).join(allowed, "contig", "left_semi")


@query("SELECT p.piece_id, x.tx_id, CAST(sum(least(p.rend, x.rend) - greatest(p.lend, x.lend) + 1) AS BIGINT) AS overlap FROM pieces p JOIN (SELECT DISTINCT contig, strand, tx_id, lend, rend FROM pieces WHERE tax > 0.075) x ON p.contig = x.contig AND p.strand = x.strand AND p.lend <= x.rend AND p.rend >= x.lend GROUP BY 1, 2 HAVING sum(least(p.rend, x.rend) - greatest(p.lend, x.lend) + 1) >= 25", "pieces")
def gated_targets(p: DataFrame) -> DataFrame:
    """Transcripts that share enough bases with a read's blocks."""
    x = p.where("tax > 0.075").select("contig", "strand", "tx_id", F.col("lend").alias("lend2"), F.col("rend").alias("rend2")).distinct()
    return intervals.interval_join(p.select("piece_id", "contig", "strand", "lend", "rend"), x).groupBy("piece_id", "tx_id").agg(F.sum("overlap").alias("overlap")).where("overlap >= 25")


@query(
    """WITH c AS (SELECT l_partkey % 100 AS gene_id, l_partkey AS tx_id, l_linestatus || l_returnflag AS sample, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2, 3), d AS (SELECT *, n / sum(n) OVER (PARTITION BY sample) * 1e6 AS cpm FROM c),
    g AS (SELECT gene_id, tx_id FROM d GROUP BY 1, 2 HAVING count(*) FILTER (cpm >= 400) >= 3), k AS (SELECT gene_id FROM g GROUP BY 1 HAVING count(*) >= 2), e AS (SELECT d.* FROM d SEMI JOIN g USING (gene_id, tx_id) SEMI JOIN k USING (gene_id))
    SELECT gene_id, tx_id, sample, n, round(cpm, 4) AS cpm, round(n / sum(n) OVER (PARTITION BY gene_id, sample), 6) AS fraction FROM e""",
    "lineitem",
)
def bulk_usage(d: DataFrame) -> DataFrame:
    """L7 without its linear models."""
    c = d.groupBy((F.col("l_partkey") % 100).alias("gene_id"), F.col("l_partkey").alias("tx_id"), F.concat("l_linestatus", "l_returnflag").alias("sample")).agg(F.sum("l_quantity").alias("n"))
    return quantify.bulk_filter(c, min_cpm=400, min_samples=3).withColumns({"cpm": F.round("cpm", 4), "fraction": r6("fraction")})


@query(
    """WITH c AS (SELECT l_orderkey % 50 AS cell, l_partkey AS feature, CAST(sum(l_linenumber) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), o AS (SELECT feature FROM c GROUP BY 1 HAVING count(*) >= 10), d AS (SELECT * FROM c SEMI JOIN o USING (feature)), k AS (SELECT cell, sum(n) AS total FROM d GROUP BY 1 HAVING count(*) >= 100)
    SELECT cell, feature, round(ln(1 + n / total * 1e4), 6) AS value FROM d JOIN k USING (cell)""",
    "lineitem",
)
def normalized_cells(d: DataFrame) -> DataFrame:
    """Both minima and the log-normalisation."""
    c = d.groupBy((F.col("l_orderkey") % 50).alias("cell"), F.col("l_partkey").alias("feature")).agg(F.sum("l_linenumber").cast("double").alias("n"))
    return quantify.normalized_cells(c, min_cells=10, min_features=100).withColumn("value", r6("value"))


@query(
    """WITH v AS (SELECT l_suppkey AS feature, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS g, CASE WHEN l_tax > 0.03 THEN l_quantity ELSE 0 END AS x FROM lineitem),
    a AS (SELECT feature, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n2, count(*) FILTER (g = 1 AND x > 0) AS k1, count(*) FILTER (g = 0 AND x > 0) AS k2, sum(x) FILTER (g = 1) AS s1, sum(x) FILTER (g = 0) AS s2 FROM v GROUP BY 1)
    SELECT feature, round(k1 / n1::DOUBLE, 6) AS pct_1, round(k2 / n2::DOUBLE, 6) AS pct_2, round(log2(s1 / n1 + 1) - log2(s2 / n2 + 1), 6) AS avg_log2_fc FROM a WHERE n1 > 0 AND n2 > 0 AND k1 + k2 >= 3 AND greatest(k1 / n1::DOUBLE, k2 / n2::DOUBLE) >= 0.1""",
    "lineitem",
)
def expression_contrast(d: DataFrame) -> DataFrame:
    """L8."""
    v = d.select(F.col("l_suppkey").alias("feature"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("grp"), F.when(F.col("l_tax") > 0.03, F.col("l_quantity")).otherwise(0.0).alias("value"))
    return statistics.expression_contrast(v).select("feature", *[r6(c).alias(c) for c in ("pct_1", "pct_2", "avg_log2_fc")])


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_tax - 0.04 >= 0.02 AND l_discount - 0.05 >= 0.02 THEN 'up' WHEN l_tax - 0.04 <= -0.02 AND l_discount - 0.05 <= -0.02 THEN 'down' ELSE 'neutral' END AS call FROM lineitem", "lineitem")
def direction_calls(d: DataFrame) -> DataFrame:
    """L10."""
    call = statistics.direction(F.col("l_tax") - 0.04, F.col("l_discount") - 0.05, min_fc=0.02, min_change=0.02)
    return d.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", call.alias("call"))


@query(
    """WITH n AS (SELECT l_suppkey % 10 AS gene_id, l_suppkey AS tx_id, l_linenumber AS stage, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT DISTINCT stage AS stage_a FROM n), p AS (SELECT stage_a, lead(stage_a) OVER (ORDER BY stage_a) AS stage_b FROM s),
    k AS (SELECT DISTINCT gene_id, tx_id, stage_a, stage_b FROM n JOIN p ON stage IN (stage_a, stage_b) WHERE stage_b IS NOT NULL)
    SELECT k.gene_id, k.tx_id, stage_a, stage_b, coalesce(a.n, 0) AS count_a, coalesce(b.n, 0) AS count_b FROM k LEFT JOIN n a ON a.gene_id = k.gene_id AND a.tx_id = k.tx_id AND a.stage = stage_a LEFT JOIN n b ON b.gene_id = k.gene_id AND b.tx_id = k.tx_id AND b.stage = stage_b""",
    "lineitem",
)
def consecutive_stages(d: DataFrame) -> DataFrame:
    """L11."""
    n = d.groupBy((F.col("l_suppkey") % 10).alias("gene_id"), F.col("l_suppkey").alias("tx_id"), F.col("l_linenumber").alias("stage")).agg(F.sum("l_quantity").alias("n"))
    return statistics.consecutive_pairs(n, "stage")


@query("WITH p AS (SELECT o_orderkey AS id, ((o_orderkey * 7919) % 1000 + 1) / 100000.0::DOUBLE AS adj_p_value, o_totalprice / 500000 AS delta FROM orders) SELECT id, adj_p_value <= 0.001 AND abs(delta) >= 0.1 AS significant FROM p", "orders")
def significance(o: DataFrame) -> DataFrame:
    """L4: by adjusted p-value and change."""
    d = o.select(F.col("o_orderkey").alias("id"), (((F.col("o_orderkey") * 7919) % 1000 + 1) / 100000).alias("adj_p_value"), (F.col("o_totalprice") / 500000).alias("delta_up"), F.lit(0.0).alias("delta_down"))
    return d.select("id", statistics.significant(d).alias("significant"))


@query("SELECT l_orderkey AS id, string_agg(l_linenumber || '.' || l_partkey, '>' ORDER BY l_linenumber, l_partkey) AS path FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber BETWEEN 2 AND 6) GROUP BY 1", "lineitem")
def trimmed_paths(d: DataFrame) -> DataFrame:
    """Paths whose first and last kinds of nodes are boundary sites."""
    kind = F.when(F.col("l_linenumber") == 1, "TSS:").when(F.col("l_linenumber") == 7, "POLYA:").otherwise("")
    n = d.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(kind, F.concat_ws(".", "l_linenumber", "l_partkey")).alias("node")).distinct()
    p = n.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "node"))).alias("p"))
    out = scalar.trim_boundaries(F.transform("p", lambda x: x["node"]))
    return p.select("id", F.array_join(out, ">").alias("path")).where("path <> ''")
