"""Registered queries: file formats, written to the shared folder and read again (sections A and B of the survey)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals, ordering, quantify, splice
from ..runtime import shared_dir
from ..sources import bam, readers, writers
from .catalog import OPS, OWN, SPLIT
from .registry import query, r6


def folder(df: DataFrame, label: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"


@query("SELECT n_name AS contig, n_nationkey * 100 AS length FROM nation", "nation")
def contig_listing(n: DataFrame) -> DataFrame:
    """An index of sequences through its file."""
    path = folder(n, "fai")
    lines = n.select("n_nationkey", F.concat_ws("\t", "n_name", (F.col("n_nationkey") * 100).cast("string"), F.lit("0"), F.lit("60"), F.lit("61")).alias("value"))
    writers.write_lines(lines, path, "n_nationkey")
    return readers.contigs(n.sparkSession, path).select("contig", F.col("length").cast("int").alias("length"))


ROUNDED = "floor({0} * {1} + 0.5) / {1}"


@query(
    f"""WITH {SPLIT}, c AS (SELECT gene_id, tx_id, sum(f) AS n FROM s GROUP BY 1, 2), n AS (SELECT gene_id, read_id, count(*) AS n, min(tx_id) AS tx_id FROM tracking GROUP BY 1, 2),
    u AS (SELECT gene_id, tx_id, count(*) AS u FROM n WHERE n = 1 GROUP BY 1, 2)
    SELECT CAST(gene_id AS VARCHAR) AS gene_id, CAST(tx_id AS VARCHAR) AS transcript_id, coalesce(u, 0)::BIGINT AS uniq_reads, {ROUNDED.format("round(n, 9)", 10)} AS all_reads, {ROUNDED.format("round(n / sum(n) OVER (PARTITION BY gene_id), 9)", 1000)} AS isoform_fraction FROM c LEFT JOIN u USING (gene_id, tx_id)""",
    "tracking",
)
def expression_file(t: DataFrame) -> DataFrame:
    """The report's file with a version line, read again; its keys are unique."""
    counts = quantify.equal_split(t).groupBy("gene_id", "tx_id").agg(F.round(F.sum("frac"), 9).alias("all_reads"))
    report = quantify.expression_report(t, counts)
    path = folder(t, "expression")
    head = "gene_id\ttranscript_id\tuniq_reads\tall_reads\tisoform_fraction\tunique_gene_read_fraction\tTPM"
    lines = writers.expression_file(report.withColumn("isoform_fraction", F.round("isoform_fraction", 9)))
    writers.write_lines(lines, path, "order", "id", header=head)
    d = readers.read_tsv(t.sparkSession, path, "gene_id string, transcript_id string, uniq_reads long, all_reads double, isoform_fraction double, unique_gene_read_fraction double, TPM double")
    twice = readers.duplicate_keys(d, "gene_id", "transcript_id").select("gene_id", "transcript_id")
    return d.join(twice, ["gene_id", "transcript_id"], "left_anti").select("gene_id", "transcript_id", "uniq_reads", "all_reads", "isoform_fraction")


@query("SELECT CAST(read_id AS VARCHAR) AS read_name, count(*) AS n_rows, count(DISTINCT gene_id) AS n_genes, round(sum(floor(1000.0 / n + 0.5) / 1000), 6) AS frac FROM (SELECT *, count(*) OVER (PARTITION BY gene_id, read_id) AS n FROM tracking) GROUP BY 1", "tracking")
def tracking_file(t: DataFrame) -> DataFrame:
    """The tracking report's file, read again and grouped by read."""
    d = quantify.equal_split(t).withColumns({"splice_hash": F.lit("h"), "mp_id": F.concat(F.lit("mp"), F.col("read_id").cast("string")), "weight": F.lit(1.0)})
    path = folder(t, "tracking")
    writers.write_lines(writers.tracking_lines(d), path, "read_id", "tx_id", header="# tracking")
    back = t.sparkSession.read.option("sep", "\t").option("comment", "#").schema(readers.TRACKING_SCHEMA).csv(path)
    return back.groupBy("read_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("gene_id").alias("n_genes"), r6(F.sum("frac_assigned")).alias("frac"))


def transcripts_of(p: DataFrame) -> DataFrame:
    """Merged pieces of each transcript on a contig and strand, as one transcript."""
    own = intervals.merge_intervals(p, ["contig", "strand", "tx_id"], cut=None)
    d = own.groupBy("contig", "strand", "tx_id").agg(F.array_sort(F.collect_list(F.struct(F.col("lend").cast("int").alias("lend"), F.col("rend").cast("int").alias("rend")))).alias("exons"))
    key = F.concat_ws("_", F.col("tx_id").cast("string"), "contig", "strand")
    return d.select("contig", "strand", F.concat(F.lit("g"), (F.col("tx_id") % 10).cast("string")).alias("gene_id"), key.alias("tx_id"), "exons")


@query(
    f"""WITH {OWN} SELECT contig, strand, 'g' || (tx_id % 10) AS gene_id, tx_id || '_' || contig || '_' || strand AS tx_id, count(*) AS n_exons, CAST(sum(rend - lend + 1) AS BIGINT) AS bases, CAST(min(lend) AS BIGINT) AS lend, CAST(max(rend) AS BIGINT) AS rend, 'n' || count(*) AS note FROM x GROUP BY contig, strand, x.tx_id""",
    "pieces",
)
def gtf_file(p: DataFrame) -> DataFrame:
    """Transcripts with an attribute through a GTF file."""
    t = transcripts_of(p).withColumn("meta", F.create_map(F.lit("note"), F.concat(F.lit("n"), F.size("exons").cast("string"))))
    path = folder(p, "gtf")
    writers.write_lines(writers.gtf_lines(t), path, "contig", "lend", "tx_id", "ordinal", header="# made here")
    back = readers.transcripts_of(readers.read_gtf(p.sparkSession, path))
    bases = F.aggregate("exons", F.lit(0).cast("long"), lambda a, e: a + e["rend"] - e["lend"] + 1)
    return back.select("contig", "strand", "gene_id", "tx_id", F.size("exons").cast("long").alias("n_exons"), bases.alias("bases"), F.element_at("exons", 1)["lend"].cast("long").alias("lend"), F.element_at("exons", -1)["rend"].cast("long").alias("rend"), F.col("meta")["note"].alias("note"))


@query(
    f"""WITH {OWN}, t AS (SELECT contig, strand, tx_id || '_' || contig || '_' || strand AS tx_id, min(lend) - 1 AS s, max(rend) AS e, count(*) AS n, list(lend ORDER BY lend) AS l, list(rend ORDER BY lend) AS r FROM x GROUP BY contig, strand, x.tx_id)
    SELECT concat_ws(chr(9), contig, s, e, tx_id, 0, strand, s, e, 0, n, array_to_string(list_transform(range(1, n + 1), lambda i: r[i] - l[i] + 1), ','), array_to_string(list_transform(range(1, n + 1), lambda i: l[i] - 1 - s), ',')) AS value FROM t""",
    "pieces",
)
def bed_file(p: DataFrame) -> DataFrame:
    """BED12 through its file."""
    path = folder(p, "bed")
    writers.bed12(transcripts_of(p)).write.text(path)
    return p.sparkSession.read.text(path)


@query("SELECT concat_ws(chr(9), contig, greatest(0, lend - 1 - 3), rend + 3, piece_id, floor(tax * 100 + 0.5)::INT, strand) AS value FROM pieces", "pieces")
def bed_features(p: DataFrame) -> DataFrame:
    """BED6 lines, widened by three bases."""
    return writers.bed6(p.select("contig", "strand", "lend", "rend", F.col("piece_id").alias("name"), F.floor(F.col("tax") * 100 + 0.5).cast("int").alias("score")), pad=3).select("value")


@query(
    """WITH x AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), y AS (SELECT 'c' AS contig, a * 1000 + 100 AS l1, a * 1000 + 200 AS r1, a * 1000 + 300 + b AS l2, a * 1000 + 500 + b AS r2, 'p' || a || '_' || b AS name FROM x)
    SELECT concat_ws(chr(9), contig, l1 - 26, r2 + 25, name, 0, '+', l1 - 26, r2 + 25, 0, 3, concat_ws(',', 25, l2 - r1 - 1, 25), concat_ws(',', 0, r1 - (l1 - 26), r2 - (l1 - 26))) AS value FROM y""",
    "lineitem",
)
def pattern_bed(d: DataFrame) -> DataFrame:
    """BED12 lines of distinct splice patterns."""
    a, b = F.col("l_partkey") * 1000, F.col("l_suppkey")
    introns = F.format_string("c:(+)[(%d, %d), (%d, %d)]", a + 100, a + 200, a + 300 + b, a + 500 + b)
    return writers.pattern_bed12(d.select(F.lit("c").alias("contig"), F.lit("+").alias("strand"), F.format_string("p%d_%d", "l_partkey", "l_suppkey").alias("name"), introns.alias("introns")))


@query("SELECT 't' || tx_id AS feature_id, 'b' || cell AS cell_barcode, count(*)::DOUBLE AS count FROM tracking GROUP BY 1, 2", "tracking")
def matrix_folder(t: DataFrame) -> DataFrame:
    """Cell by feature counts through a matrix folder."""
    counts = t.groupBy(F.concat(F.lit("t"), F.col("tx_id").cast("string")).alias("feature_id"), F.concat(F.lit("b"), F.col("cell").cast("string")).alias("cell_barcode")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    path = folder(t, "mtx")
    writers.write_mtx(counts, path)
    return readers.read_mtx(t.sparkSession, path)


@query("SELECT 'g' || l_suppkey || '|t' || l_orderkey AS query, CASE WHEN l_linestatus = 'O' THEN '=' ELSE 'j' END AS class_code, unnest(['r' || l_partkey, 'r' || (l_partkey + 1)]) AS target FROM lineitem", "lineitem")
def comparison_file(d: DataFrame) -> DataFrame:
    """A comparison tool's tracking file with two targets a line."""
    path = folder(d, "comparison")
    target = F.format_string("q1:r%d,r%d", F.col("l_partkey"), F.col("l_partkey") + 1)
    line = F.concat_ws("\t", F.lit("TCONS"), F.lit("XLOC"), F.format_string("g%d|t%d", "l_suppkey", "l_orderkey"), F.when(F.col("l_linestatus") == "O", "=").otherwise("j"), target)
    d.select(line.alias("value")).write.text(path)
    return readers.read_comparison(d.sparkSession, path)


@query("SELECT unnest(['G' || p_partkey, 'T' || p_partkey]) AS id, CASE WHEN p_size > 25 THEN 'name ' || p_size ELSE 'G' || p_partkey END AS gene_name FROM part", "part")
def reference_names(p: DataFrame) -> DataFrame:
    """Gene names by gene and transcript id; where a row has none, the gene's id."""
    path = folder(p, "names")
    own = F.format_string('gene_id "G%d"; transcript_id "T%d";', "p_partkey", "p_partkey")
    info = F.when(F.col("p_size") > 25, F.concat(own, F.format_string(' gene_name "name %d";', "p_size"))).otherwise(own)
    p.select(F.concat_ws("\t", F.lit("c"), F.lit("s"), F.lit("transcript"), F.lit("1"), F.lit("9"), F.lit("."), F.lit("+"), F.lit("."), info).alias("value")).write.text(path)
    return readers.reference_names(readers.read_gtf(p.sparkSession, path))


def sam_lines(a: DataFrame) -> DataFrame:
    """Alignments as SAM lines; primary ones carry a cell and a molecule tag."""
    tags = F.concat_ws("\t", F.concat(F.lit("NM:i:"), F.col("nm").cast("string")), F.when(~splice.has_flag(splice.SECONDARY), F.format_string("CB:Z:C%d\tXM:Z:U%d", F.col("mapq"), F.col("nm"))))
    return a.select("contig", "pos", "read_id", F.concat_ws("\t", "read_id", F.col("flag").cast("string"), "contig", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), tags).alias("value"))


@query("SELECT CASE WHEN flag & 256 = 0 THEN concat_ws('^', 'C' || mapq, 'U' || nm, read_id) ELSE read_id END AS read_name, contig, pos, flag, cigar, nm FROM alignments WHERE contig = 'A' AND pos BETWEEN 1 AND 900 AND flag & 2048 = 0", "alignments")
def alignment_scan(a: DataFrame) -> DataFrame:
    """A region of a SAM file, without supplementary rows; names carry cell and molecule where tagged."""
    path = folder(a, "sam")
    writers.write_lines(sam_lines(a), path, "contig", "pos", "read_id", header="@HD\tVN:1.6")
    d = readers.read_sam(a.sparkSession, path)
    contig, _, lend, rend = readers.parse_region("A:1-900")
    d = d.where((F.col("contig") == contig) & F.col("pos").between(lend, rend) & ~splice.has_flag(splice.SUPPLEMENTARY))
    return d.select(readers.single_cell_name(F.col("read_name"), F.col("tags")).alias("read_name"), "contig", "pos", "flag", "cigar", F.col("tags")["NM"].cast("int").alias("nm"))


def bam_rows(a: DataFrame) -> DataFrame:
    """Alignments as rows of a BAM file, with their mismatches as a tag."""
    none = F.lit("*")
    return a.select(F.col("read_id").alias("read_name"), "flag", "contig", "pos", "mapq", "cigar", none.alias("seq"), none.alias("qual"), F.create_map(F.lit("NM"), F.col("nm").cast("string")).alias("tags"))


def bam_contigs(rows: DataFrame) -> list[tuple[str, int]]:
    """Contigs with a length that holds all rows."""
    return [(r.contig, int(r.n) + 1_000_000) for r in rows.groupBy("contig").agg(F.max("pos").alias("n")).orderBy("contig").collect()]


SPAN = "greatest(1, list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN k[i] IN ('M', 'D', 'N', '=', 'X') THEN n[i] ELSE 0 END)))"


@query(f"WITH {OPS} SELECT read_id AS read_name, contig, pos, flag, mapq, cigar, nm FROM o WHERE contig = 'A' AND pos <= 900 AND pos + {SPAN} - 1 >= 400", "alignments")
def bam_region(a: DataFrame) -> DataFrame:
    """A1: what overlaps a region, by the index of BAM files to which all alignments were written."""
    path, rows = folder(a, "bam"), bam_rows(a)
    bam.write_bam(rows, path, bam_contigs(rows))
    d = bam.scan_bam(a.sparkSession, path, region="A:400-900")
    return d.select("read_name", "contig", "pos", "flag", "mapq", "cigar", F.col("tags")["NM"].cast("int").alias("nm"))


@query(
    """WITH t AS (SELECT read_id, string_agg(DISTINCT CAST(gene_id AS VARCHAR), ',' ORDER BY CAST(gene_id AS VARCHAR)) AS genes, count(*) AS n FROM tracking GROUP BY 1)
    SELECT a.read_id AS read_name, a.contig, a.pos, a.flag, a.cigar, a.nm, t.genes AS "XG", t.n::BIGINT AS n_transcripts FROM alignments a LEFT JOIN t ON t.read_id = CAST(string_split(a.read_id, '-')[1] AS BIGINT)""",
    "alignments", "tracking",
)
def annotated_bam(a: DataFrame, t: DataFrame) -> DataFrame:
    """Alignments with their reads' genes, transcripts and fractions as tags, written to BAM files and read in splits."""
    path = folder(a, "bam")
    lists = writers.annotate_reads(t.select(F.col("read_id").alias("read_name")).distinct(), quantify.equal_split(t).withColumnRenamed("read_id", "read_name"))
    lists = lists.select(F.col("read_name").cast("string").alias("order"), "XG", "XI", "XF")
    rows = bam_rows(a).withColumn("order", F.substring_index("read_name", "-", 1)).join(lists, "order", "left").drop("order")
    more = F.filter(F.array(*[F.struct(F.lit(x).alias("key"), F.col(x).alias("value")) for x in ("XG", "XI", "XF")]), lambda e: e["value"].isNotNull())
    rows = rows.withColumn("tags", F.map_concat("tags", F.map_from_entries(more))).drop("XG", "XI", "XF")
    bam.write_bam(rows, path, bam_contigs(rows))
    d = bam.scan_bam(a.sparkSession, path, split_bytes=1 << 18)
    tag = lambda x: F.try_element_at("tags", F.lit(x))
    genes = F.array_join(F.array_sort(F.array_distinct(F.split(tag("XG"), ","))), ",")
    same = F.size(F.split(tag("XI"), ",")) == F.size(F.split(tag("XF"), ","))
    return d.select("read_name", "contig", "pos", "flag", "cigar", F.col("tags")["NM"].cast("int").alias("nm"), genes.alias("XG"), F.when(same, F.size(F.split(tag("XI"), ","))).cast("long").alias("n_transcripts"))


@query("SELECT contig, count(*) AS n_records FROM alignments GROUP BY ROLLUP (contig)", "alignments")
def record_count(a: DataFrame) -> DataFrame:
    """All records, secondary and supplementary ones too."""
    return readers.count_records(a)


@query("SELECT CAST(cell AS VARCHAR) AS cell, cluster FROM cells", "cells")
def cluster_file(c: DataFrame) -> DataFrame:
    """Cells and clusters; lines of another width are passed over."""
    path = folder(c, "clusters")
    wide = c.select(F.concat_ws("\t", F.col("cell").cast("string"), "cluster", F.lit("x")).alias("value"))
    c.select(F.concat_ws("\t", F.col("cell").cast("string"), "cluster").alias("value")).unionByName(wide).write.text(path)
    return readers.read_clusters(c.sparkSession, path)


@query("SELECT concat_ws('^', contig, strand, lend, rend, 'a', 'b') AS key, coalesce(count(*) FILTER (tax < 0.04), 0) AS low, coalesce(count(*) FILTER (tax >= 0.04), 0) AS high FROM pieces GROUP BY contig, strand, lend, rend", "pieces")
def intron_count_files(p: DataFrame) -> DataFrame:
    """Seven-column tables of two samples as one matrix."""
    out = None
    for sample, own in (("low", p.where("tax < 0.04")), ("high", p.where("tax >= 0.04"))):
        path = folder(p, sample)
        n = own.groupBy("contig", "strand", "lend", "rend").agg(F.count(F.lit(1)).alias("n"))
        n.select(F.concat_ws("\t", "contig", "strand", F.col("lend").cast("string"), F.col("rend").cast("string"), F.col("n").cast("string"), F.lit("a"), F.lit("b")).alias("value")).write.text(path)
        d = readers.read_intron_counts(p.sparkSession, path, sample)
        out = d if out is None else out.unionByName(d)
    return out.groupBy("key").pivot("sample", ["low", "high"]).agg(F.sum("support")).fillna(0)


@query("WITH n AS (SELECT DISTINCT 'r' || read_id AS read_name FROM tracking), d AS (SELECT read_name, row_number() OVER (ORDER BY read_name) AS id FROM n) SELECT t.gene_id AS mp_id, count(*) AS n_reads, CAST(sum(id) AS BIGINT) AS id_sum, min(id) AS first_id FROM (SELECT DISTINCT gene_id, 'r' || read_id AS read_name FROM tracking) t JOIN d USING (read_name) GROUP BY 1", "tracking")
def name_store(t: DataFrame) -> DataFrame:
    """Dense ids of read names, and the ids of each path's reads."""
    _, members = ordering.name_store(t.select(F.col("gene_id").alias("mp_id"), F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("read_name")))
    return members.groupBy("mp_id").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("id").alias("id_sum"), F.min("id").alias("first_id"))


@query("SELECT contig, strand, count(*) AS n, coalesce(bool_or(contig IN (SELECT contig FROM exons)), false) AS in_exons FROM pieces GROUP BY 1, 2", "pieces", "exons")
def partitioned_files(p: DataFrame, e: DataFrame) -> DataFrame:
    """A folder for each contig and strand; and which contigs another table has."""
    path = folder(p, "parts")
    writers.write_partitioned(p, path, "contig", "strand")
    names = readers.contig_union(p, e)
    n = p.sparkSession.read.parquet(path).groupBy("contig", "strand").agg(F.count(F.lit(1)).alias("n"))
    return n.join(names, "contig").select("contig", "strand", "n", F.col("has_1").alias("in_exons"))


@query("WITH s AS (SELECT read_id, tx_id, gene_id, count(*) OVER (PARTITION BY gene_id, read_id) AS n FROM tracking) SELECT read_id, string_agg(gene_id, ',' ORDER BY tx_id) AS \"XG\", string_agg(tx_id, ',' ORDER BY tx_id) AS \"XI\", string_agg(printf('%.3f', 1.0::DOUBLE / n), ',' ORDER BY tx_id) AS \"XF\" FROM s GROUP BY 1", "tracking")
def annotated_reads(t: DataFrame) -> DataFrame:
    """Lists of genes, transcripts and fractions for each read."""
    d = quantify.equal_split(t).withColumnRenamed("read_id", "read_name")
    return writers.annotate_reads(d.select("read_name").distinct(), d).withColumnRenamed("read_name", "read_id")


@query("SELECT p_partkey AS line, p_name AS value FROM part WHERE p_partkey > 0 UNION ALL SELECT 0, '# isoweave 2'", "part")
def version_line(p: DataFrame) -> DataFrame:
    """A version line that stands once, however often it is written."""
    lines = p.where("p_partkey > 0").select(F.col("p_partkey").alias("line"), F.col("p_name").alias("value"))
    return writers.with_version(writers.with_version(lines, "1"), "2")


@query(
    """WITH p AS (SELECT l_orderkey AS mp_id, list(l_partkey ORDER BY l_partkey) AS path FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1), t AS (SELECT l_orderkey AS mp_id, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS t FROM lineitem WHERE l_tax > 0.03 GROUP BY 1)
    SELECT mp_id, array_to_string(path, '>') AS nodes, coalesce(array_to_string(t, ','), '') AS transcripts, CAST(len(path) AS INT) AS n_nodes, CAST(coalesce(len(t), 0) AS INT) AS n_transcripts FROM p LEFT JOIN t USING (mp_id)""",
    "lineitem",
)
def path_dump(d: DataFrame) -> DataFrame:
    """B20."""
    p = d.groupBy(F.col("l_orderkey").alias("mp_id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("path"))
    return writers.path_dump(p, d.where("l_tax > 0.03").select(F.col("l_orderkey").alias("mp_id"), F.col("l_suppkey").alias("tx_id")))


@query("SELECT p_name AS name, p_partkey AS id, row_number() OVER (ORDER BY p_name, p_partkey) AS index FROM part", "part")
def external_sort(p: DataFrame) -> DataFrame:
    """F8: each row's place in the byte order of names."""
    return ordering.global_index(p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id")), "name", "id")


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5(o_orderkey || '|7'), o_orderkey) AS index FROM orders", "orders")
def external_shuffle(o: DataFrame) -> DataFrame:
    """each row's place in a repeatable random order."""
    return ordering.shuffled(o.select(F.col("o_orderkey").alias("id")), 7, "id")


@query(
    """WITH m AS (SELECT l_suppkey AS id, l_returnflag AS sample, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT sample, sum(n) AS t FROM m GROUP BY 1), x AS (SELECT id, sample, n, n / t * 1e6 AS tpm FROM m JOIN t USING (sample))
    SELECT id, coalesce(sum(n) FILTER (sample = 'A'), 0) AS "A_count", coalesce(sum(n) FILTER (sample = 'N'), 0) AS "N_count", round(coalesce(sum(tpm) FILTER (sample = 'A'), 0), 4) AS "A_TPM", round(coalesce(sum(tpm) FILTER (sample = 'N'), 0), 4) AS "N_TPM" FROM x GROUP BY 1""",
    "lineitem",
)
def sample_matrices(d: DataFrame) -> DataFrame:
    """Counts and TPM of each id by sample, 0 where a sample lacks it."""
    n = d.groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("sample")).agg(F.sum("l_quantity").alias("n"))
    m = quantify.sample_matrices(n, ["A", "N"])
    return m.select("id", "A_count", "N_count", F.round("A_TPM", 4).alias("A_TPM"), F.round("N_TPM", 4).alias("N_TPM"))
