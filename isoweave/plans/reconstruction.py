"""Registered queries: filters, sequences, paths, graph and assignment (sections C, D, H, I, J, K, M and N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import filters, sequences, splice
from ..runtime import write_through
from .catalog import BLOCKS, INTRONS
from .registry import query, r6

BIN = 32  # bases of a row of the genome view
PRETTY = f"{BLOCKS}, {INTRONS}, t AS (SELECT read_id, contig, strand, count(*) AS n, min(lend) AS lend, max(rend) AS rend, list(lend ORDER BY lend) AS l, list(rend ORDER BY lend) AS r FROM segs GROUP BY 1, 2, 3)"
CONTIGS = "gs AS (SELECT contig, min(bin) AS b0, string_agg(seq, '' ORDER BY bin) AS s FROM genome GROUP BY 1)"
REASONS = """CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN mapq < 5 THEN 'min_mapping_quality' WHEN flag & 1 <> 0 AND flag & 2 = 0 THEN 'improper_pair' WHEN flag & 1024 <> 0 THEN 'duplicate' WHEN flag & 512 <> 0 THEN 'qcfail' WHEN flag & 2048 <> 0 THEN 'supplementary' ELSE 'tested' END"""


def pretty(a: DataFrame) -> DataFrame:
    left, right = scalar.soft_clips(F.col("cigar"))
    return splice.pretty_alignments(a).withColumns({"left_sc": left, "right_sc": right})


@query(
    f"""WITH {BLOCKS.split(", u AS")[0]}, a AS (SELECT {REASONS} AS k, nm, list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN k[i] = 'M' THEN n[i] ELSE 0 END)) AS m, list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN k[i] = '=' THEN n[i] ELSE 0 END)) AS e FROM o),
    p AS (SELECT 100.0 - nm::DOUBLE / (CASE WHEN m > 0 THEN m ELSE e END) * 100.0 < 80 AS failed FROM a WHERE k = 'tested')
    SELECT count(*) AS n_tested, count(*) FILTER (failed) AS n_failed, round(1 - count(*) FILTER (failed) / count(*)::DOUBLE, 6) AS pass_share, count(*) > 1000 AND 1 - count(*) FILTER (failed) / count(*)::DOUBLE < 0.9 AS suspect FROM p""",
    "alignments",
)
def identity_share(a: DataFrame) -> DataFrame:
    """C3."""
    return filters.identity_share(a.select(splice.discard_reason(min_mapq=5).alias("reason"))).withColumn("pass_share", r6("pass_share"))


@query(f"WITH {PRETTY} SELECT read_id, CASE WHEN n > 1 THEN 'ME' ELSE 'SE' END AS splice_type FROM t", "alignments")
def splice_types(a: DataFrame) -> DataFrame:
    """C4."""
    return splice.pretty_alignments(a).select("read_id", splice.splice_type().alias("splice_type"))


@query(
    f"""WITH {PRETTY}, a AS (SELECT *, CASE WHEN n > 1 AND l[2] - r[1] - 1 > 20 THEN 2 ELSE 1 END AS i FROM t), bb AS (SELECT *, CASE WHEN n - i + 1 > 1 AND l[n] - r[n - 1] - 1 > 20 THEN n - 1 ELSE n END AS j FROM a)
    SELECT read_id, CAST(j - i + 1 AS INT) AS n_left, l[i] AS lend, r[j] AS rend FROM bb""",
    "alignments",
)
def pruned_ends(a: DataFrame) -> DataFrame:
    """C5, with a limit that the test table's introns pass."""
    d = splice.pretty_alignments(a).select("read_id", splice.prune_long_terminal_introns(F.col("segments"), 20).alias("s"))
    return d.select("read_id", F.size("s").alias("n_left"), F.element_at("s", 1)["lend"].cast("long").alias("lend"), F.element_at("s", -1)["rend"].cast("long").alias("rend"))


@query(
    f"""WITH {PRETTY}, c AS (SELECT read_id, coalesce(TRY_CAST(regexp_extract(cigar, '^(\\d+)S', 1) AS INT), 0) AS a, coalesce(TRY_CAST(regexp_extract(cigar, '(\\d+)S$', 1) AS INT), 0) AS b FROM alignments),
    s AS (SELECT unnest(['TSS', 'POLYA']) AS kind, contig, strand, unnest(CASE WHEN strand = '+' THEN [lend, rend] ELSE [rend, lend] END) AS pos, unnest(CASE WHEN strand = '+' THEN [a, b] ELSE [b, a] END) AS clip FROM t JOIN c USING (read_id))
    SELECT kind, contig, strand, pos, count(*) AS n FROM s WHERE clip <= 3 GROUP BY 1, 2, 3, 4""",
    "alignments",
)
def site_counts(a: DataFrame) -> DataFrame:
    """E4."""
    d = splice.site_counts(pretty(a), max_clip=3)
    return d.select("kind", "contig", "strand", F.col("pos").cast("long").alias("pos"), "n")


@query(
    "SELECT tx_id, CASE WHEN length < 40 THEN 'short' WHEN n_exons = 1 AND NOT (is_ref AND tpm > 0) AND ((NOT has_tss AND NOT has_polya) OR tpm < 6) THEN 'mono_exonic' WHEN NOT is_ref AND n_reads < 3 THEN 'novel_support' END AS v, gene_id, n_reads FROM isoforms".join(["WITH d AS (", "), f AS (SELECT *, CASE WHEN v IS NULL THEN n_reads END AS k FROM d) SELECT tx_id, coalesce(v, CASE WHEN k / sum(k) OVER (PARTITION BY gene_id) < 0.012 THEN 'isoform_fraction' END, 'kept') AS verdict FROM f"]),
    "isoforms",
)
def transcript_verdicts(t: DataFrame) -> DataFrame:
    """C12, C13, C15, C22."""
    return filters.transcript_verdicts(t, min_length=40, hifi=True, min_tpm=6.0, min_reads=3, min_fraction=0.012).select("tx_id", "verdict")


@query("WITH f AS (SELECT tx_id, n_reads / sum(n_reads) OVER (PARTITION BY gene_id) AS f FROM isoforms) SELECT tx_id, round(f, 6) AS isoform_fraction, f >= 0.01 AS kept FROM f", "isoforms")
def fraction_split(t: DataFrame) -> DataFrame:
    """Both lists."""
    kept, gone = filters.split_by_fraction(t, min_fraction=0.01)
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False))).select("tx_id", r6("isoform_fraction").alias("isoform_fraction"), "kept")


CHAINS = f"{PRETTY}, c AS (SELECT t.read_id, mapq, CASE WHEN n > 1 THEN contig || strand || array_to_string(list_transform(range(1, n), lambda i: (r[i] + 1) || '-' || (l[i + 1] - 1)), ',') END AS chain FROM t JOIN (SELECT read_id, mapq FROM alignments) USING (read_id))"


@query(f"WITH {CHAINS} SELECT read_id AS tx_id, coalesce(chain IN (SELECT chain FROM c WHERE mapq >= 50 AND chain IS NOT NULL), false) AS is_known FROM c", "alignments")
def known_or_novel(a: DataFrame) -> DataFrame:
    """C16, D9; the reference is what is mapped best."""
    chain = F.when(F.size("introns") > 0, F.concat("contig", "strand", F.array_join(F.transform("introns", lambda i: F.concat_ws("-", i["lend"], i["rend"])), ",")))
    d = splice.pretty_alignments(a).select(F.col("read_id").alias("tx_id"), "mapq", chain.alias("chain"))
    return filters.known_or_novel(d, d.where("mapq >= 50")).select("tx_id", "is_known")


@query(
    f"""WITH {PRETTY}, {CONTIGS}, e AS (SELECT t.*, CASE WHEN strand = '+' THEN substr(s, rend, 21) ELSE substr(s, greatest(1, lend - 20), lend - greatest(1, lend - 20) + 1) END AS flank FROM t JOIN gs USING (contig)),
    ff AS (SELECT read_id, flank, CASE WHEN strand = '+' THEN flank ELSE reverse(translate(flank, 'ACGT', 'TGCA')) END AS x FROM e WHERE length(flank) > 0)
    SELECT read_id, flank, length(regexp_replace(x, '[^A]', '', 'g')) >= 12 OR contains(substr(x, 1, 8), 'AAAAAA') AS primed FROM ff""",
    "alignments", "genome",
)
def internal_priming(a: DataFrame, g: DataFrame) -> DataFrame:
    """C17, A5: 21 bases from each 3' end on."""
    d = splice.pretty_alignments(a)
    ends = d.select("read_id", "contig", "strand", F.when(F.col("strand") == "+", F.element_at("segments", -1)["rend"]).otherwise(F.element_at("segments", 1)["lend"]).alias("pos"))
    f = sequences.three_prime_flanks(ends, g, "read_id", bin_size=BIN)
    return f.select("read_id", "flank", splice.internal_priming(f).alias("primed"))


CLASSES = f"""{PRETTY}, {CONTIGS}, i AS (SELECT read_id, contig, strand, lend, rend FROM introns WHERE rend IS NOT NULL),
    x AS (SELECT i.*, substr(s, lend, 2) || '-' || substr(s, rend - 1, 2) AS p FROM i JOIN gs USING (contig)), y AS (SELECT *, CASE WHEN p IN ('GT-AG', 'GC-AG', 'AT-AC') THEN '+' WHEN p IN ('CT-AC', 'CT-GC', 'GT-AT') THEN '-' END AS k FROM x)"""


def introns_of(a: DataFrame) -> DataFrame:
    d = splice.pretty_alignments(a).select("read_id", "contig", "strand", F.explode("introns").alias("i"))
    return d.select("read_id", "contig", "strand", F.col("i.lend").cast("long").alias("lend"), F.col("i.rend").cast("long").alias("rend"))


@query(f"WITH {CLASSES} SELECT DISTINCT contig, lend, rend, k AS splice_class FROM y", "alignments", "genome")
def splice_classes(a: DataFrame, g: DataFrame) -> DataFrame:
    """By the dinucleotides of every intron."""
    return sequences.intron_classes(introns_of(a), g, bin_size=BIN).select("contig", "lend", "rend", "splice_class").distinct()


@query(f"WITH {CLASSES} SELECT read_id, CASE WHEN count(*) FILTER (k = '+') > count(*) FILTER (k = '-') THEN '+' WHEN count(*) FILTER (k = '-') > count(*) FILTER (k = '+') THEN '-' ELSE any_value(strand) END AS strand FROM y GROUP BY 1", "alignments", "genome")
def strand_votes(a: DataFrame, g: DataFrame) -> DataFrame:
    """C11."""
    d = sequences.intron_classes(introns_of(a), g, bin_size=BIN).withColumnRenamed("read_id", "read")
    return splice.strand_votes(d).withColumnRenamed("read", "read_id")


@query(
    f"""WITH {PRETTY}, {CONTIGS}, q AS (SELECT t.read_id, strand, string_agg(substr(s, l2, r2 - l2 + 1), '' ORDER BY l2) AS x FROM (SELECT read_id, contig, strand, unnest(l) AS l2, unnest(r) AS r2 FROM t) t JOIN gs USING (contig) GROUP BY 1, 2)
    SELECT read_id, CASE WHEN strand = '-' THEN reverse(translate(x, 'ACGT', 'TGCA')) ELSE x END AS seq FROM q""",
    "alignments", "genome",
)
def transcript_sequences(a: DataFrame, g: DataFrame) -> DataFrame:
    """K8, A5."""
    t = splice.pretty_alignments(a).select(F.col("read_id").alias("tx_id"), "contig", "strand", F.col("segments").alias("exons"))
    return sequences.transcript_sequences(t, g, bin_size=BIN).withColumnRenamed("tx_id", "read_id")


@query(
    f"""WITH {PRETTY}, {CONTIGS}, q AS (SELECT t.read_id, strand, string_agg(substr(s, l2, r2 - l2 + 1), '' ORDER BY l2) AS x FROM (SELECT read_id, contig, strand, unnest(l) AS l2, unnest(r) AS r2 FROM t) t JOIN gs USING (contig) GROUP BY 1, 2),
    y AS (SELECT read_id, CASE WHEN strand = '-' THEN reverse(translate(x, 'ACGT', 'TGCA')) ELSE x END AS seq FROM q)
    SELECT '>' || read_id || chr(10) || rtrim(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM y""",
    "alignments", "genome",
)
def sequence_file(a: DataFrame, g: DataFrame) -> DataFrame:
    """M3: transcripts as FASTA records."""
    t = splice.pretty_alignments(a).select(F.col("read_id").alias("tx_id"), "contig", "strand", F.col("segments").alias("exons"))
    return sequences.fasta_lines(sequences.feature_sequences(t, g, bin_size=BIN), "tx_id", "cdna").select("value")


REALIGN = f"""{PRETTY}, {CONTIGS}, i AS (SELECT DISTINCT contig, strand, lend, rend FROM introns WHERE rend IS NOT NULL),
    k AS (SELECT t.*, TRY_CAST(regexp_extract(cigar, '^(\\d+)S', 1) AS INT) AS c, CAST(regexp_extract(cigar, '^(\\d+S)?(\\d+)M', 2) AS INT) AS b1, coalesce(TRY_CAST(regexp_extract(cigar, '^\\d+S\\d+M(\\d+)D', 1) AS INT), 0) AS gap, coalesce(TRY_CAST(regexp_extract(cigar, '^\\d+S\\d+M\\d+D(\\d+)[M=]', 1) AS INT), 0) AS b2 FROM t JOIN (SELECT read_id, cigar FROM alignments) USING (read_id)),
    w AS (SELECT * FROM k WHERE c BETWEEN 5 AND 20), y AS (SELECT w.read_id, substr(s, i.lend - c, c) AS clip, i.lend FROM w JOIN gs USING (contig) JOIN i ON w.contig = i.contig AND w.strand = i.strand AND i.rend + 1 = w.lend WHERE i.lend - c >= 1),
    cl AS (SELECT read_id, max(struct_pack(a := lend, b := clip)).b AS clip FROM y WHERE substr(clip, 1, 1) = 'A' GROUP BY 1),
    rd AS (SELECT w.*, clip || substr(s, w.lend, b1) || CASE WHEN gap > 0 THEN substr(s, w.lend + b1 + gap, b2) ELSE '' END AS q FROM w JOIN gs USING (contig) JOIN cl USING (read_id)),
    x AS (SELECT read_id, contig, strand, q, c, unnest(range(lend, lend + 16)) AS x, lend, b1, gap, b2, r[1] AS seg_end FROM rd),
    xn AS (SELECT read_id, contig, strand, x, q, CASE WHEN x - lend < b1 THEN c + x - lend WHEN gap > 0 AND x - lend - gap >= b1 AND x - lend - gap < b1 + b2 THEN c + x - lend - gap END AS n FROM x WHERE x <= seg_end
        UNION ALL SELECT read_id, contig, strand, lend + b1 + gap + j, q, c + b1 + j FROM rd, range(0, 16) o(j) WHERE gap > 0 AND j < b2 AND b1 + gap + j > 15),
    z AS (SELECT read_id, i.lend, i.rend, n FROM xn JOIN i ON i.contig = xn.contig AND i.strand = xn.strand AND i.rend + 1 = xn.x JOIN gs ON gs.contig = xn.contig WHERE n <= 20 AND i.lend - n >= 1 AND substr(s, i.lend - n, n) = substr(q, 1, n)),
    m AS (SELECT read_id, max(struct_pack(a := lend, b := rend, n := n)) AS m FROM z GROUP BY 1)"""


def whole(a: DataFrame) -> DataFrame:
    """What clips are looked up in, written once, as it is read for introns and for ends."""
    return write_through(pretty(a).select("read_id", "contig", "strand", "segments", "introns", "left_sc", sequences.aligned_blocks(F.col("cigar"), F.col("pos")).alias("blocks")), "pretty")


def clipped(d: DataFrame, g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First segments with their clips, and introns. The table has no bases, so a clip is what stands before an intron
    that ends there, where that begins with A, aligned bases are the genome's and inserted ones N; reads with other clips
    match nowhere. No read of the table has a clip at its right end."""
    i = d.select("contig", "strand", F.explode("introns").alias("i")).select("contig", "strand", F.col("i.lend").cast("long").alias("lend"), F.col("i.rend").cast("long").alias("rend")).distinct()
    first = F.element_at("segments", 1)
    ends = d.where("left_sc BETWEEN 5 AND 20").select("read_id", "contig", "strand", "left_sc", "blocks", first["lend"].cast("long").alias("lend"), first["rend"].cast("long").alias("rend"))
    near = ends.select("read_id", "contig", "strand", "left_sc", F.col("lend").alias("own")).join(i.select("contig", "strand", F.col("lend").alias("i"), (F.col("rend") + 1).alias("own")), ["contig", "strand", "own"])
    spans = near.select("read_id", "contig", (F.col("i") - F.col("left_sc")).alias("lend"), (F.col("i") - 1).alias("rend"))
    best = sequences.fetch(spans, g, "read_id", bin_size=BIN, longest=20).where("seq LIKE 'A%'").groupBy("read_id").agg(F.max(F.struct("lend", "seq")).alias("m"))
    d = ends.join(best.select("read_id", F.col("m.seq").alias("clip")), "read_id")
    # bases from the segment's start to the last block of which one of the first 20 bases is part
    early = F.filter("blocks", lambda b: b["at"] <= 20)
    reach = d.withColumns({"begin": F.col("lend"), "early": early, "end": F.col("rend"), "rend": F.least(F.element_at(early, -1)["rend"], F.element_at(early, -1)["lend"] + 19)})
    got = sequences.fetch(reach, g, "read_id", "strand", "begin", "end", "clip", "blocks", "early", bin_size=BIN, longest=512)
    filled = F.aggregate("early", F.col("clip"), lambda s, b: F.concat(F.rpad(s, (b["at"] - 1).cast("int"), "N"), F.substring(F.col("seq"), (b["lend"] - F.col("begin") + 1).cast("int"), (b["rend"] - b["lend"] + 1).cast("int"))))
    return got.select("read_id", "contig", "strand", F.col("begin").alias("lend"), F.col("end").alias("rend"), "clip", "blocks", F.left(filled, F.lit(20)).alias("seq")), i


@query(f"WITH {REALIGN} SELECT read_id, m.a AS lend, m.b AS rend FROM m", "alignments", "genome")
def realigned_clips(a: DataFrame, g: DataFrame) -> DataFrame:
    """C7, D19."""
    ends, i = clipped(whole(a), g)
    return sequences.realign_clips(ends, i, g, bin_size=BIN).select("read_id", "lend", "rend")


@query(f"WITH {REALIGN} SELECT t.read_id, n + CASE WHEN m IS NULL THEN 0 ELSE 1 END AS n_segments, CASE WHEN m IS NULL THEN t.lend ELSE m.a - m.n END AS lend, CASE WHEN m IS NOT NULL THEN 'left' END AS correction_type FROM t LEFT JOIN m USING (read_id)", "alignments", "genome")
def corrected_alignments(a: DataFrame, g: DataFrame) -> DataFrame:
    """B11, N11."""
    p = whole(a)
    ends, i = clipped(p, g)
    d = sequences.corrected_alignments(p.select("read_id", "segments"), sequences.realign_clips(ends, i, g, bin_size=BIN))
    return d.select("read_id", F.size("segments").cast("long").alias("n_segments"), F.element_at("segments", 1)["lend"].cast("long").alias("lend"), "correction_type")


@query("SELECT l_orderkey AS read_name, l_partkey AS tx_id, l_tax FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')", "lineitem", "orders")
def named_reads(d: DataFrame, o: DataFrame) -> DataFrame:
    """C24."""
    rows = d.select(F.col("l_orderkey").alias("read_name"), F.col("l_partkey").alias("tx_id"), "l_tax")
    return filters.reads_named(rows, o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("read_name")))


@query("SELECT read_id, any_value(tx_id) AS tx_id FROM tracking GROUP BY 1 HAVING count(*) = 1", "tracking")
def unique_isoform_reads(t: DataFrame) -> DataFrame:
    """From annotated reads."""
    d = t.groupBy("read_id").agg(F.array_join(F.array_sort(F.collect_list("tx_id")), ",").alias("XI"))
    return filters.unique_isoform_reads(d).select("read_id", F.col("XI").cast("long").alias("tx_id"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 10 AND p_type <> 'PROMO'", "part")
def spliced_only(p: DataFrame) -> DataFrame:
    """Codes of promoted parts are those of single exons."""
    code = F.concat(F.lit("c:"), F.when(F.col("p_type") == "PROMO", "iso-").otherwise("h-"), F.col("p_partkey").cast("string"))
    return filters.spliced_only(p.where("p_size > 10").withColumn("splice_hash", code)).select("p_partkey", "p_brand")


@query("SELECT 'reftranscript:' || tx_id || ':' || c AS read_name, tx_id FROM (SELECT tx_id, unnest(range(1, greatest(1, CAST(ceil(tpm) AS BIGINT)) + 1)) AS c FROM isoforms WHERE is_ref)", "isoforms")
def reference_evidence(t: DataFrame) -> DataFrame:
    """I4 without reads."""
    return filters.reference_evidence(t.where("is_ref"), from_reads=False)


@query("SELECT tx_id, n_reads FROM (SELECT tx_id, count(*) AS n_reads FROM tracking GROUP BY 1)", "tracking")
def real_evidence(t: DataFrame) -> DataFrame:
    """Pseudo-reads come in with the reads and go out before reads are counted."""
    reads = t.select(F.col("read_id").cast("string").alias("read_name"), "tx_id")
    more = filters.reference_evidence(t.select("tx_id").distinct(), from_reads=True)
    return filters.without_reference_evidence(reads.unionByName(more)).groupBy("tx_id").agg(F.count(F.lit(1)).alias("n_reads"))
