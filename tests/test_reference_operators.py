"""Operators on hand-made rows with closed-form results."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.functions import scalar
from isoweave.operators import classify, graph, intervals, paths, quantify, splice, statistics
from isoweave.sources import readers, writers

EM_TX = np.array([0, 1, 0, 1, 2, 2, 1, 2])
EM_PATH = np.array([0, 1, 2, 2, 2, 3, 4, 4])
EM_WEIGHT = np.array([1, 1, 0.5, 0.3, 0.2, 1, 0.4, 0.6])


@pytest.mark.parametrize(
    ("alpha", "limit", "tolerance", "rounds", "proportions"),
    [(0.0, 250, 1e-6, 19, (0.108424, 0.271254, 0.620322)), (0.01, 250, 1e-6, 18, (0.109259, 0.275110, 0.615631)), (0.0, 5, 0.0, 5, (0.108763, 0.275866, 0.615370))],
)
def test_em(alpha, limit, tolerance, rounds, proportions):
    _, p, n = quantify.em_arrays(EM_TX, EM_PATH, EM_WEIGHT, np.array([1, 2, 3, 4, 5.0]), alpha=alpha, max_iter=limit, tolerance=tolerance)
    assert n == rounds and np.allclose(p, proportions, atol=2e-6)


def test_chi_squared(spark):
    rows = [("g1", 10.0, 50.0), ("g1", 40.0, 10.0), ("g2", 0.0, 0.0), ("g2", 1.0, 2.0)]
    got = {r.gene_id: r for r in statistics.contingency(spark.createDataFrame(rows, "gene_id string, count_a double, count_b double"), ["gene_id"]).collect()}
    assert got["g1"].chi2 == pytest.approx(41.604750, abs=1e-6) and got["g1"].dof == 1 and got["g2"].chi2 is None
    assert statistics.chi2_tail(41.604750, 1) == pytest.approx(1.117215e-10, rel=1e-6)


def test_cross_gene_em(spark):
    rows = [("A", "a1", "r1"), ("A", "a2", "r2"), ("B", "b1", "r3"), ("B", "b2", "r4"), ("A", "a1", "s"), ("B", "b1", "s"), ("C", "c1", "z")]
    t = spark.createDataFrame([(*r, 1.0) for r in rows], "gene_id string, tx_id string, read_id string, frac double")
    counts = t.groupBy("gene_id", "tx_id").agg(F.sum("frac").alias("all_reads"))
    got = {(r.tx_id, r.read_id): r.frac for r in quantify.cross_gene_em(t, counts, alpha=0.0).collect()}
    assert len(got) == len(rows) and got["a1", "s"] == pytest.approx(0.5) and got["b1", "s"] == pytest.approx(0.5) and got["c1", "z"] == 1.0


def test_sites(spark):
    counts = {10: 1, 15: 2, 20: 3, 40: 1, 45: 5, 50: 2, 75: 3}
    s = spark.createDataFrame([("c", "+", p, n) for p, n in counts.items()], "contig string, strand string, pos long, n long")
    assert sorted((r.pos, r.n) for r in splice.aggregate_sites(s, window=5, least=3).collect()) == [(20, 5), (45, 8), (75, 3)]


def test_cigar(spark):
    d = spark.createDataFrame([("3S10M100N5M2D5M4I6M7S", 101, 5), ("10M", 1, 0), ("4H2S8=2X", 7, 1)], "cigar string, pos int, nm int")
    rows = splice.pretty_alignments(d).select("segments", "introns", scalar.percent_identity(F.col("cigar"), F.col("nm")).alias("id"), *[c.alias(n) for c, n in zip(scalar.soft_clips(F.col("cigar")), "lr", strict=True)]).collect()
    assert [tuple(x) for x in rows[0].segments] == [(101, 110), (211, 228)] and [tuple(x) for x in rows[0].introns] == [(111, 210)]
    assert rows[0].id == pytest.approx(100 - 5 / 26 * 100) and (rows[0].l, rows[0].r) == (3, 7)
    assert rows[1].introns == [] and (rows[2].l, rows[2].r) == (2, 0) and rows[2].id == 90.0


def test_secondary_rescue(spark):
    rows = [("r1", 1, 0, 90.0, 9.0, 0.02, 10), ("r1", 2, 256, 88.0, 8.8, 0.01, 10), ("r1", 3, 256, 80.0, 8.9, 0.01, 10), ("r2", 1, 0, 90.0, 9.0, 0.02, 10), ("r2", 2, 256, 88.0, 8.0, 0.01, 500), ("r2", 3, 2048, 99.0, 9.0, 0.0, 1), ("r3", 1, 0, 9.0, 9.0, 0.01, 1), ("r3", 2, 256, 9.0, 9.0, 0.02, 1), ("r3", 3, 256, 8.0, None, 0.0, 1)]
    d = spark.createDataFrame(rows, "read string, ordinal int, flag int, as_score double, ms double, nm_rate double, longest_intron int")
    assert sorted((r.read, r.ordinal) for r in splice.rescue_secondary(d).collect()) == [("r1", 1), ("r1", 2), ("r2", 1), ("r2", 2), ("r3", 1)]


def test_interval_edges(spark):
    a = spark.createDataFrame([("c", "+", 1, 5000, "x"), ("c", "+", 5001, 5001, "y"), ("c", "-", 1, 9, "z"), ("c", "+", None, 3, "n")], "contig string, strand string, lend long, rend long, read_id string")
    b = spark.createDataFrame([("c", "+", 5000, 9000), ("c", "+", 1, 1), ("c", "-", 10, 12)], "contig string, strand string, lend2 long, rend2 long")
    got = sorted((r.read_id, r.overlap) for r in intervals.interval_join(a, b, bin_size=64).collect())
    assert got == [("x", 1), ("x", 1), ("y", 1)]
    assert sorted(r.read_id for r in intervals.interval_join(a, b, how="left_anti").collect()) == ["n", "z"]
    assert intervals.interval_join(a, b.limit(0)).count() == 0
    merged = intervals.merge_intervals(a.select("contig", "strand", "lend", "rend")).collect()
    assert sorted((r.strand, r.lend, r.rend) for r in merged) == [("+", 1, 5001), ("-", 1, 9)]


def test_paths(spark):
    d = spark.createDataFrame([(["a", "b", "c"], ["b", "c"]), (["a", "b"], ["b", "c"]), (["a", "???", "b"], ["b", "c"]), (["a", "b"], ["x"]), (["b", "c"], ["a", "b"]), (["a", "b", "d"], ["b", "c"])], "a array<string>, b array<string>")
    rows = d.select(scalar.contains_path(F.col("a"), F.col("b")).alias("c"), scalar.compatible_paths(F.col("a"), F.col("b")).alias("k"), scalar.merge_paths(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.c for r in rows] == [True, False, False, False, False, False]
    assert [r.k for r in rows] == [True, True, True, False, True, False]
    assert [r.m for r in rows] == [["a", "b", "c"], ["a", "b", "c"], ["a", "???", "b", "c"], None, ["a", "b", "c"], None]
    s = spark.createDataFrame([(["???", "a", "???", "b", "???"],), (["???"],)], "p array<string>").select(scalar.trim_spacers(F.col("p")).alias("t"), scalar.split_spacers(F.col("p")).alias("s")).collect()
    assert s[0].t == ["a", "???", "b"] and s[1].t == [] and s[0].s == [["a"], ["b"]]


def test_assignment_cascade(spark):
    tx = spark.createDataFrame([("t1", ["TSS:1", "E:1", "I:1", "E:2"]), ("t2", ["E:1", "I:1", "E:2", "I:2", "E:3"]), ("t3", ["E:9"])], "tx_id string, path array<string>")
    p = spark.createDataFrame([(1, ["TSS:1", "E:1", "I:1", "E:2"]), (2, ["I:1", "E:2"]), (3, ["E:1", "I:1", "E:2", "POLYA:7"]), (4, ["Q"])], "path_id int, path array<string>")
    got = sorted((r.path_id, r.tx_id, r.tier) for r in paths.assign_paths(p, tx).collect())
    assert got == [(1, "t1", 1), (2, "t1", 2), (2, "t2", 2), (3, "t1", 4)]


def test_components_and_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (9, 9)], "u long, v long")
    assert dict(graph.connected_components(e).collect()) == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}
    x = spark.createDataFrame([("a", "c", "+", 1, 10), ("b", "c", "+", 11, 20), ("d", "c", "+", 21, 30), ("e", "c", "+", 41, 50)], "node_id string, contig string, strand string, lend long, rend long")
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("b", "i"), ("i", "e")], "src string, dst string")
    assert sorted((r.lend, r.rend) for r in graph.merge_unbranched(x, edges).collect()) == [(1, 20), (21, 30), (41, 50)]


def test_categories(spark):
    seg = "array<struct<lend:int,rend:int>>"
    ref = spark.createDataFrame([("t1", "c", "+", [(100, 200), (300, 400), (500, 600)]), ("t2", "c", "+", [(2000, 2100)])], f"tx_id string, contig string, strand string, segments {seg}")
    f = [("fsm", "+", [(150, 200), (300, 400), (500, 550)]), ("ism", "+", [(150, 200), (300, 380)]), ("nic", "+", [(150, 200), (500, 550)]), ("nnic", "+", [(150, 200), (320, 400)]), ("genic", "+", [(150, 190), (320, 390)]), ("anti", "-", [(150, 190), (320, 390)]), ("inter", "+", [(9000, 9100), (9200, 9300)]), ("se_fm", "+", [(2000, 2099)]), ("se_im", "+", [(2050, 2099)]), ("se_exonic", "+", [(310, 390)]), ("se_genic", "+", [(190, 210)]), ("se_intronic", "+", [(220, 230)]), ("se_anti", "-", [(220, 230)]), ("se_inter", "-", [(9000, 9001)])]
    d = spark.createDataFrame([(n, "c", s, x) for n, s, x in f], f"feature_id string, contig string, strand string, segments {seg}")
    add = lambda t: t.withColumn("introns", scalar.introns_of(F.col("segments")))
    got = {r.feature_id: r.category for r in classify.classify(add(d), add(ref)).collect()}
    assert got == {"fsm": "FSM", "ism": "ISM", "nic": "NIC", "nnic": "NNIC", "genic": "genic", "anti": "antisense", "inter": "intergenic", "se_fm": "se_FM", "se_im": "se_IM", "se_exonic": "se_exonic", "se_genic": "se_genic", "se_intronic": "se_intronic", "se_anti": "se_antisense", "se_inter": "se_intergenic"}


def test_orf():
    assert classify.longest_orf_of("CCATGAAATAGATGTTTTTTTTTCC") == (11, 23, "MFFF")
    assert classify.longest_orf_of("") == (0, 0, "")


def test_adjusted_p(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, 0.222, 0.251, 0.269, 0.275, 0.34, 0.341, 0.384, 0.569, 0.594, 0.696, 0.762, 0.94, 0.942, 0.975, 0.986, 1e-200, 0.0]
    got = {r.i: r.adj_p_value for r in statistics.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)) + [(99, None)], "i int, p_value double")).collect()}
    order, m, low, want = sorted(range(len(p)), key=lambda k: -p[k]), len(p), 1.0, {99: None}
    for place, k in enumerate(order):
        low = min(low, p[k] * m / (m - place))
        want[k] = low
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want if want[k] is not None)


def test_saturation_fit():
    x = np.arange(1, 50.0)
    v, k, _ = statistics.saturation_fit(x, 80 * x / (12 + x))
    assert v == pytest.approx(80, rel=1e-4) and k == pytest.approx(12, rel=1e-3)
    v, k, _ = statistics.saturation_fit(x, 30 * (1 - np.exp(-0.1 * x)), "exp")
    assert v == pytest.approx(30, rel=1e-4) and k == pytest.approx(0.1, rel=1e-3)


def bam_bytes():
    def record(name, ref, pos, flag, ops, seq, tags):
        packed = bytes("=ACMGRSVTWYHKDBN".index(a) << 4 | "=ACMGRSVTWYHKDBN".index(b) for a, b in zip(seq[::2], seq[1::2] + "=" * (len(seq) % 2), strict=True))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + packed + b"\xff" * len(seq) + tags
        return struct.pack("<i", len(body)) + body

    raw = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    raw += record("r1", 0, 99, 16, [(3, "S"), (5, "M")], "ACGTNACG", b"NMC\x02CBZAAA\0") + record("r2", -1, -1, 4, [], "", b"")
    out = b""
    for part in (raw[:50], raw[50:], b""):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += c.compress(part) + c.flush()
    return out


def test_readers(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bam_bytes())
    rows = sorted(readers.read_bam(spark, str(tmp_path / "x.bam")).collect())
    assert (rows[0].read_name, rows[0].contig, rows[0].pos, rows[0].cigar, rows[0].seq, rows[0].tags) == ("r1", "chr1", 100, "3S5M", "ACGTNACG", {"NM": "2", "CB": "AAA"}) and rows[1].contig == "*"
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nr1\t0\tchr1\t5\t60\t3M\t*\t0\t0\tACG\tIII\tNM:i:1\tCB:Z:x:y\n")
    s = readers.read_sam(spark, str(tmp_path / "x.sam")).first()
    assert s.tags == {"NM": "1", "CB": "x:y"} and s.pos == 5
    gtf = '# c\nchr1\ts\ttranscript\t10\t50\t.\t+\t.\tgene_id "g"; transcript_id "t"; TPM "3";\nchr1\ts\texon\t30\t50\t.\t+\t.\tgene_id "g"; transcript_id "t";\nchr1\ts\texon\t10\t20\t.\t+\t.\tgene_id "g"; transcript_id "t"; transcript_id "t";\nshort\n'
    (tmp_path / "x.gtf").write_text(gtf)
    t = readers.transcripts_of(readers.read_gtf(spark, str(tmp_path / "x.gtf")))
    row = t.first()
    assert [tuple(e) for e in row.exons] == [(10, 20), (30, 50)] and row.meta["TPM"] == "3"
    assert [r.value.split("\t")[2:5] for r in writers.gtf_lines(t).orderBy("ordinal").collect()] == [["transcript", "10", "50"], ["exon", "10", "20"], ["exon", "30", "50"]]
    assert writers.bed12(t).first().value == "chr1\t9\t50\tt\t0\t+\t9\t50\t0\t2\t11,21\t0,20"
    (tmp_path / "x.fa").write_text(">c1 desc\nACGT\nAC\n>c2\nGG\n")
    fa = sorted((r.contig, r.start, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "x.fa"), bin_size=4).collect())
    assert fa == [("c1", 1, "ACGT"), ("c1", 5, "AC"), ("c2", 1, "GG")]
    m = tmp_path / "m"
    m.mkdir()
    (m / "features.tsv").write_text("g1\tx\ng2\ty\n")
    (m / "barcodes.tsv").write_text("b1\nb2\n")
    (m / "matrix.mtx").write_text("%%MatrixMarket\n%c\n2 2 2\n1 2 5\n2 1 7\n")
    assert sorted(map(tuple, readers.read_mtx(spark, str(m)).collect())) == [("g1", "b2", 5.0), ("g2", "b1", 7.0)]
    assert readers.parse_region("chr1+:1,000-2,000") == ("chr1", "+", 1000, 2000)


def test_saturation_models(spark):
    from isoweave.operators.statistics import saturation_models

    xs = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
    rows = [("m", x, 100 * x / (5 + x)) for x in xs] + [("e", x, 50 * (1 - 2.718281828459045 ** (-0.2 * x))) for x in xs] + [("few", 1.0, 2.0), ("zero", 1.0, 0.0), ("zero", 2.0, 0.0), ("zero", 3.0, 0.0), ("m", None, 3.0)]
    got = {r["c"]: r for r in saturation_models(spark.createDataFrame(rows, "c string, x double, y double"), "c").collect()}
    assert got["m"]["model"] == "mm" and abs(got["m"]["vmax"] - 100) < 1e-4 and abs(got["m"]["x_at_95"] - 95) < 1e-3
    assert got["e"]["model"] == "exp" and abs(got["e"]["vmax"] - 50) < 1e-4 and abs(got["e"]["x_at_95"] - 14.97866) < 1e-3
    assert got["few"]["model"] is None and got["zero"]["vmax"] is None
