"""Graph building, read mapping and isoform discovery on a hand-made locus."""

from pyspark.sql import functions as F

from isoweave.config import Config
from isoweave.functions.scalar import introns_of
from isoweave.operators import assembly

SEG = "array<struct<lend:int,rend:int>>"


def locus(spark):
    long = [(100, 200), (301, 400), (501, 600)]
    skip = [(100, 200), (501, 600)]
    rows = [(f"l{i}", long) for i in range(6)] + [(f"s{i}", skip) for i in range(3)] + [("p1", [(150, 200), (301, 390)]), ("bad", [(100, 200), (333, 400)]), ("far", [(5000, 5300)]), ("far2", [(5000, 5300)])]
    d = spark.createDataFrame([(n, "c", "+", s) for n, s in rows], f"read_id string, contig string, strand string, segments {SEG}")
    return d.withColumn("introns", introns_of(F.col("segments")))


def test_discovery(spark):
    reads = locus(spark)
    nodes, edges = assembly.build_graph(reads)
    got = {(r.kind, r.lend, r.rend) for r in nodes.collect()}
    assert {("intron", 201, 300), ("intron", 401, 500), ("intron", 201, 500)} <= got and ("intron", 201, 332) not in got
    assert edges.count() == 6
    mapped = {r.read_id: r.path for r in assembly.map_reads(reads, nodes).collect()}
    assert "???" in mapped["bad"] and "???" not in mapped["l0"] and len(mapped["l0"]) == 5
    found = assembly.discover(reads, Config()).collect()
    exons = sorted(tuple(tuple(e) for e in r.exons) for r in found)
    assert exons == [((100, 200), (301, 400), (501, 600)), ((100, 200), (501, 600)), ((5000, 5300),)]
    assert len({r.gene_id for r in found}) == 2
    assert max(r.n_reads for r in found) == 7.0
    assert assembly.discover(reads.limit(0)).count() == 0


def test_degradation_and_catalog(spark):
    d = spark.createDataFrame([("g", "a", ["1", "2", "3"], 10.0, 5, 9), ("g", "b", ["2", "3"], 4.0, None, 9), ("g", "c", ["1", "2"], 4.0, 5, 7), ("g", "d", ["2"], 1.0, 6, 8)], "gene_id string, tx_id string, path array<string>, n_reads double, tss int, polya int")
    assert sorted((r.tx_id, r.n_reads) for r in assembly.prune_degraded(d).collect()) == [("a", 15.0), ("c", 4.0)]
    t = spark.createDataFrame([("x", "t1", "c", "+", [(1, 10), (21, 30)]), ("y", "t2", "c", "+", [(5, 10), (21, 40)]), ("y", "t3", "c", "+", [(5, 10)])], f"source string, tx_id string, contig string, strand string, exons {SEG}")
    row = assembly.merge_catalogs(t).collect()
    assert len(row) == 1 and [tuple(e) for e in row[0].exons] == [(1, 10), (21, 40)] and row[0].n_sources == 2


def test_config():
    c = Config().overlay('{"min_per_id": "90", "unknown": 1, "allow_secondary_alignments": "false"}')
    assert c.min_per_id == 90.0 and c.allow_secondary_alignments is False and Config().hifi().min_per_id == 97.0
