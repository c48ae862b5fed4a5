"""Steps that the findings of round 3 named: what meets where, and that nothing is moved for each pair."""

from isoweave.operators import assembly, filters, intervals, paths, quantify, sequences
from isoweave.plans.graphs import exons_inside_introns


def test_nodes_of_a_read_come_from_tiles(spark):
    """nodes longer than a tile, a node that two segments share, and an intron that is no node."""
    nodes = spark.createDataFrame([("n1", "exon", "c", "+", 1, 100), ("n2", "exon", "c", "+", 101, 103), ("n3", "exon", "c", "+", 104, 300), ("i", "intron", "c", "+", 51, 59)], "node_id string, kind string, contig string, strand string, lend int, rend int")
    rows = [("r", "c", "+", [(40, 50), (60, 110)], [(51, 59)]), ("s", "c", "+", [(120, 130), (140, 200)], [(131, 139)]), ("t", "c", "+", [(900, 950)], [])]
    reads = spark.createDataFrame(rows, "read_id string, contig string, strand string, segments array<struct<lend:int,rend:int>>, introns array<struct<lend:int,rend:int>>")
    for tile in (16, 4096):
        d = assembly.map_reads(reads, nodes, tile=tile)
        assert {r.read_id: (r.path, r.lend, r.rend) for r in d.collect()} == {"r": (["n1", "i", "n2", "n3"], 40, 110), "s": (["n3", "???"], 120, 200)}


def test_distance_behind_the_last_shared_node(spark):
    """weights' distances come with the test of path and transcript, without a row for each of their nodes."""
    t = spark.createDataFrame([("g", 1, ["a", "b", "c", "d"]), ("g", 2, ["a", "b"])], "gene_id string, tx_id long, path array<string>")
    lengths = spark.createDataFrame([("a", 1), ("b", 10), ("d", 1000)], "node string, length int")
    p = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["x", "a"])], "path_id long, path array<string>")
    genes = paths.best_anchors(p, t)
    assert sorted((r.path_id, r.gene_id, r.shared) for r in genes.collect()) == [(1, "g", 2), (2, "g", 1), (3, "g", 1)]
    d = paths.assign_paths(p, t, genes, behind=quantify.bases_behind(t, lengths))
    assert sorted((r.path_id, r.tx_id, r.tier, r.distance) for r in d.collect()) == [(1, 2, 1, 0), (2, 1, 2, 1000), (2, 2, 2, 0), (3, 1, 4, 1010), (3, 2, 4, 10)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_best_anchors_count_no_pairs(spark):
    """ties stay, a gene without a name counts, and no pair of path and gene is a row before the best are known."""
    t = spark.createDataFrame([("g", ["a", "b"]), ("g", ["b", "c"]), ("h", ["a", "x"]), (None, ["c", "b", "a"]), ("k", [None, "z"])], "gene_id string, path array<string>")
    p = spark.createDataFrame([(1, ["a", "b", "c", "c"]), (2, ["x", "a"]), (3, ["a"]), (4, [None]), (5, ["q"])], "path_id long, path array<string>")
    d = paths.best_anchors(p, t)
    want = paths.majority(paths.anchors(p, t))
    rows = lambda x: sorted(((r.path_id, r.gene_id or "", r.shared) for r in x.collect()))
    assert rows(d) == rows(want) == [(1, "", 3), (1, "g", 3), (2, "h", 2), (3, "", 1), (3, "g", 1), (3, "h", 1)]
    assert not any("Aggregate [path_id" in x and "gene_id" in x.split("]")[0] for x in plan(d).splitlines())


def test_fractions_are_made_where_paths_meet(spark):
    """no sum over pairs of path and transcript."""
    p = spark.createDataFrame([(1, ["a", "b", "b", "z"]), (2, ["c"])], "path_id long, path array<string>")
    t = spark.createDataFrame([(7, ["b", "a", "a"]), (8, ["z", "b"])], "tx_id long, path array<string>")
    lengths = spark.createDataFrame([("a", 1), ("b", 3), ("c", 5)], "node string, length int")
    d = paths.overlap_fractions(p, t, lengths)
    assert sorted(tuple(r) for r in d.collect()) == [(1, 7, 1.0), (1, 8, 0.75)]
    assert not any("Aggregate" in x and "tx_id" in x for x in plan(d).splitlines())


def test_intron_sets_are_compared_where_they_meet(spark):
    """no distinct over pairs."""
    r = spark.createDataFrame([(1, [1, 2]), (2, [2, 3, 9]), (3, [8])], "read_id long, introns array<int>")
    t = spark.createDataFrame([(7, [1, 2]), (8, [3, 2, 9, 4])], "tx_id long, introns array<int>")
    d = paths.same_introns(r, t)
    assert sorted(tuple(x) for x in d.collect()) == [(1, 7, "equal"), (1, 8, "mixed"), (2, 7, "mixed"), (2, 8, "subset")]
    assert not any("Aggregate" in x for x in plan(d).splitlines())


def test_degraded_forms_of_many_genes_need_no_group_each(spark):
    """the same rows for many small genes, which pass a task as one stream."""
    rows = [(g, f"{g}-{k}", path, 10.0, None, None) for g in range(300) for k, path in (("a", ["x", "y", "z"]), ("b", ["y", "z"]), ("c", ["z", "y"]), ("d", []))]
    t = spark.createDataFrame(rows, "gene_id int, tx_id string, path array<string>, n_reads double, tss int, polya int")
    d = assembly.prune_degraded(t)
    assert sorted((r.tx_id, r.n_reads) for r in d.collect()) == sorted((f"{g}-{k}", n) for g in range(300) for k, n in (("a", 20.0), ("c", 10.0), ("d", 10.0)))
    assert "FlatMapGroups" not in plan(d)


def test_a_read_meets_its_nodes_once(spark):
    """Reads inside one stretch of tiles pass no second shuffle; those of several stretches are whole again."""
    nodes = spark.createDataFrame([("E:c:+:1-400", "exon", "c", "+", 1, 400), ("E:c:+:700-900", "exon", "c", "+", 700, 900), ("I:c:+:401-699", "intron", "c", "+", 401, 699)], "node_id string, kind string, contig string, strand string, lend int, rend int")
    rows = [("r", "c", "+", [(10, 400), (700, 710)], [(401, 699)]), ("s", "c", "+", [(20, 30)], []), ("s", "c", "+", [(800, 810)], []), ("t", "c", "+", [(20, 30), (40, 50)], [(31, 39)])]
    reads = spark.createDataFrame(rows, "read_id string, contig string, strand string, segments array<struct<lend:int,rend:int>>, introns array<struct<lend:int,rend:int>>")
    d = assembly.map_reads(reads, nodes, tile=4)
    chain = ["E:c:+:1-400", "I:c:+:401-699", "E:c:+:700-900"]
    assert sorted((r.read_id, r.path) for r in d.collect()) == [("r", chain), ("s", chain[:1]), ("s", chain[2:]), ("t", ["E:c:+:1-400", "???"])]
    # a repeated name is two alignments, and a path with a spacer is left out; bounds come with the ids of nodes
    counted = sorted(tuple(r) for r in assembly.counted_paths(d).select("path", "lend", "rend", "length", "n_reads").collect())
    assert counted == [(chain[:1], 1, 400, 400, 1), (chain, 1, 900, 601, 1), (chain[2:], 700, 900, 201, 1)]
    assert len({r.component for r in assembly.counted_paths(d).collect()}) == 1
    assert sum(" Aggregate [read_id" in x or "Aggregate [read_id" in x for x in plan(d).splitlines()) == 1


def test_sequences_come_from_stretches(spark):
    """spans across stretches are whole, and no bases are gathered for each piece of the genome."""
    text = "".join("ACGT"[(k * k + k // 7) % 4] for k in range(700))
    genome = spark.createDataFrame([("c", k, text[k * 2 : k * 2 + 2]) for k in range(350)], "contig string, bin long, seq string")
    rows = [("p", "c", "+", [(3, 9), (120, 400)]), ("m", "c", "-", [(128, 129)]), ("end", "c", "+", [(699, 705)]), ("out", "c", "+", [(900, 905)])]
    t = spark.createDataFrame(rows, "tx_id string, contig string, strand string, exons array<struct<lend:int,rend:int>>")
    turned = text[127:129][::-1].translate(str.maketrans("ACGT", "TGCA"))
    got = {r.tx_id: r.seq for r in sequences.transcript_sequences(t, genome, bin_size=2).collect()}
    assert got == {"p": text[2:9] + text[119:400], "m": turned, "end": text[698:]}
    spans = spark.createDataFrame([(k, "c", k, k + 4) for k in (0, 1, 126, 127, 128, 129, 698, 800)], "k long, contig string, lend long, rend long")
    d = sequences.fetch(spans, genome, "k", bin_size=2, longest=5)
    assert {r.k: r.seq for r in d.collect()} == {k: text[k - 1 : k + 4] for k in (1, 126, 127, 128, 129, 698)}
    assert not any("Aggregate [k" in x for x in plan(d).splitlines())


def test_tasks_follow_the_rows(spark, monkeypatch):
    """A task's rows are bounded, by the one shuffle of the merge and by those of pairs."""
    monkeypatch.setattr(intervals, "TASK_ROWS", 2)
    e = spark.createDataFrame([("c", "+", t, k, k + 5) for k in range(0, 3000, 50) for t in (1, 2)], "contig string, strand string, tx_id int, lend int, rend int")
    tasks = intervals.task_count(e)
    assert tasks == 60
    assert intervals.merge_intervals(e, ["contig", "strand", "tx_id"], cut=None).rdd.getNumPartitions() == tasks
    d = intervals.pair_overlap(e, "tx_id")
    assert [tuple(r) for r in d.collect()] == [(1, 2, 360)] and d.rdd.getNumPartitions() == 2 * tasks


def test_single_exons_are_spread(spark):
    """rows without a chain don't meet in one task, and are novel beside a reference without a chain."""
    t = spark.createDataFrame([(k, None) for k in range(200)] + [(200, "a"), (201, "b")], "tx_id int, chain string")
    d = filters.known_or_novel(t, t.where("tx_id IN (1, 200)"))
    assert [r.tx_id for r in d.where("is_known").collect()] == [200] and d.count() == 202
    assert "__part" in [x for x in plan(d).splitlines() if "Join" in x][0]


def test_alignments_are_parsed_once(spark):
    """exons and introns come from one pass."""
    a = spark.createDataFrame([(f"r{k}", "c", "+", 10, "5M30N5M") for k in range(4)] + [("s", "c", "+", 20, "9M")], "read_id string, contig string, strand string, pos int, cigar string")
    d = exons_inside_introns(a)
    assert "regexp_extract_all" not in plan(d)
    assert sorted((r.lend, r.rend, r.support) for r in d.collect()) == [(10, 14, 4), (45, 49, 4)]
