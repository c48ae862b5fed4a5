"""Plans and results of steps that must not grow faster than their input."""

import contextlib
import io
import random
import time

import numpy as np
from pyspark.sql import functions as F

from isoweave.operators import communities, graph, intervals, paths, quantify


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


PATHS = [(1, ["a", "b", "c"]), (2, ["b", "c"]), (3, ["c", "a", "c"]), (4, ["x"]), (5, ["x", "y"]), (6, []), (7, ["z"])]


def test_pairs_are_not_shuffled(spark):
    p = spark.createDataFrame(PATHS, "path_id long, path array<string>")
    got = sorted((r.path_id, r.path_id_2, r.relation) for r in paths.relations(p).collect())
    assert got == [(1, 2, "contains"), (1, 3, "compatible"), (2, 3, "compatible"), (4, 5, "contained")]
    assert "Aggregate" not in plan(paths.relations(p)) and plan(paths.relations(p)).count("Join") == 1


def test_candidates_in_a_gene_share_a_node(spark):
    t = spark.createDataFrame([("g", 1, ["a", "b", "c"]), ("g", 2, ["d"]), ("g", 3, ["POLYA:1", "TSS:2"]), ("h", 4, ["a", "b"])], "gene_id string, tx_id long, path array<string>")
    p = spark.createDataFrame([(1, ["a", "b"]), (2, ["TSS:9"]), (3, ["TSS:1", "d"]), (4, ["POLYA:1"])], "path_id long, path array<string>")
    genes = spark.createDataFrame([(k, "g") for k in (1, 2, 3, 4)], "path_id long, gene_id string")
    d = paths.assign_paths(p, t, genes)
    assert sorted((r.path_id, r.tx_id, r.tier) for r in d.collect()) == [(1, 1, 2), (2, 3, 5), (3, 2, 3), (4, 3, 2)]
    joins = [x for x in plan(d).splitlines() if "Join" in x and "gene_id" in x]
    assert joins and all("node" in x for x in joins if "gene_id_2" in x) and any("gene_id_2" in x for x in joins)


def plain_filter(sets, least):
    """C14 by plain loops: shares of each isoform, the weakest dropped until none is below ``least``."""
    alive = sorted({t for s, _ in sets for t in s})
    while True:
        p = {t: 1 / len(alive) for t in alive}
        for _ in range(1000):
            new = dict.fromkeys(alive, 0.0)
            for s, n in sets:
                own = [t for t in s if t in p]
                for t in own:
                    new[t] += n * p[t] / sum(p[x] for x in own)
            total = sum(new.values())
            new = {t: x / total for t, x in new.items()}
            moved, p = sum((new[t] - p[t]) ** 2 for t in alive) ** 0.5, new
            if moved < 1e-6:
                break
        weak = [t for t in alive if p[t] < least]
        if not weak or len(alive) == 1:
            return p
        alive.remove(min(weak, key=lambda t: (p[t], -t)))


def test_filter_isoforms_of_large_genes(spark):
    r = random.Random(3)
    sets = {tuple(sorted(r.sample(range(12), r.randrange(1, 4)))): float(r.randrange(1, 30)) for _ in range(60)}
    c = spark.createDataFrame([("g", list(s), n) for s, n in sets.items()], "gene_id string, txs array<int>, n_reads double")
    got = {x.tx_id: x.isoform_fraction for x in quantify.filter_isoforms(c, min_fraction=0.09).collect()}
    want = plain_filter(list(sets.items()), 0.09)
    assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-4 for t in want)
    # 1500 isoforms, dropped one by one: searching lists for each of their 60000 rows took minutes
    many = [("g", sorted({k % 1500, k * 7 % 1500}), 1.0 + k % 5) for k in range(30000)]
    began = time.time()
    d = spark.createDataFrame(many, "gene_id string, txs array<int>, n_reads double").groupBy("gene_id", "txs").agg(F.sum("n_reads").alias("n_reads"))
    assert abs(quantify.filter_isoforms(d, min_fraction=0.001).agg(F.sum("isoform_fraction")).first()[0] - 1) < 1e-9 and time.time() - began < 120


def test_patterns_meet_at_their_first_intron(spark):
    # chains under one id: a join by it would meet every read with every chain
    t = spark.createDataFrame([(0, ["a", "b", "c"]), (0, ["b", "d"]), (0, ["x"])], "tx_id int, introns array<string>")
    r = spark.createDataFrame([(1, ["b", "c"]), (2, ["b"]), (3, ["d", "b"]), (4, [])], "read_id int, introns array<string>")
    d = paths.subset_of_patterns(r, t)
    assert sorted(x.read_id for x in d.collect()) == [1, 2, 2]
    assert not any("Join" in x and "tx_id" in x for x in plan(d).splitlines())


def test_components_merge_as_in_rounds(spark):
    r = random.Random(5)
    edges = [(100 * c + u, 100 * c + v, r.randrange(1, 6)) for c in range(3) for u in range(14) for v in range(u + 1, 14) if r.random() < 0.4]
    e = spark.createDataFrame(edges, "u long, v long, w long")
    one, rounds = (sorted(map(tuple, communities.merged_communities(e, resolution=4.0, most_edges=k).collect())) for k in (10**6, 0))
    assert one == rounds and len({c for _, c in one}) > 3
    mixed = sorted(map(tuple, communities.merged_communities(e, resolution=4.0, most_edges=sum(u < 100 for u, _, _ in edges) - 1).collect()))
    assert mixed == one


def test_best_overlap_sums_before_its_shuffle(spark):
    r = random.Random(7)
    x = [("c", "+", k % 9, *sorted((r.randrange(3000), r.randrange(3000)))) for k in range(60)]
    e = spark.createDataFrame(x, "contig string, strand string, tx_id int, lend long, rend long")
    reads = [(k, "c", "+", a, a + n) for k, (a, n) in enumerate((r.randrange(-50, 3000), r.choice([0, 30, 63, 64, 2000])) for _ in range(80))]
    d = intervals.best_overlap(spark.createDataFrame(reads, "read_id int, contig string, strand string, lend long, rend long"), e)
    covered = {t: {p for *_, tx, a, b in x if tx == t for p in range(a, b + 1)} for t in range(9)}
    want = {k: min((-len(covered[t] & set(range(a, b + 1))), t) for t in range(9)) for k, _, _, a, b in reads}
    assert {y.read_id: (-y.overlap, y.tx_id) for y in d.collect()} == {k: m for k, m in want.items() if m[0] < 0}
    assert "hashpartitioning(read_id#" in plan(d) and ", tx_id#" not in "".join(y for y in plan(d).splitlines() if "hashpartitioning(read_id" in y)


def test_segment_graph_is_that_of_the_edges(spark):
    r = random.Random(5)
    own = [("c", r.choice("+-"), a, a + r.randrange(1, 30)) for a in (r.randrange(1, 400) for _ in range(60))]
    starts, ends = {(s, a) for _, s, a, _ in own}, {(s, b) for _, s, _, b in own}
    gaps = [("c", s, b + 1, a - 1) for s, b in ends for t, a in starts if s == t and b + 1 < a <= b + 40]
    x, i = (spark.createDataFrame(d, "contig string, strand string, lend long, rend long") for d in (own, gaps))
    name = lambda d, k: d.withColumn("node_id", F.concat_ws("-", F.lit(k), "contig", "strand", "lend", "rend"))
    segments = name(intervals.exon_segments(x), "E")
    edges = intervals.adjacency(segments, name(i, "I"))
    plain = {n.node: (n.n_next, n.n_previous) for n in graph.neighbours(edges).collect()}
    kept = {n.node_id for n in graph.prune_spurs(segments.withColumn("is_ref", F.lit(False)), edges, shorter_than=9).collect()}
    chains = sorted(tuple(n) for n in graph.merge_unbranched(segments, edges).collect())
    for cut in (16, 1 << 16):
        d = name(graph.segment_graph(x, i, cut=cut), "E")
        assert {n.node_id: (n.n_next, n.n_previous) for n in d.collect()} == {n.node_id: plain.get(n.node_id, (0, 0)) for n in segments.collect()}
        assert {n.node_id for n in graph.without_spurs(d, shorter_than=9).collect()} == kept
        assert sorted(tuple(n) for n in graph.merge_linked(d).collect()) == chains
    assert len(chains) < segments.count()
    assert "Join" in plan(edges) and "concat_ws" not in plan(graph.segment_graph(x, i))


def test_spurs_and_chains_without_edges(spark):
    # a dead end of 3 bases (28-30) beside the intron that leaves at 28; touching segments 1-9 and 10-27 are one chain
    x = spark.createDataFrame([("c", "+", 1, 27), ("c", "+", 10, 30), ("c", "+", 41, 60)], "contig string, strand string, lend long, rend long")
    i = spark.createDataFrame([("c", "+", 28, 40)], "contig string, strand string, lend long, rend long")
    d = graph.segment_graph(x, i)
    assert sorted((r.lend, r.rend) for r in d.collect()) == [(1, 9), (10, 27), (28, 30), (41, 60)]
    assert sorted((r.lend, r.rend) for r in graph.without_spurs(d, shorter_than=4).collect()) == [(1, 9), (10, 27), (41, 60)]
    assert sorted((r.lend, r.rend, r.n_merged) for r in graph.merge_linked(d).collect()) == [(1, 27, 2), (28, 30, 1), (41, 60, 1)]


def test_cross_gene_em_in_parts_and_in_rounds(spark):
    # parts without a common read in one component of genes: one group, parts and rounds must agree
    r = random.Random(11)
    rows = [(t % 3, t, k) for part in range(3) for k in range(part * 100, part * 100 + 60) for t in r.sample(range(part * 6, part * 6 + 6), r.randrange(1, 4))]
    d = spark.createDataFrame(rows + [(9, 99, 999)], "gene_id int, tx_id int, read_id int").withColumn("frac", F.lit(1.0))
    counts = d.groupBy("gene_id", "tx_id").agg(F.count(F.lit(1)).cast("double").alias("all_reads"))
    index = {t: i for i, t in enumerate(sorted({t for _, t, _ in rows}))}
    n = [sum(t == x for _, t, _ in rows) for x in index]
    for rounds in (7, 250):
        want, _, done = quantify.em_arrays(np.array([index[t] for _, t, _ in rows]), np.unique([k for _, _, k in rows], return_inverse=True)[1], np.ones(len(rows)), np.ones(len({k for _, _, k in rows})), alpha=0.01, max_iter=rounds, tolerance=1e-4, start=np.array(n, float), norm="l1", floor=1e-8)
        assert done == 7 if rounds == 7 else 7 < done < 250
        for most in (2_000_000, 10) if rounds == 7 else (2_000_000,):
            got = {(x.tx_id, x.read_id): x.frac for x in quantify.cross_gene_em(d, counts, max_iter=rounds, tolerance=1e-4, most_rows=most).collect()}
            assert len(got) == len(rows) + 1 and got[99, 999] == 1.0
            assert max(abs(got[t, k] - w) for (_, t, k), w in zip(rows, want, strict=True)) < 1e-9
    assert "part" in "".join(x for x in plan(quantify.cross_gene_em(d, counts, max_iter=3)).splitlines() if "FlatMapGroupsInPandas" in x)


def test_subsets_meet_at_their_rarest_intron(spark):
    sets = {1: "abc", 2: "bc", 3: "c", 4: "cd", 5: "bc", 6: "x", 7: "c"}
    d = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s] + [(7, None), (8, None)], "tx_id int, intron string")
    got = sorted((r.tx_id, r.tx_id_2) for r in paths.subset_pairs(d).collect())
    assert got == sorted((a, b) for a, s in sets.items() for b, t in sets.items() if a != b and b != 7 and set(t) <= set(s))
    assert "Aggregate" not in plan(paths.subset_pairs(d)) and plan(paths.subset_pairs(d)).count("Join") == 1
