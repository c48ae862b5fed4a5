"""Steps that the findings of round 4 named."""

import re

import numpy as np

from pyspark.sql import functions as F

from isoweave.operators import communities, paths, sequences
from isoweave.plans import graphs


def test_merging_rounds_touch_what_merged(spark):
    """a graph that merges one pair a round, far more often than joins may run, and the same as by all edges each round."""

    def plain(a, b, w, n, total, resolution):
        degree, label = np.bincount(a, weights=w, minlength=n) + np.bincount(b, weights=w, minlength=n), np.arange(n)
        while True:
            gain, best = np.round(w - resolution * degree[a] * degree[b] / total, 9), {}
            for g, x, y in zip(-gain, a, b, strict=True):
                if g < 0:
                    for v in (x, y):
                        best[v] = min(best.get(v, (0, 0, 0)), (g, x, y))
            both = [m[1:] for v, m in best.items() if v == m[1] and best[m[2]] == m]
            if not both:
                return label
            to = np.arange(n)
            for x, y in both:
                to[y] = x
            label, degree, sums = to[label], np.bincount(to, weights=degree, minlength=n), {}
            for x, y, k in zip(to[a], to[b], w, strict=True):
                if x != y:
                    sums[min(x, y), max(x, y)] = sums.get((min(x, y), max(x, y)), 0) + k
            a, b, w = np.array([x for x, _ in sums], int), np.array([y for _, y in sums], int), np.array(list(sums.values()), float)

    r = np.random.default_rng(7)
    for t in range(40):
        n = int(r.integers(2, 40))
        x, y = np.triu_indices(n, 1)
        k = r.choice(len(x), int(r.integers(1, len(x) + 1)), replace=False)
        w = r.integers(1, 4, len(k)).astype(float)
        how = {"total": 2 * w.sum(), "resolution": (1.0, 0.3)[t % 2]}
        assert (communities.merge_pairs(x[k], y[k], w, n, **how) == plain(x[k], y[k], w, n, **how)).all()
    star = [(0, k, float(k)) for k in range(1, 60)]
    d = communities.merged_communities(spark.createDataFrame(star, "u int, v int, w double"), resolution=0.01, max_rounds=2, most_edges=58)
    assert sorted(tuple(x) for x in d.collect()) == [(k, 0) for k in range(60)]


def test_paths_meet_candidates_only(spark):
    """a path is tested against transcripts that hold its first node or begin in it, not against all of its gene."""
    rows = [("g", k, [f"n{k}", f"n{k + 1}", f"n{k + 2}"]) for k in range(0, 300)] + [("h", 1, ["n5", "x"])]
    t = spark.createDataFrame(rows, "gene_id string, tx_id long, path array<string>")
    p = spark.createDataFrame([(1, ["n5", "n6"]), (2, ["n290", "n291", "n292", "n293"])], "path_id long, path array<string>")
    genes = spark.createDataFrame([(1, "g"), (1, "h"), (2, "g")], "path_id long, gene_id string")
    d = paths.assign_paths(p, t, genes)
    assert sorted((r.path_id, r.tx_id, r.tier) for r in d.collect()) == [(1, 4, 2), (1, 5, 2), (2, 290, 3), (2, 291, 3)]
    joins = [x for x in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert any(re.search(r"tx_id#\d+L = tx_id#\d+L", x) for x in joins) and not any("array_contains" in x for x in joins), joins


def test_tests_of_a_pair_are_made_once(spark):
    """no filter repeats the tests, and whole paths are compared only where the last nodes of what overlaps are equal."""
    p = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c", "d"]), (3, ["b", "x"]), (4, [None, "a"]), (5, ["POLYA:1"])], "path_id long, path array<string>")
    t = spark.createDataFrame([(1, ["a", "b"]), (2, ["z", "a", "b", "c"]), (3, ["b", "c", "TSS:1"]), (4, ["POLYA:1"])], "tx_id long, path array<string>")
    d = paths.assign_paths(p, t)
    assert sorted((r.path_id, r.tx_id, r.tier) for r in d.collect()) == [(1, 1, 1), (2, 1, 4), (2, 2, 4), (3, 1, 4), (4, 1, 4), (5, 4, 1)]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert not any(("Filter" in x or "Join" in x) and "array_position" in x for x in plan.splitlines())


def test_clips_of_both_ends_and_inside_segments(spark):
    """an intron that ends inside the segment, one at the right end, and one behind a deletion."""
    text = "".join("ACGT"[(k * k + 3 * k + k // 5) % 4] for k in range(400))
    at = lambda a, b: text[a - 1 : b]
    genome = spark.createDataFrame([("c", k, text[k * 4 : k * 4 + 4]) for k in range(100)], "contig string, bin long, seq string")
    introns = spark.createDataFrame([("c", "+", 101, 203), ("c", "+", 231, 300)], "contig string, strand string, lend long, rend long")
    # the alignment runs three bases into the first intron and two into the second: what stands there is beyond them
    start, stop = at(93, 100), at(301, 307)
    a = [("left", 201, "5S40M", start + at(204, 240)), ("right", 205, "28M5S", at(205, 230) + stop), ("gap", 199, "5S2M3D30M", start[1:] + at(204, 233))]
    d = spark.createDataFrame([(r, "c", "+", pos, cigar, seq) for r, pos, cigar, seq in a], "read_id string, contig string, strand string, pos int, cigar string, seq string")
    d = d.withColumns({"blocks": sequences.aligned_blocks(F.col("cigar"), F.col("pos")), "lend": F.col("pos").cast("long")}).withColumn("rend", F.element_at("blocks", -1)["rend"])
    left = sequences.realign_clips(d.where("read_id <> 'right'").withColumns({"clip": F.substring("seq", 1, 5), "seq": F.substring("seq", 1, 20)}), introns, genome, bin_size=4)
    right = sequences.realign_clips(d.where("read_id = 'right'").withColumns({"clip": F.right("seq", F.lit(5)), "seq": F.right("seq", F.lit(20))}), introns, genome, bin_size=4, side="right")
    assert sorted(tuple(r) for r in left.collect()) == [("gap", 101, 203, 7), ("left", 101, 203, 8)]
    assert [tuple(r) for r in right.collect()] == [("right", 231, 300, 7)]
    own = d.withColumn("segments", F.array(F.struct(F.col("lend").cast("int").alias("lend"), F.col("rend").cast("int").alias("rend")))).select("read_id", "segments")
    got = {r.read_id: ([tuple(s) for s in r.segments], r.correction_type) for r in sequences.corrected_alignments(own, left, right).collect()}
    assert got == {"left": ([(93, 100), (204, 240)], "left"), "right": ([(205, 230), (301, 307)], "right"), "gap": ([(94, 100), (204, 233)], "left")}


def test_pairs_with_short_paths_count(spark):
    """No length of the other path or set is asked for."""
    c = spark.createDataFrame([(1, 10), (2, 10), (2, 20)], "tx_id long, intron long")
    assert sorted(tuple(r) for r in graphs.intron_sets(c).collect()) == [(1, 1, "equal"), (1, 2, "subset"), (2, 1, "superset"), (2, 2, "equal")]
    assert sorted(tuple(r) for r in graphs.overlap_fractions(c).collect()) == [(1, 1, 1.0), (1, 2, 1.0), (2, 1, round(11 / 32, 6)), (2, 2, 1.0)]
