"""Sweeps that are cut into ranges: the same rows for any cut, as a plain version has them."""

import random

import pytest
from pyspark.sql import functions as F

from isoweave.operators import intervals, splice

SCHEMA = "contig string, strand string, lend long, rend long"


def made(seed, n=250):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        a = r.choice([r.randrange(1, 400), r.randrange(1, 60), 63, 64, 65, 2000 + r.randrange(9)])
        rows.append((r.choice(["c1", "c2", None]), r.choice("+-"), a, a + r.choice([0, 1, 5, 20, 150])))
    return [*rows, ("c1", "+", None, 5), ("c1", "+", 5, None)]


def groups(rows):
    out = {}
    for c, s, a, b in rows:
        if a is not None and b is not None:
            out.setdefault((c, s), []).append((a, b))
    return out


@pytest.mark.parametrize("cut", [1, 7, 64, 1 << 16])
@pytest.mark.parametrize("gap", [0, 1, 10])
def test_merged(spark, cut, gap):
    rows, want = made(cut + gap), []
    for k, own in groups(rows).items():
        merged = []
        for a, b in sorted(own):
            if merged and a - merged[-1][1] <= gap:
                merged[-1] = [merged[-1][0], max(b, merged[-1][1]), merged[-1][2] + 1]
            else:
                merged.append([a, b, 1])
        want += [(*k, *m) for m in merged]
    d = spark.createDataFrame(rows, SCHEMA)
    for how in (cut, None):
        assert sorted(map(tuple, intervals.merge_intervals(d, gap=gap, cut=how).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("cut", [1, 7, 64, 1 << 16])
def test_coverage_and_segments(spark, cut):
    rows = [r for r in made(cut) if None not in r[2:]]
    depth = {}
    for k, own in groups(rows).items():
        for a, b in own:
            for x in range(a, b + 1):
                depth[(k, x)] = depth.get((k, x), 0) + 1
    bounds = {(k, x) for k, own in groups(rows).items() for a, b in own for x in (a, b + 1)}
    d = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for c, s, a, b, n in intervals.coverage_runs(d, cut=cut).collect():
        for x in range(a, b + 1):
            assert ((c, s), x) not in got
            got[(c, s), x] = n
    assert got == depth
    cuts = d.select("contig", "strand", F.col("lend").alias("pos")).unionByName(d.select("contig", "strand", (F.col("rend") + 1).alias("pos")))
    own = d.where("contig IS NOT NULL")
    pieces = [tuple(r) for r in intervals.segment(own, cuts.where("contig IS NOT NULL"), cut=cut).collect()]
    assert {((c, s), x) for c, s, a, b in pieces for x in range(a, b + 1)} == {k for k in depth if k[0][0] is not None}
    assert all(((c, s), a) in bounds for c, s, a, _ in pieces) and all(((c, s), x) not in bounds for c, s, a, b in pieces for x in range(a + 1, b + 1))


@pytest.mark.parametrize("cut", [10, 64, 1000])
def test_windows_over_positions(spark, cut, monkeypatch):
    r = random.Random(cut)
    sites = sorted({(r.choice(["c1", "c2"]), "+", r.randrange(1, 500)) for _ in range(200)})
    rows = [(*s, r.randrange(1, 30)) for s in sites]
    d = spark.createDataFrame(rows, "contig string, strand string, pos long, n long")
    monkeypatch.setattr(splice, "with_halo", lambda df, a, b: intervals.with_halo(df, a, b, cut=cut))
    got = {(x.contig, x.pos): x.window_total for x in splice.window_totals(d, window=20).collect()}
    assert got == {(c, p): sum(m for c2, _, q, m in rows if c2 == c and abs(p - q) <= 20) for c, _, p, _ in rows}


def test_no_window_sorts_a_contig(spark):
    d = spark.createDataFrame([("c", "+", k, k + 5) for k in range(0, 400_000, 50)], SCHEMA)
    plan = intervals.coverage_runs(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "__cut" in plan
    assert intervals.merge_intervals(d).count() == 8000
