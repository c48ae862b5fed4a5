"""The quantification plan against a plain loop on a hand-made locus."""

import pytest
from pyspark.sql import functions as F

from isoweave.operators.quantify import quantify_paths

TX = {"A": ("g", ["1", "2", "3", "4"]), "B": ("g", ["1", "2", "3"]), "C": ("h", ["9", "10"]), "D": ("i", ["50"])}
READS = {"a": (4, ["1", "2", "3", "4"]), "b": (2, ["1", "2"]), "c": (1, ["9"]), "spacer": (3, ["1", "???", "3"]), "far": (2, ["77"])}


def tables(spark):
    reads = [(f"{n}{k}", p, 1, 9) for n, (times, p) in READS.items() for k in range(times)]
    r = spark.createDataFrame([*reads, reads[0]], "read_id string, path array<string>, lend int, rend int")
    t = spark.createDataFrame([(g, n, p) for n, (g, p) in TX.items()], "gene_id string, tx_id string, path array<string>")
    lengths = spark.createDataFrame([(n, 10) for n in ("1", "2", "3", "4", "9", "10")], "node string, length int")
    return r, t, lengths


def brute(rounds, alpha, weights):
    """Reads a hit A only; reads b hit A and B."""
    p = {"A": 0.5, "B": 0.5}
    for _ in range(rounds):
        part = {x: weights[x] * p[x] for x in p}
        new = {x: 2 * part[x] / sum(part.values()) + alpha * 2 for x in p}
        new["A"] += 4
        p = {x: new[x] / sum(new.values()) for x in p}
    part = {x: weights[x] * p[x] for x in p}
    return {x: part[x] / sum(part.values()) for x in p}


@pytest.mark.parametrize(("weighted", "weights"), [(False, {"A": 0.5, "B": 0.5}), (True, {"A": 1 - 70 / 130, "B": 1 - 60 / 130})])
def test_estimate(spark, weighted, weights):
    r, t, lengths = tables(spark)
    tracking, report = quantify_paths(r, t, lengths if weighted else None, alpha=0.01, max_iter=5, tolerance=0.0)
    want = brute(5, 0.01, weights)
    got = {(x.read_id, x.tx_id): (x.tier, x.frac) for x in tracking.collect()}
    assert len(got) == tracking.count() == 4 + 4 + 1
    assert all(got[f"a{k}", "A"] == (1, 1.0) for k in range(4)) and got["c0", "C"] == (2, 1.0)
    for x in "AB":
        assert got["b1", x][0] == 2 and got["b1", x][1] == pytest.approx(want[x], abs=1e-7)
    rows = {x.tx_id: x for x in report.collect()}
    assert set(rows) == set(TX) and rows["D"].all_reads == rows["D"].tpm == rows["D"].isoform_fraction == 0
    assert rows["A"].all_reads == pytest.approx(4 + 2 * want["A"], abs=1e-6) and rows["A"].uniq_reads == 4
    assert rows["A"].isoform_fraction == pytest.approx((4 + 2 * want["A"]) / 6, abs=1e-6)
    assert sum(x.tpm for x in rows.values()) == pytest.approx(1e6)


def test_equal_split_and_nothing(spark):
    r, t, _ = tables(spark)
    tracking, report = quantify_paths(r, t, em=False)
    assert {x.tx_id: x.all_reads for x in report.collect()} == {"A": 5.0, "B": 1.0, "C": 1.0, "D": 0.0}
    assert {x.frac for x in tracking.where(F.col("read_id") == "b0").collect()} == {0.5}
    for em in (True, False):
        tracking, report = quantify_paths(r.limit(0), t, em=em)
        assert tracking.count() == 0 and {x.tpm for x in report.collect()} == {0.0}
