"""Ambient test of barcodes: exact chances, the definition of the simulation, and planted cells."""

import itertools
import math

import numpy as np
import pytest

from isoweave.operators.droplets import ambient_profile, empty_droplets, good_cells, good_turing, running_log_chance


def log_chance(counts, p):
    return math.lgamma(sum(counts) + 1) + sum(n * math.log(q) - math.lgamma(n + 1) for n, q in zip(counts, p, strict=True))


def test_running_chance_is_the_multinomial_one():
    p = np.array([0.2, 0.5, 0.3])
    draws = np.random.default_rng(1).integers(0, 3, 40)
    got = running_log_chance(p, draws)
    for k in range(1, 41):
        assert got[k - 1] == pytest.approx(log_chance(np.bincount(draws[:k], minlength=3), p))


def test_good_turing_sums_to_one():
    for r, n in (([1, 2, 3, 5, 9], [120, 40, 24, 7, 1]), ([1], [5]), ([3, 4], [2, 2]), ([7], [1])):
        share, unseen = good_turing(np.array(r), np.array(n))
        assert (share * n).sum() + unseen == pytest.approx(1) and (share > 0).all()  # Turing's estimates need not grow with r
    assert good_turing(np.array([1, 2, 3, 5, 9]), np.array([120, 40, 24, 7, 1]))[1] == pytest.approx(120 / 316)


def matrix(spark, rows):
    return spark.createDataFrame(rows, "cell string, feature string, n long")


def planted(spark, extra=()):
    """Small barcodes and three large ones with the ambient profile, and two cells of another one."""
    r = np.random.default_rng(5)
    p = np.array([0.4, 0.3, 0.2, 0.1])
    rows = [(f"s{k}", f"f{i}", int(n)) for k in range(60) for i, n in enumerate(r.multinomial(20, p))]
    rows += [(f"a{k}", f"f{i}", int(n)) for k in range(3) for i, n in enumerate(r.multinomial(150, p))]
    rows += [(f"c{k}", f"f{i}", n) for k in range(2) for i, n in enumerate((5, 10, 30, 155))]
    return matrix(spark, [*rows, *extra])


def test_planted_cells(spark):
    d = planted(spark, [("c0", None, 5), (None, "f1", 5), ("n", "f1", 0), ("n", "f2", None)])
    got = {r["cell"]: r for r in empty_droplets(d, rounds=999).collect()}
    assert set(got) == {"a0", "a1", "a2", "c0", "c1"}
    assert got["c0"]["p_value"] == pytest.approx(0.001) and got["c0"]["n_below"] == got["c1"]["n_below"] == 0
    assert all(got[f"a{k}"]["p_value"] > 0.02 for k in range(3))
    assert {r["cell"] for r in good_cells(d, rounds=999).select("cell").distinct().collect()} == {"c0", "c1"}
    more = {r["cell"]: r["p_value"] for r in empty_droplets(d, rounds=999, retain=200).collect()}
    assert more["c0"] == 0 and more["a0"] == got["a0"]["p_value"]


def test_p_values_near_the_exact_ones(spark):
    d = planted(spark, [("x", "f0", 4), ("x", "f1", 1), ("x", "f3", 2)])
    profile = {r["feature"]: r["p"] for r in ambient_profile(d.where("cell LIKE 's%'"), lower=100).collect()}
    p = [profile[f"f{i}"] for i in range(4)]
    assert sum(p) == pytest.approx(1)
    # the exact tail of a barcode of 7 counts, over all tables of that total
    own = log_chance((4, 1, 0, 2), p)
    exact = sum(math.exp(log_chance(c, p)) for c in itertools.product(range(8), repeat=4) if sum(c) == 7 and log_chance(c, p) <= own + 1e-7)
    shifted = d.where("cell LIKE 's%' OR cell = 'x'")
    rows = [(r["cell"], r["feature"], r["n"]) for r in shifted.collect()]
    small = [(f"{c}-{k}", f, 1) for c, f, n in rows if c != "x" for k in range(n)]  # the same profile in barcodes of few counts
    got = [r for r in empty_droplets(matrix(spark, small + [r for r in rows if r[0] == "x"]), lower=6, rounds=4000).collect() if r["cell"] == "x"][0]
    assert got["log_chance"] == pytest.approx(own, abs=1e-6)
    assert got["p_value"] == pytest.approx(exact, abs=4 * math.sqrt(exact * (1 - exact) / 4000) + 1e-3)


def test_same_seed_same_rows_for_any_partitions(spark):
    d = planted(spark)
    a = sorted(map(tuple, empty_droplets(d, rounds=250).collect()))
    assert a == sorted(map(tuple, empty_droplets(d.repartition(7), rounds=250).collect()))


def test_no_small_barcode(spark):
    d = planted(spark).where("cell LIKE 'a%' OR cell LIKE 'c%'")
    with pytest.raises(ValueError):
        empty_droplets(d, rounds=99)
    assert {r["cell"] for r in good_cells(d, rounds=999).select("cell").distinct().collect()} <= {"a0", "a1", "a2", "c0", "c1"}
