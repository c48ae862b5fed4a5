"""Differential usage of replicated samples against closed forms and plain numeric searches."""

import math

import numpy as np
import pytest

from isoweave.operators.bulk import GRID, adjusted_profile, bulk_differential_usage, group_rates, norm_factors, usage_tests
from isoweave.operators.statistics import chi2_tail


def chance(y, mu, phi):
    """Log of the negative binomial's probability."""
    return math.lgamma(y + 1 / phi) - math.lgamma(1 / phi) - math.lgamma(y + 1) + y * math.log(phi * mu / (1 + phi * mu)) - math.log1p(phi * mu) / phi


def test_without_dispersion_it_is_the_g_statistic():
    y = np.array([[30, 10, 22, 41], [5, 9, 40, 30], [12, 12, 12, 12]], float)
    second = np.array([False, False, True, True])
    change, statistic, dof, _, each = usage_tests(y, np.ones_like(y), second, np.zeros(3))
    table = np.array([y[:, ~second].sum(axis=1), y[:, second].sum(axis=1)])
    expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / table.sum()
    assert statistic == pytest.approx(2 * (table * np.log(table / expected)).sum(), rel=1e-9)
    assert dof == 2 and each.sum() == pytest.approx(statistic)
    assert change == pytest.approx(math.log2(table[1].sum() / table[0].sum()), abs=1e-6)


def test_statistic_against_a_search():
    r = np.random.default_rng(3)
    size = np.array([[1.0, 0.7, 1.3, 0.9, 1.1]] * 3)
    second = np.array([False, False, True, True, True])
    phi = np.array([0.05, 0.2, 0.4])
    for _ in range(3):
        y = r.negative_binomial(5, 0.1, (3, 5)).astype(float)
        base = np.linspace(math.log(2), math.log(400), 3001)

        def best(k, at, shift=0.0):
            mu = np.exp(base)[:, None] * (size[k] * np.exp(shift * second))[at]
            return (y[k, at] * np.log(phi[k] * mu / (1 + phi[k] * mu)) - np.log1p(phi[k] * mu) / phi[k]).sum(axis=1).max()

        free = sum(best(k, ~second) + best(k, second) for k in range(3))
        null = max(sum(best(k, np.full(5, True), c) for k in range(3)) for c in np.linspace(-1.5, 1.5, 601))
        _, statistic, dof, _, _ = usage_tests(y, size, second, phi)
        assert dof == 2 and statistic == pytest.approx(2 * (free - null), abs=2e-3)


def test_rates_and_profile():
    y = np.array([[3, 8, 1], [0, 0, 0]], float)
    size = np.array([[1, 2, 0.5]] * 2)
    rate = group_rates(y, size, np.array([0.3, 0.3]))
    best = max(np.linspace(0.5, 9, 20001), key=lambda x: sum(chance(a, x * s, 0.3) for a, s in zip(y[0], size[0], strict=True)))
    assert rate[0] == pytest.approx(best, abs=1e-3) and rate[1] == 0
    mu = rate[0] * size[0]
    want = sum(chance(a, m, 0.3) + math.lgamma(a + 1) for a, m in zip(y[0], mu, strict=True)) - 0.5 * math.log((mu / (1 + 0.3 * mu)).sum())
    assert adjusted_profile(y[:1], size[:1], np.zeros(3, int), 0.3)[0] == pytest.approx(want)


def plain_factors(table):
    """The same factors for a dict of samples to lists of counts, by loops."""
    names = sorted(table)
    total = {s: sum(table[s]) for s in names}
    quart = {s: sorted(table[s], reverse=True)[len(table[s]) // 4] / total[s] for s in names}
    mean = sum(quart.values()) / len(names)
    ref = min(names, key=lambda s: (round(abs(quart[s] - mean), 12), s))
    logs = {}
    for s in names:
        rows = [(math.log2(a / total[s] / (b / total[ref])), math.log2(a / total[s] * b / total[ref]) / 2, 1 / ((1 - a / total[s]) / a + (1 - b / total[ref]) / b)) for a, b in zip(table[s], table[ref], strict=True) if a and b]
        k = len(rows)
        rank = lambda c, rows=rows: [sum(x[c] < y[c] for x in rows) + (sum(x[c] == y[c] for x in rows) + 1) / 2 for y in rows]
        rm, ra = rank(0), rank(1)
        ok = [i for i in range(k) if k * 0.3 // 1 + 1 <= rm[i] <= k - k * 0.3 // 1 and k * 0.05 // 1 + 1 <= ra[i] <= k - k * 0.05 // 1]
        logs[s] = sum(rows[i][0] * rows[i][2] for i in ok) / sum(rows[i][2] for i in ok) if ok else 0.0
    centre = sum(logs.values()) / len(names)
    return {s: 2 ** (logs[s] - centre) for s in names}


def study(seed=4, genes=30):
    r = np.random.default_rng(seed)
    names = ["a1", "a2", "a3", "b1", "b2", "b3"]
    rows = {}
    for g in range(genes):
        base = r.uniform(30, 300, 3)
        for k in range(3):
            for s in names:
                mu = base[k] * (4 if g == 0 and k == 0 and s[0] == "b" else 1) * (1.5 if s == "b2" else 1)
                rows[f"g{g}", f"t{g}.{k}", s] = int(r.negative_binomial(20, 20 / (20 + mu)))
    return names, rows


def test_factors(spark):
    names, rows = study()
    d = spark.createDataFrame([(t, s, float(n)) for (_, t, s), n in rows.items()], "tx_id string, sample string, n double")
    want = plain_factors({s: [n for (_, _, x), n in rows.items() if x == s] for s in names})
    got = {r["sample"]: r["factor"] for r in norm_factors(d).collect()}
    assert got == pytest.approx(want, rel=1e-9)
    assert math.prod(got.values()) == pytest.approx(1)


def test_whole_study(spark):
    names, rows = study()
    extra = [(None, "t0.0", "a1", 5.0), ("g0", None, "a1", 5.0), ("g0", "t0.0", "zz", 5.0), ("lone", "only", "a1", 500.0), ("lone", "only", "b1", 500.0)]
    counts = spark.createDataFrame([(g, t, s, float(n)) for (g, t, s), n in rows.items()] + extra, "gene_id string, tx_id string, sample string, n double")
    samples = spark.createDataFrame([(s, s[0]) for s in names] + [("zz", None)], "sample string, condition string")
    genes, isoforms = (x.collect() for x in bulk_differential_usage(counts, samples, first="a", second="b"))
    assert {r["gene_id"] for r in genes} == {f"g{k}" for k in range(30)}
    by = {r["gene_id"]: r for r in genes}
    assert by["g0"]["adj_p_value"] < 1e-3 and sum(r["adj_p_value"] < 0.05 for r in genes) <= 3
    assert min(isoforms, key=lambda r: r["p_value"])["tx_id"] == "t0.0"
    # dispersion and tests again from the whole table at once
    table = np.array([[rows[g, t, s] for s in names] for g, t in dict.fromkeys((g, t) for g, t, _ in rows)], float)
    ids = list(dict.fromkeys(t for _, t, _ in rows))
    keep = [(g, t, s, n) for (g, t, s), n in rows.items()]
    f = plain_factors({s: [n for _, _, x, n in keep if x == s] for s in names})
    library = np.array([sum(n for _, _, x, n in keep if x == s) * f[s] for s in names])
    library = library / library.mean()
    size, second = np.broadcast_to(library, table.shape), np.array([s[0] == "b" for s in names])
    own = np.array([adjusted_profile(table, size, second.astype(int), p) for p in GRID]).T
    common = own.mean(axis=0)
    for r in isoforms:
        i = ids.index(r["tx_id"])
        k = int(np.argmax(own[i] + 10 * common))
        assert GRID[max(k - 1, 0)] <= r["dispersion"] <= GRID[min(k + 1, len(GRID) - 1)]
    got = {r["tx_id"]: r for r in isoforms}
    for g in ("g0", "g7"):
        at = [ids.index(f"t{g[1:]}.{k}") for k in range(3)]
        phi = np.array([got[ids[i]]["dispersion"] for i in at])
        _, statistic, dof, _, each = usage_tests(table[at], size[at], second, phi)
        assert by[g]["p_value"] == pytest.approx(chi2_tail(statistic, dof), rel=1e-6)
        p = sorted(chi2_tail(x, 1) for x in each)
        assert by[g]["simes_p"] == pytest.approx(min(3 * x / (k + 1) for k, x in enumerate(p)), rel=1e-6)


def test_unknown_condition_and_empty_table(spark):
    counts = spark.createDataFrame([("g", t, s, 9.0) for t in "xy" for s in ("a1", "a2")], "gene_id string, tx_id string, sample string, n double")
    samples = spark.createDataFrame([("a1", "a"), ("a2", "a")], "sample string, condition string")
    with pytest.raises(ValueError):
        bulk_differential_usage(counts, samples, first="a", second="b")
    genes, isoforms = bulk_differential_usage(counts.limit(0), samples, first="a", second="b")
    assert genes.count() == isoforms.count() == 0
