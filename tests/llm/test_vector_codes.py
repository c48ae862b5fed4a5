"""Vector codes: codes, errors and codebooks against a full search in Python integers."""

import math
import random

import numpy as np
import pytest

from isoweave.llm.vector_codes import Bounds, ceil_root, digest, encode, floor_root, squared, with_label_errors

SCHEMA = "vec_id long, embedding array<double>, label int, code string, x binary"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, lab) for i, v, lab, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    whole = [[math.floor(4096 * c) for c in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for v in cut:
                own[nearest(p, v[p])[1]].append(v[p])
            new.append([[sum(c) // len(o) for c in zip(*o, strict=True)] if o else old for o, old in zip(own, books[p], strict=True)])
        books = new
    out = [(i, lab, [nearest(p, v[p]) for p in range(parts)]) for (i, _, lab), v in zip(kept, cut, strict=True)]
    out = [(i, lab, "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c)) for i, lab, c in out]
    total = {}
    for _, lab, _, d in out:
        total[lab] = total.get(lab, 0) + d
    return sorted(((i, c, d, total[lab]) for i, lab, c, d in out), key=repr), books


def found(spark, rows, n=3, **how):
    coded, books = encode(spark.createDataFrame([(*r, "?", b"?") for r in rows], SCHEMA).repartition(n), **how)
    return sorted((tuple(r) for r in with_label_errors(coded).select("vec_id", "code", "error", "label_error").collect()), key=repr), books.tolist()


def test_codes_of_a_full_search(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 0.1) + (i % 5) / 9 for _ in range(32)], r.choice([0, 1, None])) for i in r.sample(range(10**6), 300)]
    rows += [(10**7 + i, rows[3][1], 2) for i in range(100)]
    rows += [(1, None, 0), (2, [1.0, None] * 16, 0), (3, [float("nan")] * 32, 1), (4, [float("inf")] * 32, 1)]
    got, books = found(spark, rows)
    want, plain_books = plain(rows)
    assert (got, books) == (want, plain_books)
    assert len(digest(np.array(books))) == 64


def test_ties_on_a_coarse_grid(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([-1, 0, 1]) / 4096 for _ in range(16)], i % 2) for i in range(200)]
    assert found(spark, rows) == plain(rows)


def test_few_uneven_repeated_and_null_ids(spark):
    rows = [(5, [0.5] * 3, None), (5, [0.5] * 3, None), (None, [0.25] * 11, 1), (7, [], 1)]
    assert found(spark, rows) == plain(rows)


def test_no_vector(spark):
    assert found(spark, [(1, None, 1)])[0] == []


def test_too_large_components(spark):
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e30] * 8, 1)])


def test_bounds_hold_and_pass_entries_over():
    r = np.random.default_rng(1)
    x, book = r.integers(-999, 999, (500, 8)), r.integers(-999, 999, (16, 8))
    b = Bounds(np.zeros(500, np.int64), np.full(500, 2**31), np.zeros((500, 16), np.int64))
    for step in range(5):
        true = squared(x[:, None], book[None])
        b.assign(x, book)
        assert (b.code == true.argmin(1)).all()
        assert (b.upper**2 >= true.min(1)).all() and (b.lower**2 <= true).all()
        new = book + r.integers(-9, 9, book.shape)
        b.shift(ceil_root(squared(book, new)))
        book = new
        assert ((b.lower > b.upper[:, None]).mean() > 0.5) or step > 3
    assert floor_root(np.array([0, 1, 2, 3, 4, 2**56 - 1, 2**56])).tolist() == [0, 1, 1, 1, 2, 2**28 - 1, 2**28]
