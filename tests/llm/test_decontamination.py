"""Containment search against brute force."""

import math
import random
import re

import numpy as np

from isoweave.llm.decontamination import ItemIndex, drop_contaminated, find_contained, least_binned

R = random.Random(9)
VOCAB = [f"w{i}" for i in range(3000)] + ["Été", "naïve"]


def text(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def grams(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def fixture():
    items = [(i, text(R.choice([5, 6, 9, 20, 40, 300]))) for i in range(60)] + [(60, None), (61, ""), (62, "two words"), (63, "..."), (None, text(30))]
    items += [(64, items[3][1])]
    docs = [(i, text(R.choice([3, 50, 500, 2000]))) for i in range(40)]
    for i in range(120):
        item = R.choice([t for _, t in items if t and len(t) > 20]).split()
        if i % 3 == 1:  # a change in the middle
            item[len(item) // 2] = "changed"
        if i % 3 == 2:  # far apart
            item.insert(len(item) // 2, text(700))
        docs.append((100 + i, f"{text(R.choice([1, 100, 3000]))}\n{' '.join(item).upper() if i % 2 else ', '.join(item)}. {text(50)}"))
    docs += [(500, None), (501, ""), (502, "Two, words!"), (503, "--"), (None, docs[60][1]), (100, docs[40][1]), (100, docs[40][1])]
    return items, docs


def test_against_brute_force(spark):
    items, docs = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    sets = [(i, grams(t)) for i, t in items]
    want = []
    for d, t in docs:
        own = grams(t)
        want += [(d, i, len(g & own), len(g)) for i, g in sets if g and len(g & own) >= 0.8 * len(g)]
    for block in (1_000_000, 1000):
        got = [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in find_contained(frame, bench, block_shingles=block).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    held = {str(d) for d, *_ in want}
    kept = drop_contaminated(frame, bench, block_shingles=1000)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if str(d) not in held)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find_contained(docs, bench).count() == 1
    assert find_contained(docs.limit(0), bench).count() == find_contained(docs, bench.limit(0)).count() == 0
    assert drop_contaminated(docs, bench.limit(0)).count() == 1


def test_bins_find_short_items_in_long_documents():
    """Recall of the binned path alone, for items of 4 to 15 shingles, and the limit below which it isn't used."""
    rng = np.random.default_rng(4)
    vocab = [f"w{k}" for k in range(3000)]
    some = lambda n: [vocab[k] for k in rng.integers(0, len(vocab), n)]
    for q in (4, 6, 9, 15):
        items = [(k, " ".join(some(q + 4))) for k in range(300)]
        binned = ItemIndex(items, 0.8, 8, 0)
        found = sum(any(i == k for i, *_ in binned.search(" ".join([*some(3000), t, *some(2000)]).encode())) for k, t in items)
        assert found >= (0.999 if q >= 9 else 0.99) * len(items)
    assert least_binned(0.8, 8, 1e-9) == 9 and 16.0 ** -math.ceil(0.8 * 9) < 1e-9 <= 16.0 ** -math.ceil(0.8 * 8)
    for q in (8, 9):  # on both sides of the limit
        items = [(0, " ".join(some(q + 4)))]
        index = ItemIndex(items, 0.8, 8, least_binned(0.8, 8, 1e-9))
        assert index.sketches[0][1] == (q == 8)
        assert [r[0] for r in index.search(" ".join([*some(3000), items[0][1], *some(9)]).encode())] == [0]
