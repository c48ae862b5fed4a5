"""SimHash components against brute force."""

import random
import re

import numpy as np
import xxhash

from isoweave.llm.components import connected_components
from isoweave.llm.simhash import cell_forest, document_prints, fingerprints, keep_one, near_duplicates, set_sketch, shingle_hashes, similar_links


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}é" for i in range(400)] + ["WORD", "Straße"]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 300))] for _ in range(60)]
    texts = [" ".join(w) for w in base]
    for w in base[:40]:
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append("\n".join(v))
    texts += [None, "", " \t\n", "one", "ONE", "one two", "x" * 100_000, texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    roots = plain_components(fps)
    least = {r: min(i for i in range(len(texts)) if roots[i] == r) for r in set(roots)}
    assert got == {i: (f"{fps[i]:016x}", least[roots[i]]) for i in range(len(texts))}
    assert len({c for _, c in got.values()}) < len(texts) - 20


def test_nulls_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    rows = near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (None, "zz")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows if r.component_id is not None) == [("3", 3), ("None", 3), ("None", 3)]
    assert len(rows) == 4


def test_forest_of_a_dense_cell():
    rng = np.random.default_rng(0)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) for c in rng.integers(0, 2**63, 5).astype(np.uint64)]))
    found, root = cell_forest(fps, 3)
    want = plain_components([int(x) for x in fps])
    label = np.arange(len(fps))
    label[found] = root
    assert len({(a, b) for a, b in zip(want, label.tolist(), strict=True)}) == len(set(want)) == len(set(label.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(7, 7), (None, 3), (5, 4)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [100, *range(200, 260)]}


def test_fingerprint_of_hot_words(spark):
    text = "same same same " * 1000
    row = fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.fp & (2**64 - 1) == plain_fingerprint(text)


def grams5(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similar_links_and_keep_one(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(2000)]
    base = [[rng.choice(vocab) for _ in range(200)] for _ in range(50)]
    texts = [" ".join(w) for w in base]
    for w in base[:30]:
        for changes in (1, 2, 3, 12):
            v = list(w)
            for _ in range(changes):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append(" ".join(v))
    shuffled = list(base[40])
    rng.shuffle(shuffled)
    texts.append(" ".join(shuffled))  # the same words in another order are no copy
    texts += ["", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, grams string")
    sets = [grams5(t) for t in texts]
    true = {(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {(r.u, r.v) for r in similar_links(docs, document_prints(docs, width=3, seed=42, tables=3, gram_width=5)).collect()}
    assert got <= true
    kept = {r.doc_id for r in keep_one(docs).collect()}
    assert set(range(50)) <= kept and len(texts) - 3 in kept
    copies = [i for i in range(50, 170) if any((i, j) in true for j in range(i))]
    assert len(copies) >= 85 and sum(i not in kept for i in copies) >= 0.9 * len(copies)
    assert all(i in kept for i in range(50, 170) if i not in copies)
    assert keep_one(docs).columns == docs.columns and keep_one(docs.limit(0)).count() == 0


def test_copies_with_added_text(spark):
    rng = random.Random(4)
    vocab = [f"u{i}" for i in range(20000)]
    rows = []
    for k in range(120):
        words = [rng.choice(vocab) for _ in range((100, 300, 800)[k % 3])]
        more = [rng.choice(vocab) for _ in range(len(words) // (5, 10)[k % 2])]
        rows += [(k, " ".join(words)), (1000 + k, " ".join([*words, *more] if k % 4 < 2 else [*more, *words]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in keep_one(docs).collect()} == set(range(120))


def test_group_whose_least_is_no_copy(spark):
    rng = random.Random(9)
    word = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    shared = word(160)
    rows = [(0, [*word(50), *shared])]
    for k in range(1, 40, 2):  # one template; each two are copies of each other only
        own = word(50)
        rows += [(k, [*own, *shared]), (k + 1, [*own[:-2], *word(2), *shared])]
    chain = word(500)  # each is a copy of the next one, and the ends aren't
    rows += [(100 + k, chain[20 * k : 400 + 20 * k]) for k in range(6)]
    texts = {k: " ".join(w) for k, w in rows}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in keep_one(docs).collect()} == {0, *range(1, 40, 2), 100}
    # with a single band, every pair that shares it
    band = {k: tuple(set_sketch(np.unique(shingle_hashes(t.encode(), 5, 42)), 4).tolist()) for k, t in texts.items()}
    met = [k for k in range(1, 40, 2) if band[k] == band[k + 1]]
    assert sum(band[k] == band[0] for k in met) >= 3
    kept = {r.doc_id for r in keep_one(docs, tables=1).collect()}
    assert not kept & {k + 1 for k in met} and set(range(1, 40, 2)) <= kept


def test_search_goes_beyond_removed_texts(spark):
    base = [f"z{k}" for k in range(400)]
    first, prints = " ".join(base), {}
    for k in range(50):  # the second is the first by fingerprint, the third is similar to the second only
        second = [*base[:-1], f"last{k}"]
        texts = first, " ".join(second), " ".join([*(f"y{i}" for i in range(44)), *second[44:]])
        prints = [plain_fingerprint(t) for t in texts]
        if (prints[0] ^ prints[1]).bit_count() <= 3:
            break
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < min((prints[2] ^ p).bit_count() for p in prints[:2])
    a, b, c = map(grams5, texts)
    assert len(a & c) < 0.8 * len(a | c) and len(b & c) >= 0.8 * len(b | c)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in keep_one(docs).collect()} == {0}


def test_ids_of_any_kind_and_repeated_ids(spark):
    rng = random.Random(12)
    one, two, three = (" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(999)) for _ in range(60)) for _ in range(3))
    rows = [("b", one, "x"), ("a", one, "y"), ("c", two, "x"), ("c", three, "x"), ("d", two, "z"), (None, three, "n"), (None, None, "n"), ("e", "", "m"), ("e", "", "l")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, kept_key string")
    kept = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
    assert kept == sorted([("a", one), ("c", two), ("c", three), ("e", "")], key=str)  # two texts of one id both stay
    assert keep_one(docs).columns == docs.columns
    got = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), (None, "c"), (None, "e"), ("e", "e")}
