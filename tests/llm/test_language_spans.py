"""Languages: words, counts and labels against a plain version; the search against all sequences; held-out accuracy."""

import itertools
import math
import os
import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest

from isoweave.llm import language_spans as L

FORMS = {"en": ["the", "and", "ing", "tion", "wh"], "de": ["der", "sch", "ung", "ü", "ein"], "ru": ["про", "ение", "ств", "ы", "не"], "ja": ["ひ", "らが", "な", "漢", "字"]}


def words(text):
    """(start, letters and marks of a piece), each with the groups that end in it."""
    low = [x if len(x := c.lower()) == 1 else c for c in text]
    inside = [unicodedata.category(c)[0] in "LM" for c in text]
    at = lambda i: low[i] if 0 <= i < len(text) and inside[i] else " "
    out, run = [], 0
    for i in range(len(text) + 1):
        if i < len(text) and inside[i]:
            if run % 64 == 0:
                out.append([i, 0, []])
            run += 1
            out[-1][1] += 1
        elif not run:
            continue
        else:
            run = 0
        one = at(i - 1)
        two = at(i - 2) if one != " " else " "
        out[-1][2].append(bucket(two, one, at(i)))
    return out


def bucket(two, one, c):
    h = ((ord(two) * 0x9E3779B1 % 2**32 ^ ord(one)) * 0x85EBCA6B % 2**32 ^ ord(c)) * 0xC2B2AE35 % 2**32
    return h >> 17


def script(c):
    return next((k for k, v in enumerate(L.SCRIPTS.values(), 1) if any(a <= ord(c) <= b for a, b in v)), 0)


def plain(train, texts, penalty=12.0):
    groups, letters = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    for lang, text in train:
        if lang is not None and text is not None:
            for s, n, g in words(text):
                letters[lang][script(text[s])] += n
                for b in g:
                    groups[lang][b] += 1
    langs = sorted(letters, key=lambda x: (-sum(letters[x].values()), x))
    total = {x: sum(groups[x].values()) for x in langs}
    weight = lambda x, b: int(np.rint(1000 * math.log((groups[x][b] + 0.1) / (total[x] + 0.1 * L.BUCKETS))))
    out = []
    for text in texts:
        w = words(text or "")
        if not langs or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out.append(("und", 0.0, []))
            continue
        score, known = [], []
        for s, _, g in w:
            ok = [x for x in langs if letters[x][script(text[s])] and letters[x][script(text[s])] >= 0.001 * sum(letters[x].values())]
            known.append(bool(ok))
            score.append([0 if not ok else sum(weight(x, b) for b in g) if x in ok else -(10**9) for x in langs])
        path = viterbi(score, int(penalty * 1000))
        by = [sum(n for (_, n, _), p, ok in zip(w, path, known, strict=True) if p == k and ok) for k in range(len(langs))]
        k = by.index(max(by)) if any(known) else 0
        spans = []
        for (s, n, _), p in zip(w, path, strict=True):
            if spans and spans[-1][0] == langs[p]:
                spans[-1] = (langs[p], spans[-1][1], s + n)
            else:
                spans.append((langs[p], s, s + n))
        out.append((langs[k], by[k] / sum(n for _, n, _ in w), spans))
    return out


def viterbi(score, penalty):
    best = [[(v, [k]) for k, v in enumerate(score[0])]]
    for row in score[1:]:
        prev = best[-1]
        top = max(v for v, _ in prev)
        lead = next(p for v, p in prev if v == top)
        best.append([(prev[k][0] + row[k], [*prev[k][1], k]) if prev[k][0] >= top - penalty else (top - penalty + row[k], [*lead, k]) for k in range(len(row))])
    value = max(v for v, _ in best[-1])
    return next(p for v, p in best[-1] if v == value)


def text_of(r, lang, n):
    return " ".join("".join(r.choice(FORMS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_the_whole_query_as_the_plain_version(spark):
    r = random.Random(3)
    docs = [(i, text_of(r, lang := r.choice(list(FORMS)), r.choice([1, 5, 40])), lang if i % 7 else None, "s") for i in range(60)]
    docs += [(100 + i, text_of(r, "en", 12) + ". " + text_of(r, r.choice(["de", "ru"]), 12) + "\n" + text_of(r, "ja", 3), "en", "s") for i in range(10)]
    docs += [(200, None, "en", "s"), (201, "", "de", None), (202, "12 34 !?", "en", "s"), (203, "אבג דהו", "en", None), (204, "x" * 500 + " " + "ü" * 70, "de", "s"), (205, "́ ́", "en", "s"), (206, "Ἀ the", None, None)]
    docs += [docs[0], (None, "the ing", "en", "s")]
    df = spark.createDataFrame([(*d, "clash", 1.0, []) for d in docs], "doc_id long, text string, lang string, source string, lang_pred string, score double, spans array<string>").repartition(4)
    got = [(x.doc_id, x.lang_pred, x.score, [tuple(s) for s in x.spans]) for x in L.label_languages(df, L.train(df)).collect()]
    want = [(d[0], *x) for d, x in zip(docs, plain([(d[2], d[1]) for d in docs], [d[1] for d in docs]), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(len(x[3]) > 1 for x in got) >= 10


def test_chunks_do_not_change_words():
    r = random.Random(4)
    text = "".join(r.choice(["abc", "ü", " ", ".", "q" * r.randrange(1, 300), "漢字"]) for _ in range(300))
    whole = L.read_chunk(text, "", "")
    for size in (64, 128, 1 << 12):
        parts = list(L.read_text(text, size))
        assert np.concatenate([w.groups for _, w in parts]).tolist() == whole.groups.tolist()
        assert np.concatenate([w.start + at for at, w in parts]).tolist() == whole.start.tolist()
        assert np.concatenate([w.size for _, w in parts]).tolist() == whole.size.tolist()


@pytest.mark.parametrize("penalty", [0, 3, 10])
def test_best_of_all_sequences(penalty):
    r = np.random.default_rng(penalty)
    for _ in range(60):
        score = r.integers(-8, 8, (r.integers(1, 8), 3))
        worth = lambda p: sum(int(score[t, k]) for t, k in enumerate(p)) - penalty * sum(a != b for a, b in itertools.pairwise(p))
        best = max(worth(p) for p in itertools.product(range(3), repeat=len(score)))
        model = L.Model(["a", "b", "c"], np.zeros((3, 1)), np.ones((1, 3), bool), penalty)
        assert worth(L.best_path(score, penalty)) == best == worth(model.path(score))


def test_nothing_learned_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string"
    none = L.train(spark.createDataFrame([(1, "the", None), (2, None, "en"), (3, "12", "en")], schema))
    assert [tuple(x)[:3] for x in L.label_languages(spark.createDataFrame([(1, "the", None)], schema), none).collect()] == [(1, "und", 0.0)]
    assert L.label_languages(spark.createDataFrame([], schema), none).count() == 0


def test_many_languages_are_handed_on_in_parts(spark):
    rows = [(i, "the and", f"l{i % 150:03}") for i in range(300)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1))
    assert model.languages == [f"l{i:03}" for i in range(150)] and model.weights.shape == (150, L.BUCKETS)


def test_a_text_of_a_million_words_with_two_languages():
    model = L.Model(["a", "b"], np.zeros((2, L.BUCKETS), np.int32), np.ones((len(L.SCRIPTS) + 1, 2), bool), 5000)
    one, two = L.read_chunk("aa", "", "").groups, L.read_chunk("bb", "", "").groups
    model.weights[0, one] = model.weights[1, two] = 900
    lang, score, spans = model.label("aa " * 600_000 + "bb " * 400_000)
    assert (lang, score, spans) == ("a", 0.6, [("a", 0, 1_799_999), ("b", 1_800_000, 2_999_999)])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    from isoweave.llm.queries import op13_language

    out = op13_language(spark, "/root/testdata/sf0.01").where("held_out")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 150 and sum(x.lang == x.lang_pred for x in rows) / len(rows) > 0.98
