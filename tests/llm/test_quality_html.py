"""Compression classifier and toxicity field by held-out accuracy; HTML extraction on planted pages."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.llm import compress_quality, crf
from isoweave.llm.html_extract import extract, extract_group, page_blocks, page_counts, suffix_array

R = random.Random(2)
SYL = ["an", "th", "er", "in", "on", "re", "st", "ou", "le", "ti"]
LONG = "word " * 30_000


def sentence(n):
    return " ".join("".join(R.choice(SYL) for _ in range(R.randint(1, 3))) for _ in range(n)).capitalize() + "."


def labelled(n=400):
    rows = []
    for i in range(n):
        text = " ".join(sentence(R.randint(5, 12)) for _ in range(R.randint(3, 10)))
        bad, toxic = i % 4 == 0, i % 3 == 0
        if bad:
            text = " | ".join(text.split()) if i % 8 else text.upper().replace(" ", "!! ")
        if toxic:
            words = text.split(" ")
            for _ in range(3):
                words.insert(R.randrange(len(words)), R.choice(["zquark", "blorft", "vexnit" + R.choice(SYL)]))
            text = " ".join(words)
        rows.append((i, text, int(not bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled()
    docs = [(i, t, "x", 0.0) for i, t, *_ in rows] + [(900, None, "x", 0.0), (901, "", "x", 0.0), (None, "null id", "x", 0.0), (902, LONG, "x", 0.0), (1, rows[1][1], "x", 0.0), (903, " \n", "x", 0.0)]
    labels = [(i, q, t) for i, _, q, t in rows] + [(900, 1, None), (None, 0, 0), (5000, 1, 1)]
    return rows, spark.createDataFrame(docs, "doc_id long, text string, score string, label double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, tables, kind):
    rows, docs, labels = tables
    mod, score = (compress_quality, compress_quality.score_quality) if kind == "quality" else (crf, crf.score_toxicity)
    got = score(docs, mod.train_on(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    from zlib import crc32

    by = {r.doc_id: r.score for r in got}
    held = [r for r in rows if crc32(str(r[0]).encode()) % 5 == 0]
    right = [(by[r[0]] >= 0.5) == bool(r[2 if kind == "quality" else 3]) for r in held]
    assert np.mean(right) > 0.95


def test_models_of_one_label(spark, tables):
    _, docs, labels = tables
    assert {r.score < 0.01 for r in crf.score_toxicity(docs, crf.train_on(docs, labels.where("toxic = 0"))).collect()} == {True}
    assert {r.score > 0.9 for r in compress_quality.score_quality(docs, compress_quality.train_on(docs, labels.where("quality = 1"))).collect()} == {True}
    none = compress_quality.score_quality(docs, compress_quality.train_on(docs, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}
    assert crf.score_toxicity(docs.limit(0), crf.train_on(docs.limit(0), labels)).count() == 0
    assert compress_quality.score_quality(docs.limit(0), compress_quality.train_on(docs, labels)).count() == 0


def test_toxic_spans_and_filter(spark, tables):
    rows, docs, labels = tables
    model = crf.train_on(docs, labels)
    one = spark.createDataFrame([(1, "𝒳 ordinary thing. then Zquark blorft here"), (2, "thanre tithou")], "doc_id long, text string")
    got = {r.doc_id: r for r in crf.score_toxicity(one, model).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(23, 36)] and got[1].score > 0.5 > got[2].score
    kept = crf.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(r[0] in ids) != bool(r[3]) for r in rows]) > 0.95 and {900, 901, 902, None} <= ids


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(4)
    seqs, emission = np.array([0, 0, 0, 1, 2, 2]), rng.normal(size=6)
    t, s = rng.normal(size=(2, 2)), rng.normal(size=2)
    p, pairs, log_z = crf.marginals(emission, seqs, t, s)
    want, want_pairs, total = np.zeros(6), np.zeros((2, 2)), 0.0
    for q in range(3):
        at = np.flatnonzero(seqs == q)
        paths = []
        for bits in range(2 ** len(at)):
            y = [bits >> k & 1 for k in range(len(at))]
            w = s[y[0]] + sum(emission[i] for i, b in zip(at, y, strict=True) if b) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False))
            paths.append((np.exp(w), y))
        z = sum(w for w, _ in paths)
        total += np.log(z)
        for w, y in paths:
            want[at] += w / z * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                want_pairs[a, b] += w / z
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, total)


def page(i, body):
    return f'<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>{body}</body></html>'


def test_structure():
    body = """<nav><ul><li>Menu</li></ul></nav><!-- x --><div class="ad">Buy</div><header><h1>Site</h1></header>
    <article><h1>Head &amp; more</h1><p>One&nbsp;two<br>three <b>bold<p>Four<script>x<y</script> five</p><aside>side</aside>
    <form><input>name</form><pre>a\n  b</pre><table><tr><td>c1<td>c2</table><section class="comments"><p>Nice!</p></section>
    <div hidden>no</div><div data-x="a>b">kept</div></article><footer>&copy; end</footer>"""
    assert [t for t, inside in page_blocks(page(1, body)) if inside] == ["Head & more", "One two three bold", "Four five", "a b", "c1", "c2", "kept"]
    assert [t for t, inside in page_blocks(page(1, body)) if not inside] == []
    assert page_blocks("<article><p>cut &am") == [("cut &am", True)]
    assert page_blocks('<p>x</p><a href="unclosed') == [("x", False)]
    assert page_blocks("<p>1 < 2 and 3 > 2</p><!-- open") == [("1 < 2 and 3 > 2", False)]
    assert page_blocks(None) == page_blocks("<script>never ends") == []


def test_host_boilerplate(spark):
    line, rows, want = sentence(12), [], {}
    for i in range(30):
        own = sentence(30)
        rows.append((i, f"http://h.example/{i}", page(i, f"<div>{line}</div><div>{own}</div><div>{line}</div>"), "t"))
        want[i] = own
    for i in range(30, 40):  # an article keeps what a few other pages say too
        own = sentence(20)
        rows.append((i, f"https://User@H.example:80/{i}", page(i, f"<article><p>{own}</p><p>{line}</p></article><div>{line}</div>"), "t"))
        want[i] = f"{own}\n\n{line}"
    rows += [(50, None, None, "t"), (51, "u", "", "t"), (52, "u", "plain words only", "t"), (52, "u", "plain words only", "t"), (None, "u", LONG, "t")]
    want |= {50: "", 51: "", 52: "plain words only", None: LONG.strip()}
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(frame, article_share=1.0).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)
    assert extract(frame.limit(0)).count() == 0
    assert {r.page_id: r.text for r in extract(frame, article_share=1.0, group_bytes=3000).collect()} == want


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(3)
    for round_ in range(5):
        tokens, pages = [], []
        for p in range(6):
            own = rng.integers(0, 3, rng.integers(0, 40)).tolist()
            tokens += [*own, -1 - p]
            pages += [p] * (len(own) + 1)
        order, common = suffix_array(np.array(tokens))
        want = sorted(range(len(tokens)), key=lambda i: tokens[i:])
        assert order.tolist() == want
        for k in range(1, len(want)):
            a, b = tokens[want[k - 1] :], tokens[want[k] :]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert common[k] == n
        counted = rng.random(len(tokens)) < 0.5
        for depth in (1, 2, 3, 5, 8):
            both = page_counts(np.array(tokens), np.array(pages), counted, depth)
            for got, at in zip(both, (np.ones(len(tokens), bool), counted), strict=True):
                for i in range(len(tokens)):
                    if i + depth <= len(tokens) and pages[i] == pages[i + depth - 1] and min(tokens[i : i + depth]) >= 0:
                        holders = {pages[j] for j in range(len(tokens)) if at[j] and tokens[j : j + depth] == tokens[i : i + depth]}
                        assert got[i] == len(holders)
    assert suffix_array(np.array([], np.int64))[0].tolist() == []


def test_suffix_array_decides_without_telling_names(spark):
    """Pages whose markup says nothing: only repeats tell boilerplate from text, and the whole query is known beforehand."""
    menu, notice, foot = sentence(14), sentence(60), sentence(9)
    rows, want = [], {}
    for i in range(200):
        host = i % 3
        paras = [sentence(10 + (7 * i + k) % 40) for k in range(1 + i % 4)]
        parts = [f"<div class='x{i}'>{menu} {host}</div>", *(f"<div><p>{t}</p></div>" for t in paras), f"<div>{notice}</div>", f"<div>{foot} no {host}</div>"]
        rows.append((i, f"https://h{host}.example/{i}", f"<html><body>{''.join(parts)}</body></html>"))
        want[i] = "\n\n".join(paras)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (8_000_000, 30_000, 10):
        assert {r.page_id: r.text for r in extract(frame, group_bytes=size).collect()} == want
    assert extract_group([h for _, u, h in rows if "//h0" in u], 8, 1000, 1.0)[0] != want[0]  # it is the repeats that go


def test_rule_does_not_depend_on_the_size_of_a_host(spark):
    three, half, rows, want = sentence(12), sentence(12), [], {}
    for i in range(60):
        own, inside = sentence(25), i % 2 == 0
        extra = [three] * (i in (3, 21, 45)) + [half] * (i % 20 != 7)
        body = "".join(f"<p>{x}</p>" for x in [own, *extra])
        rows.append((i, f"http://big.example/{i}", page(i, f"<article>{body}</article>" if inside else body)))
        want[i] = own
    rows += [(60, "http://big.example/copy", rows[5][2]), (61, "http://big.example/none", None), (None, "http://big.example/null", page(0, "<p>alone</p>")), (62, "http://small.example/", page(0, f"<p>{three}</p>"))]
    want |= {60: want[5], 61: "", None: "alone", 62: three}
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (2_000_000, 3000):
        assert {r.page_id: r.text for r in extract(frame, group_bytes=size).collect()} == want


def test_long_texts_do_not_end_the_sample(spark, tables):
    rows, docs, labels = tables
    size = sum(len(t) for _, t, *_ in rows)
    long = docs.withColumn("text", F.when(F.col("doc_id").isin(*range(0, 40)), F.repeat(F.concat("text", F.lit(" ")), 200)).otherwise(F.col("text")))
    got = {r.doc_id: r.score for r in crf.score_toxicity(docs, crf.train_on(long, labels, max_chars=size)).collect()}
    assert np.mean([(got[r[0]] >= 0.5) == bool(r[3]) for r in rows]) > 0.95
    assert crf.within([(1, 0, 10), (2, 0, 90), (3, 0, 5), (4, 1, 15)], 60) == [1, 3, 4]
    assert crf.within([(1, 0, 500), (2, 1, 500)], 60) == [1, 2] and crf.within([], 5) == []


def test_one_label_left_is_an_error(spark, tables):
    _, docs, labels = tables
    with pytest.raises(ValueError):
        crf.train_on(docs.join(labels.where("toxic = 0"), "doc_id", "left_semi"), labels)


@pytest.mark.parametrize("n_toxic", [1, 2, 3, 5, 10])
def test_few_toxic_documents_leave_clean_ones_alone(spark, n_toxic):
    r = random.Random(n_toxic)
    clean = lambda: " ".join(r.choice(["stone", "river", "cloud", "green", "walks", "under", "light", "paper"]) + str(r.randrange(30)) for _ in range(60))
    rows = [(i, clean() + (" vilescum vilefoul vilescum" if i < 2 * n_toxic and i % 2 else ""), int(i < 2 * n_toxic and i % 2)) for i in range(200)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    model = crf.train_on(docs, labels)
    kept = {x.doc_id for x in crf.drop_toxic(docs, model).collect()}
    assert {x[0] for x in rows if not x[2]} <= kept
    if n_toxic >= 5:
        assert sum(x[2] and x[0] not in kept for x in rows) >= 0.7 * n_toxic


def test_nothing_tells_toxic_documents_apart(spark):
    docs = spark.createDataFrame([(i, f"same words in all {i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(80)], "doc_id long, toxic int")
    scores = {round(x.score, 6) for x in crf.score_toxicity(docs, crf.train_on(docs, labels)).collect()}
    assert len(scores) == 1 and 0 < min(scores) < 0.5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_small_tables_are_not_all_toxic(spark):
    from isoweave.llm.common import table
    from isoweave.llm.queries import op9_toxicity

    at = "/root/testdata/sf0.001"
    rows = op9_toxicity(spark, at).join(table(spark, at, "labels").where("toxic IS NOT NULL"), "doc_id").collect()
    clean = [x for x in rows if not x.toxic]
    assert sum(x.predicted for x in clean) <= 0.02 * len(clean)


def test_copies_over_files_do_not_change_the_rule(spark, tmp_path):
    passage = " ".join(f"shared{k}" for k in range(30))
    page = lambda i, more: f"<body><article><p>{' '.join(f'own{i}x{k}' for k in range(25))}</p>{more}</article></body>"
    holders = [(i, "http://h.example/a", page(i, f"<p>{passage}</p>")) for i in range(60)]
    others = [(100 + i, "http://h.example/a", page(100 + i, "")) for i in range(40)]
    for k in range(8):
        part = holders[k::8] + [(1000 * (k + 1) + i, u, h) for i, u, h in others]
        spark.createDataFrame(part, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
    frame = spark.read.parquet(f"{tmp_path}/pages")
    whole, parts = ({r.page_id: r.text for r in extract(frame, **how).collect()} for how in ({}, {"group_bytes": 0}))
    assert whole == parts and len(whole) == 380 and not any("shared" in t for t in whole.values())


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<body class="no-comments"><article><p>whole</p></article></body>', "whole"),
        ('<article class="comments-open"><p>whole</p></article>', "whole"),
        ('<div class="has-sidebar"><article><p>whole</p></article></div>', "whole"),
        ('<div class="sidebar"><p>gone</p><article><p>whole</p></article><p>gone</p></div>', "whole"),
        ('<body class="menu"><p>whole</p><div class="wide menu">gone</div></body>', "whole"),
        ('<article><p>whole</p><div class="comments"><article>gone</article></div></article>', "whole"),
        ('<nav><article>gone</article></nav><p>whole</p>', "whole"),
    ],
)
def test_class_words_are_whole(html, text):
    assert [t for t, _ in page_blocks(html)] == [text]


def test_dictionary_reads_whole_texts():
    r = random.Random(5)
    mark = b" a mark that only comes late in each of the texts "
    samples = [r.randbytes(20_000) + mark * 5 for _ in range(60)]
    assert mark in compress_quality.build_dictionary(samples)


def test_quality_query_against_plain_compression(spark, tables):
    """Scores from the sizes that zstandard gives, block by block, through the fitted curve."""
    import zstandard

    rows, docs, labels = tables
    model = compress_quality.train_on(docs, labels)
    got = {r.doc_id: r.score for r in compress_quality.score_quality(docs, model).collect()}

    def size(data, dictionary):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024))

    for i, t, *_ in rows[:40]:
        raw = t.encode()
        views = raw, "".join("b" if ord(c) > 127 else "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in raw.decode("latin-1")).encode("latin-1")
        x = [20 * (size(v, bad) - size(v, good)) / (len(v) + 16) for v, (good, bad) in zip(views, model.dictionaries, strict=True)]
        z = float(np.dot(x, model.curve[:2]) + model.curve[2])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_query_against_all_paths(spark):
    """Scores from the sums over all tag sequences of each sentence."""
    rng = np.random.default_rng(7)
    model = crf.Model(rng.normal(0, 0.7, 1 << crf.TABLE_BITS), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2), (1.3, -0.8))
    texts = ["one two three. four five", "Alpha beta gamma delta epsilon zeta eta", "x", "", None, "no stop here at all so one sequence"]
    got = {r.doc_id: r.score for r in crf.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        p = []
        for sentence_ in (t or "").split("."):
            words = sentence_.lower().split()
            e = [model.weights[crf.features(w)].sum() for w in words]
            n, z, hit = len(words), 0.0, np.zeros(len(words))
            for bits in range(2**n if n else 0):
                y = [bits >> i & 1 for i in range(n)]
                w = np.exp(model.start[y[0]] + sum(e[i] for i in range(n) if y[i]) + sum(model.transition[a, b] for a, b in zip(y, y[1:], strict=False)))
                z += w
                hit += w * np.array(y)
            p += (hit / z).tolist() if n else []
        evidence = np.log1p(sum(-x * x * np.log(1 - x) for x in p)) + max(p, default=0)
        assert abs(got[k] - 1 / (1 + np.exp(-(1.3 * evidence - 0.8)))) < 1e-6
