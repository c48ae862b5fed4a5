"""Host rules, secret scan and licence scan against plain Python, on texts with every edge case."""

import hashlib
import random
import re
from collections import Counter

import pytest

from isoweave.llm.host_rules import host_verdicts, judge, measure
from isoweave.llm.license_scan import Rule, gate, rules, scan_licenses
from isoweave.llm.secret_scan import ordinary_samples, random_samples, redact_secrets, scan_secrets, train_markov

R = random.Random(5)
WORDS = ["the", "Ünïcode", "a", "licence", "by", "cc", "all", "rights", "general", "Public", "license", "#x", "$$", "word|", "𝒳y"]
TEXTS = [
    None, "", " ", "\n\n", "one", "w " * 30, "And " * 5000,
    " ".join(R.choice(WORDS) for _ in range(3000)),
    "\n".join(" ".join(R.choice(WORDS) for _ in range(4)) for _ in range(200)),
    "a b c d e f g h i\nx\x0by\x0cz\r\na b c d e f g h i\n \n \nx\x0by\x0cz\r",
    "a b c d e f g h a b c d e f g h a", "é\x85ü z\x1cz",
    "secret=token: abcdefgh password=token=abcdefgh", "PASSWORD = 'hunter22' ſecret=abcdefgh toKen:\x20\"x\" toKen=abcdefgh",
    "AKIA" + "A" * 15 + " AKIA" + "A" * 16 + "AKIAAKIA" + "B" * 12, "f" * 23 + " " + "0" * 24 + "g" + "a" * 24,
    "𝒳 api_key: 0123456789abcdef0123456789 apikey=abc passwd='abcdef token", "x" * 200_000 + " secret: zzzzzzzz",
    "CC BY cc-by; CC, BY! all RIGHTS\x00reserved general public license cc byx xcc by écc by cc by",
    "Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.\nAll rights reserved.",
    "key Zx9QmK2vLw83TnRbY5HcD7fGjP0sAeU4 end", "an_ordinary_identifier_name_here getTheOrdinaryIdentifierNameHere",
]
DOCS = [(i, t, None if i % 5 == 0 else f"s{i % 3}", 7) for i, t in enumerate(TEXTS)] + [(None, "no id here", "s1", 1), (2, " ", "s2", 1), (2, " ", "s2", 1)]
SCHEMA = "doc_id long, text string, source string, host int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_measures(t):
    w = words(t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))


def test_measures(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    got = sorted(map(str, judge(docs).drop("kept").collect()))
    want = []
    for i, t, _, _ in DOCS:
        m = plain_measures(t)
        want.append((i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got == sorted("Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, row, strict=True)) + ")" for row in want)


def test_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(50))
    rows = [(i, good if i % 10 else "bad", "fine", 0) for i in range(100)] + [(100 + i, "bad" if i % 10 else good, "spam", 0) for i in range(100)] + [(300, good, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    rates = {r.host: (r.rate_base, r.host_failed) for r in host_verdicts(measure(docs)).collect()}
    assert 0.1 < rates["fine"][0] < 0.2 and not rates["fine"][1]
    assert 0.8 < rates["spam"][0] < 0.9 and rates["spam"][1]
    kept = {r.doc_id for r in judge(docs).where("kept").collect()}
    assert kept == {i for i in range(100) if i % 10} | {300}


@pytest.mark.parametrize("run", [judge, scan_licenses])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_spans(t):
    out = []
    for k, (kind, pattern, group, least) in enumerate([
        ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ]):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, t or "") if len(m[group]) >= least]
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


COMMON = """time person year way day thing man world life hand part child eye woman place work week case point government
company number group problem fact information development international communication organisation understanding
ordinary identifier name here get the and with that have from they which would there their what about because
performance management available community experience different education important significant environment
technology relationship university production individual department something structure association behaviour
jumped over sleeping quick brown foxes dogs without hesitation configuration application""".split()


@pytest.fixture(scope="module")
def model(spark):
    good = spark.createDataFrame([(i, " ".join(R.choice(COMMON) for _ in range(300))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    return train_markov(random_samples(spark, 1000).unionByName(ordinary_samples(good, labels)))


def test_secrets(spark, model):
    rows = scan_secrets(spark.createDataFrame(DOCS, SCHEMA), model).collect()
    assert len(rows) == len(DOCS)
    texts = {i: t for i, t, *_ in DOCS}
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[r.doc_id][:80]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for x, *_ in base) for k in ("assign", "access", "hex"))
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [(k, int(s), int(e)) for k, s, e in spans if k != "markov"] == base
        if "markov" in r.spans:
            assert r.doc_id in (13, 14, 15, 22)  # what the base patterns just miss, and in 22 a bare key
    assert [r.spans for r in rows if r.doc_id == 22] == ["markov:4:36"]


def test_redaction(spark, model):
    docs = spark.createDataFrame([(1, "𝒳 password=hunter2222 and AKIA" + "B" * 16 + " end", 99, "k"), (2, None, 0, "k"), (3, "clean", 5, "k")], "doc_id long, text string, n_chars long, __x string")
    got = {r.doc_id: r for r in redact_secrets(docs, model).collect()}
    assert got[1].text == "𝒳 [SECRET] and [SECRET] end" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3] == (3, "clean", 5, "k")
    assert docs.columns == redact_secrets(docs, model).columns


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain_licenses(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark):
    rows = scan_licenses(spark.createDataFrame(DOCS, SCHEMA)).collect()
    assert len(rows) == len(DOCS)
    texts = {i: t for i, t, *_ in DOCS}
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(texts[r.doc_id]), texts[r.doc_id][:80]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    labels = {TEXTS[r.doc_id]: r.labels for r in rows if r.doc_id is not None and r.doc_id > 17}
    assert labels[TEXTS[19]] == "cc-by,cc-by-nc-4.0,gpl,gpl-3"
    assert labels["Released under the MIT License."] == "mit"
    assert labels[TEXTS[21]] == "apache-2.0,reserved"


def test_containment_suppression(spark):
    table = [Rule(1, "long", "b", "a b c", 0.5), Rule(1, "short", "b", "b", 0.5), Rule(0, "first", "d", "d", 0.5), Rule(5, "wide", "d", "c d e", 0.5)]
    docs = spark.createDataFrame([(1, "licence a b c x b"), (2, "licence a b c"), (3, "licence c d e")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in scan_licenses(docs, table).collect()}
    assert got == {1: "long,short", 2: "long", 3: "first,wide"}


def test_rule_table():
    table = rules()
    assert len(table) > 300
    for r in table:
        re.compile(r.regex)
        assert not re.match(r.regex, "")


def test_each_rule_passes_the_gate_alone(spark):
    texts = {
        "gpl": "This program is free software; you can redistribute it and/or modify it",
        "warranty": "without warranties of any kind",
        "isc": "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
        "unlicense": "this is free and unencumbered software released into the public domain",
        "copyright": "Copyright (c) 2020",
        "cc0": "CC0 1.0",
    }
    rows = [(k, t) for k, t in enumerate(texts.values())] + [(10, "provided on an as is"), (11, "provided AS-IS")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in [*enumerate(texts), (10, "warranty"), (11, "warranty")]:
        assert label in got[k].labels.split(",") and got[k].score > 0, label
    own = scan_licenses(spark.createDataFrame([(1, "some House-Rule text")], "doc_id long, text string"), [Rule(1, "own", "house rule", "house rule", 0.5)]).first()
    assert own.labels == "own" and own.score == 0.5


def example(pattern, most):
    """A string that ``pattern`` matches: with ``most`` all optional parts and the last of alternatives, else neither."""
    from re import _constants as c
    from re import _parser

    def of(items):
        out = ""
        for op, arg in items:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.ANY:
                out += "x"
            elif op is c.IN:
                kind, value = arg[-1 if most else 0]
                out += chr(value if kind is c.LITERAL else value[0])
            elif op is c.MAX_REPEAT:
                least, top, inner = arg
                out += of(inner) * (max(1, least) if most and top else least)
            elif op is c.SUBPATTERN:
                out += of(arg[3])
            elif op is c.BRANCH:
                out += of(arg[1][-1 if most else 0])
            else:
                raise AssertionError(op)
        return out

    return of(_parser.parse(pattern))


def test_every_rule_finds_its_own_example(spark):
    table = rules()
    samples = [(k, example(r.regex, most)) for k, r in enumerate(table) for most in (False, True)]
    for k, t in samples:
        assert re.fullmatch(table[k].regex, t) and table[k].keyword in t and re.search(gate(table), t), table[k]
    got = scan_licenses(spark.createDataFrame([(k, f"x {t} y") for k, t in samples], "doc_id long, text string").repartition(8)).collect()
    assert all(r.labels for r in got) and len(got) == len(samples)
    # a rule is only left out where one that holds its match outranks it
    for r in got:
        own = table[r.doc_id]
        if own.label not in r.labels.split(","):
            texts = [t for k, t in samples if k == r.doc_id]
            assert any(x.priority < own.priority or (x.priority == own.priority and (len(m[0]) > 0)) for x in table if x is not own for t in texts for m in re.finditer(f"(?<= ){x.regex}(?= )", f" x {t} y ")), own


def test_many_detections_are_swept(spark):
    text = "copyright " * 6000 + "this program is free software you can redistribute it and or modify it"
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.labels == "copyright,gpl" and r.n_words == 6013


def test_suppression_is_that_of_all_pairs(spark):
    import random

    rng = random.Random(5)
    words = "a b c d e f".split()
    table = [Rule(rng.randint(1, 4), f"r{k}", "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), 0.5) for k in range(40)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(20)]

    def plain(t):
        line = f" {t} "
        found = [(m.start(), m.end(), r.priority, k) for k, r in enumerate(table) for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", line)]

        def beats(e, d):
            size_e, size_d = e[1] - e[0], d[1] - d[0]
            return e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or (e[2] == d[2] and (size_e > size_d or (size_e == size_d and e[3] < d[3]))))

        return ",".join(sorted({table[d[3]].label for d in found if not any(beats(e, d) for e in found)}))

    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()}
    assert got == {k: plain(t) for k, t in docs}


def test_planted_random_strings(spark, model):
    """Recall on random strings of 12 to 40 characters, and precision on the words and identifiers around them."""
    import random
    import string

    rng = random.Random(3)
    alphabets = [string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/"]
    planted, rows = {}, []
    for k in range(400):
        n = rng.choice((12, 14, 16, 18, 20, 23, 32, 40))
        s = "".join(rng.choice(alphabets[k % 4]) for _ in range(n))
        words = [rng.choice(("ordinary", "words", "internationalization", "get_user_name_by_id", "2024-01-31T12-30", "configuration", "0049123456789", "==================", "application/octet-stream")) for _ in range(12)]
        planted[k] = s
        rows.append((k, " ".join([*words[:6], s, *words[6:]])))
    found = hits = 0
    for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        text = rows[r.doc_id][1]
        spans = {text[int(a) : int(b)] for _, a, b in (x.split(":") for x in r.spans.split(",") if x)}
        found += len(spans)
        hits += any(planted[r.doc_id] in x or x in planted[r.doc_id] for x in spans)
    assert hits >= 0.95 * len(rows) and hits >= 0.98 * found
