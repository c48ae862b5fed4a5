"""Prefix trie: every field of every node against a plain trie in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from isoweave.llm.prefix_trie import build_trie, peel, share_first_turns, turns_of

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth long"


def plain(rows, rebuild=True):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((-(2**70) if t is None else t, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:] if rebuild else turns
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for k in members:
        if k:
            kids[k[:-1]].add(k)

    def totals(k):
        out = [0 if kids[k] else 1, (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)]
        for x in kids[k]:
            leaves, saved = totals(x)
            out = [out[0] + leaves, out[1] + saved]
        return out

    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), *totals(k), hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k)))).encode()).hexdigest())
        for k, m in members.items()
    )


def found(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(cols).collect())


def made(seed):
    """Copies, shared beginnings, conversations that end inside others, nulls, ids without a group's first and negative turns."""
    r = random.Random(seed)
    word = lambda: r.choice(["a", "bé", "", "ccc", "\U0001f600x", None])
    rows = []
    for c in r.sample(range(1000), 120) + [0, 200, 300, 10_000_000_000]:
        for t in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, r.choice(["user", "assistant", None]), word(), "x", 1))
    first = [x for x in rows if x[0] == 200]
    rows += [(c, *x[1:]) for c in range(2000, 2030) for x in first]
    return [*rows, (None, 0, "user", "gone", "x", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_node_as_a_plain_trie_has_it(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(build_trie(share_first_turns(turns_of(df)))) == plain(rows)
    assert found(build_trie(turns_of(df))) == plain(rows, rebuild=False)


def test_each_conversation_a_prefix_of_the_next(spark):
    rows = [(c, t, "user", f"t{t}", "", 0) for c in range(1, 9) for t in range(c)]
    assert found(build_trie(turns_of(spark.createDataFrame(rows, SCHEMA)))) == plain(rows, rebuild=False)


def test_long_unbranched_conversations_take_one_round(spark):
    rows = [(c, t, "user", f"{c}.{t}", "", 0) for c in (100, 101) for t in range(400)]
    assert found(build_trie(turns_of(spark.createDataFrame(rows, SCHEMA)))) == plain_long()
    runs = spark.createDataFrame([(b"a", None, 4), (b"b", b"a", 5), (b"c", b"a", 6)], "run binary, parent binary, own long")
    totals, rounds = peel(runs)
    assert len(rounds) == 2 and {bytes(r.run): (r.n_children, r.n_leaves, r.beneath) for r in totals.collect()} == {b"a": (2, 2, 11), b"b": (0, 1, 0), b"c": (0, 1, 0)}


def plain_long():
    none = hashlib.sha256(b"").hexdigest()
    out = [(100, 0, -1, 2, 2, 2, 0, none)]
    for c in (100, 101):
        for d in range(1, 401):
            out.append((c, d, c if d > 1 else 100, 1, int(d < 400), 1, 0, hashlib.sha256(str(c).encode()).hexdigest() if d == 400 else none))
    return sorted(out)


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(1, 0, "a", "b:c", "", 0), (2, 0, "a:b", "c", "", 0), (3, 0, "ab", "c", "", 0), (4, 0, "a", "bc", "", 0)]
    assert len(found(build_trie(turns_of(spark.createDataFrame(rows, SCHEMA))))) == 5


def test_repeated_rows_are_turns_and_ties_have_an_order(spark):
    rows = [(1, 0, "u", "x", "", 0)] * 2 + [(2, 0, "u", "y", "", 0), (2, 0, "u", "z", "", 0)]
    once = found(build_trie(turns_of(spark.createDataFrame(rows, SCHEMA))))
    assert once == found(build_trie(turns_of(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3))))
    assert max(r[1] for r in once) == 2


def test_empty_table(spark):
    assert found(build_trie(share_first_turns(turns_of(spark.createDataFrame([], SCHEMA))))) == []
