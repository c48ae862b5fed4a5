"""Packing against a plain encoder: every id lies in exactly one piece and sequences have no gaps."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from isoweave.llm.packing import VectorPacker, WordTokenizer, pack_documents, pack_examples
from isoweave.llm.queries import tokenizer_path

TEXTS = [
    (0, None, 1),
    (1, "", 1),
    (2, "Hello, world! don't <|endoftext|> stop\tnow here\r\nx", 1),
    (3, "ÉCOLE école\nΣΑΣ ẞ İstanbul 12345 é ́", 1),
    (4, "word " * 9000, 1),
    (4, "word " * 9000, 1),
    (None, "no id", 1),
    (7, "J\u030c A\u030a <|ENDOFTEXT|> x", 1),
    (8, "Wort, Wort. WORT.. wort.\nDon't. \u0130stanbul \u0130 x.y, ... é. ﬁn Ⅷ x² 中文 中文。", 1),
    (6, "a\x0bb\x1cc  d   \n\n e f", 1),
]


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_are_exact(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, sequence_id int").coalesce(1)
    rows = pack_documents(docs, tokenizer_path()).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for key, text, _ in TEXTS:
        ids, copies = ids_of(text), sum(k == key for k, _, _ in TEXTS)
        got = sorted((r.start, r.length, r.ids_crc32) for r in by_doc[key])
        assert sum(n for _, n, _ in got) == copies * len(ids)
        for start, n, crc in got:
            assert crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
        assert all(r.doc_tokens == len(ids) for r in by_doc[key])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0


def test_slices_are_encoded_alike():
    texts = [t or "" for _, t, _ in TEXTS] * 3
    tok = WordTokenizer(tokenizer_path())
    for at in (0, 5, 11):
        flat, bounds = tok.encode(pa.array(texts).slice(at, 9))
        for k, t in enumerate(texts[at : at + 9]):
            assert flat[bounds[k] : bounds[k + 1]].tolist() == ids_of(t)[:-1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(docs, tokenizer_path()).count() == 0


@pytest.mark.parametrize(("segments", "loss"), [(3, 4096), (64, 1500), (2, 700)])
def test_limits_hold(segments, loss):
    rng = np.random.default_rng(1)
    packer = VectorPacker(4096, segments, loss, 8, 0)
    items = [(rng.integers(0, 50000, n).astype(np.uint32), rng.random(n) < 0.4) for n in rng.integers(1, 6000, 200)]
    for k, (ids, mask) in enumerate(items):
        packer.add(k, ids, mask)
    packer.finish()
    seqs, docs = defaultdict(list), defaultdict(list)
    for key, start, n, _crc, total, seq, offset in packer.out:
        seqs[seq].append((offset, key, start, n))
        docs[key].append((start, n))
        assert total == len(items[key][0])
    for key, (ids, _) in enumerate(items):
        at = 0
        for start, n in sorted(docs[key]):
            assert start == at
            at += n
        assert at == len(ids)
    for pieces in seqs.values():
        assert len(pieces) <= segments
        assert sum(n for *_, n in pieces) <= 4096
        assert sum(int(items[k][1][s : s + n].sum()) for _, k, s, n in pieces) <= loss


def test_examples(spark):
    rows = [(1, [5, 6, 7], [False, True, True]), (2, None, None), (3, [9], None), (4, [], [])]
    out = pack_examples(spark.createDataFrame(rows, "example_id long, ids array<int>, loss array<boolean>")).collect()
    assert sorted((r.doc_id, r.length) for r in out if r.doc_id == 3) == [(3, 1)]
    assert sum(r.length for r in out if r.doc_id == 1) == 3
    assert {r.doc_id for r in out} == {1, 3}


def sequences(out):
    return len({r[5] for r in out})


def test_sequences_are_few():
    """At most twelve more than the tokens, the segments or the loss call for: the last bin is cut at powers of two."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 3000, 400)
    items = [rng.integers(0, 50000, n).astype(np.uint32) for n in sizes]
    whole = VectorPacker(4096, 1024, 4096, 64, 0)
    for k, ids in enumerate(items):
        whole.add(k, ids)
    whole.finish()
    assert sequences(whole.out) <= -(-sizes.sum() // 4096) + 12

    masks = [np.arange(n) >= n // 2 for n in sizes]  # prompts bear no loss
    partly = VectorPacker(4096, 64, 2048, 64, 0)
    for k, (ids, mask) in enumerate(zip(items, masks, strict=True)):
        partly.add(k, ids, mask)
    partly.finish()
    ideal = max(-(-sizes.sum() // 4096), -(-sum(int(m.sum()) for m in masks) // 2048))
    assert sequences(partly.out) <= 1.1 * ideal + 12

    short = VectorPacker(4096, 8, 4096, 64, 0)
    for k in range(1000):
        short.add(k, items[k % 400][:20])
    short.finish()
    assert sequences(short.out) <= -(-1000 // 8) + 12


def test_documents_fill_sequences(spark):
    docs = spark.createDataFrame([(k, "word " * (k % 700 + 1)) for k in range(600)], "doc_id long, text string").coalesce(1)
    rows = pack_documents(docs, tokenizer_path()).collect()
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 4096) + 12


def test_loss_of_another_length_is_an_error():
    with pytest.raises(ValueError, match="marks"):
        VectorPacker(4096, 8, 4096, 4, 0).add(1, np.arange(3, dtype=np.uint32), np.array([True]))
