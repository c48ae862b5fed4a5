"""Toxic spans by a linear-chain conditional random field.

Tokens carry two tags, clean and toxic. A token's features are its form, its first letters and its last letters; they
are hashed into a weight table of fixed size. Only documents are labelled, so training tokens get their tags from
them: a token is tagged toxic in a toxic document if its form or its first letters are much likelier in toxic than in
clean documents. The field is then fitted to the tagged sequences by gradient ascent on the penalised likelihood, with
gradients from forward-backward.

Sequences are lines, cut at sentence ends, of any length; forward-backward runs over all sequences of a slice of rows at
once. A document's evidence grows with the tokens' surprise at being clean (minus the log of the clean marginal), each
weighted by the square of its toxic marginal, so that a long text's many faint tokens add up to nothing; a logistic
curve of its logarithm and of the largest marginal, fitted to documents the field has not seen, makes it a score.
Offending offsets are runs of tokens whose toxic marginal is a half or more.

Scoring is one pass without a shuffle. The model is of a fixed size whatever the corpus, so it is broadcast. Training
reads at most ``max_docs`` labelled documents, half of them toxic where there are enough, least hash first, and fewer
where they have more than ``max_chars`` characters in all; their texts are read whole. The field is not fitted to those
of them that share two of their eight least hashed word pairs with an earlier one (copies would lend common words a
support that they don't have). Where nothing tells toxic from clean documents, scores are the labels' share of toxic ones.

Edge cases: null, empty and wordless texts have no tokens and get the curve's value at zero; a very long text without
sentence ends is one sequence; equal marginals score alike, so ties stay ties; null ids are carried and
count as held in for training (they have no label anyway); repeated rows are scored once each; an empty table gives no
rows, and without labels of both kinds every score is zero; labels of both kinds with documents of one kind only are an
error; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS

TABLE_BITS = 18
#: A word with what surrounds it up to the next one; a sentence ends at a stop or a line break.
TOKEN = re.compile(r"\w+")
STOP = re.compile(r"[.!?\n]")
#: A part of a sentence that ends with a word, for a sample of a long text.
PIECE = re.compile(r"[^.!?\n]{1,1000}(?=\W|\Z)|[^.!?\n]{1,1000}")
CACHE_WORDS = 400_000


def features(word: str) -> list[int]:
    """Slots of a lower-case word's features in the weight table."""
    parts = ["w=" + word, *(f"p{n}={word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n), *(f"s{n}={word[-n:]}" for n in (3, 4) if len(word) > n)]
    return [zlib.crc32(p.encode()) & ((1 << TABLE_BITS) - 1) for p in parts]


def tokenize(text: str | None) -> tuple[list[str], list[int], list[int], list[int]]:
    """Lower-case words, their starts and ends, and the number of each word's sequence."""
    words, starts, ends, seqs = [], [], [], []
    seq = last = 0
    for m in TOKEN.finditer(text or ""):
        a, b = m.span()
        if words and STOP.search(text, last, a):
            seq += 1
        words.append(m[0].lower())
        starts.append(a)
        ends.append(b)
        seqs.append(seq)
        last = b
    return words, starts, ends, seqs


def marginals(emission: np.ndarray, seqs: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Toxic marginal of each token, expected transitions and the sum of log partition functions.

    ``emission`` is the score of the toxic tag (the clean one scores 0); ``seqs`` numbers each token's sequence, in
    order. All sequences advance together, longest first.
    """
    n = len(emission)
    if not n:
        return np.empty(0), np.zeros((2, 2)), 0.0
    first = np.flatnonzero(np.concatenate([[True], seqs[1:] != seqs[:-1]]))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    m, steps = len(first), int(length[0])
    live = np.searchsorted(-length, -np.arange(1, steps + 1), "right")  # sequences that have a token at each step
    e = np.exp(np.clip(emission, -30, 30))
    t = np.exp(transition)
    fwd, scale = [], []  # of the sequences that go on at each step
    a = np.empty((m, 2))
    for k in range(steps):
        c = live[k]
        x = e[first[:c] + k]
        p = np.broadcast_to(np.exp(start), (c, 2)) if k == 0 else a[:c] @ t
        a = np.stack([p[:, 0], p[:, 1] * x], axis=1)
        s = a.sum(axis=1)
        a /= s[:, None]
        fwd.append(a)
        scale.append(s)
    out = np.empty(n)
    pairs = np.zeros((2, 2))
    b = np.ones((m, 2))
    for k in range(steps - 1, -1, -1):
        c = live[k]
        joint = fwd[k] * b[:c]
        out[first[:c] + k] = joint[:, 1] / joint.sum(axis=1)
        if k:
            own = np.stack([b[:c, 0], b[:c, 1] * e[first[:c] + k]], axis=1) / scale[k][:, None]
            pairs += t * (fwd[k - 1][:c].T @ own)
            b[:c] = own @ t.T
    return out, pairs, float(sum(np.log(s).sum() for s in scale))


@dataclass
class Model:
    """Weights of the field and of the curve from document evidence to score."""

    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    curve: tuple[float, float] = (0.0, -30.0)
    cache: dict[str, float] = field(default_factory=dict)

    def emission(self, words: list[str]) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        get, w = self.cache.get, self.weights
        out = np.empty(len(words))
        for k, word in enumerate(words):
            v = get(word)
            if v is None:
                v = self.cache[word] = float(w[features(word)].sum())
            out[k] = v
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * evidence + self.curve[1], -30, 30)))

    def tag(self, texts: list[str | None], threshold: float = 0.5) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Evidence and offending spans of each text.

        Evidence is log(1 + sum of p * p * -log(1 - p)) over the tokens' marginals p, plus the largest p.
        """
        toks = [tokenize(t) for t in texts]
        counts = [len(t[0]) for t in toks]
        if not sum(counts):
            return np.zeros(len(texts)), [[] for _ in texts]
        base = np.cumsum([0, *[(t[3][-1] + 1 if t[3] else 0) for t in toks]])
        seqs = np.concatenate([np.array(t[3], np.int64) + b for t, b in zip(toks, base, strict=False)])
        p, _, _ = marginals(self.emission([w for t in toks for w in t[0]]), seqs, self.transition, self.start)
        bounds = np.cumsum([0, *counts])
        most = np.maximum.reduceat(np.append(p, 0.0), np.minimum(bounds[:-1], len(p)))
        most[np.array(counts) == 0] = 0
        logs = np.concatenate([[0], np.cumsum(-p * p * np.log1p(-np.minimum(p, 1 - 1e-9)))])
        spans = [[] for _ in texts]
        for k in np.flatnonzero(p >= threshold):
            d = int(np.searchsorted(bounds, k, "right")) - 1
            _, starts, ends, own = toks[d]
            i = int(k - bounds[d])
            if spans[d] and i and own[i] == own[i - 1] and spans[d][-1][1] == ends[i - 1]:
                spans[d][-1] = (spans[d][-1][0], ends[i])
            else:
                spans[d].append((starts[i], ends[i]))
        return np.log1p(np.maximum(logs[bounds[1:]] - logs[bounds[:-1]], 0)) + most, spans


def without_near_copies(texts: list[str | None], sketch: int = 8, shared: int = 2) -> list[int]:
    """Indices of texts that share fewer than ``shared`` of the ``sketch`` least hashed word pairs with an earlier one.

    Copies of one text would lend their common words a support that they don't have.
    """
    seen: set[int] = set()
    out = []
    for k, t in enumerate(texts):
        words = tokenize(t)[0]
        least = sorted({zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:], strict=False)})[:sketch]
        if sum(x in seen for x in least) < shared:
            out.append(k)
        seen.update(least)
    return out


def weak_tags(texts: list[str | None], toxic: list[bool], least: int = 4, few: float = 0.4, share: float = 0.01, ratio: float = 3.5) -> set[str]:
    """Forms and first letters (4 to 6, marked "p") that are ``e ** ratio`` times likelier in toxic documents.

    Each has to be in ``least`` toxic documents, and in this ``share`` of them; where ``few`` of all toxic ones are fewer than
    ``least``, in so many, but never in one only.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for t, bad in zip(texts, toxic, strict=True):
        words = set(tokenize(t)[0])
        seen[bad].update(words | {f"p{w[:n]}" for w in words for n in (4, 5, 6) if len(w) >= n})
    n_bad, n_good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    least = min(least, max(2, int(np.ceil(few * n_bad))))
    out = set()
    for x, c in seen[1].items():
        if c >= max(least, share * n_bad) and np.log((c + 0.5) / n_bad) - np.log((seen[0][x] + 0.5) / n_good) > ratio:
            out.add(x)
    return out


def train(texts: list[str | None], toxic: list[bool], share: float | None = None, *, rounds: int = 60, penalty: float = 1e-4, rate: float = 0.3) -> Model:
    """Fit the field to three of four documents, and the curve to the rest; ``share`` is the labels' share of toxic ones.

    Where no form tells toxic documents from clean ones, or the evidence of those left over doesn't, every score is the share.
    """
    toxic = [bool(x) for x in toxic]
    model = Model(np.zeros(1 << TABLE_BITS), np.zeros((2, 2)), np.zeros(2))
    if not any(toxic) or all(toxic):
        return model
    lone = set(without_near_copies(texts))
    fit = [k for k in range(len(texts)) if k % 4 and k in lone]
    marks = weak_tags([texts[k] for k in fit], [toxic[k] for k in fit])
    share = float(np.mean(toxic)) if share is None else share
    model.curve = (0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if not marks:
        return model
    # tokens are numbers of distinct words, whose features are listed once
    vocab: dict[str, int] = {}
    parts, seq_parts, tag_parts, base = [], [], [], 0
    for k in fit:
        words, _, _, own = tokenize(texts[k])
        if not words:
            continue
        parts.append(np.array([vocab.setdefault(w, len(vocab)) for w in words], np.int32))
        seq_parts.append(np.array(own, np.int32) + base)
        base += own[-1] + 1
        tag_parts.append(np.array([toxic[k] and (w in marks or any(f"p{w[:n]}" in marks for n in (4, 5, 6))) for w in words]))
    if not parts:
        return model
    tokens, seq, tag = np.concatenate(parts), np.concatenate(seq_parts), np.concatenate(tag_parts).astype(float)
    listed = [np.array(features(w), np.int32) for w in vocab]
    flat, word = np.concatenate(listed), np.repeat(np.arange(len(listed), dtype=np.int32), [len(x) for x in listed])
    del listed, parts, seq_parts, tag_parts

    def by_slot(of_token: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=np.bincount(tokens, weights=of_token, minlength=len(vocab))[word], minlength=1 << TABLE_BITS)

    first = np.concatenate([[True], seq[1:] != seq[:-1]])
    pair = 2 * tag[:-1][~first[1:]].astype(int) + tag[1:][~first[1:]].astype(int)
    seen_pairs = np.bincount(pair, minlength=4).reshape(2, 2).astype(float)
    seen_start = np.array([(tag[first] == 0).sum(), (tag[first] == 1).sum()], float)
    want = by_slot(tag)
    moments = [np.zeros((2, *x.shape)) for x in (model.weights, model.transition, model.start)]
    n = max(1.0, tag.sum())
    for r in range(1, rounds + 1):
        emission = np.bincount(word, weights=model.weights[flat], minlength=len(vocab))[tokens]
        p, pairs, _ = marginals(emission, seq, model.transition, model.start)
        p_first = np.array([(1 - p[first]).sum(), p[first].sum()])
        grads = [(want - by_slot(p)) / n - penalty * model.weights, (seen_pairs - pairs) / n - penalty * model.transition, (seen_start - p_first) / n - penalty * model.start]
        for x, g, (m, v) in zip((model.weights, model.transition, model.start), grads, moments, strict=True):
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            x += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-6)
    model.cache.clear()
    held = [k for k in range(len(texts)) if not k % 4]
    evidence = np.concatenate([model.tag([texts[k] for k in held[i : i + 100]])[0] for i in range(0, len(held), 100)])
    held_toxic = np.array([toxic[k] for k in held], float)
    if len(held_toxic) and 0 < held_toxic.sum() < len(held_toxic) and evidence[held_toxic == 1].mean() > evidence[held_toxic == 0].mean():
        model.curve = fit_curve(evidence, held_toxic)
    elif share < 0.5:  # none or one kind was left over: what any mark says is all that is known
        model.curve = (4.0, -4.0)
    model.cache.clear()
    return model


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (not below 0.1) and offset of a logistic curve by Newton steps, classes weighted alike, with a light ridge."""
    w = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, -1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        ridge = np.array([0.01, 0.01])
        grad = design.T @ (w * (y - p)) - ridge * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
    return max(0.1, float(beta[0])), float(beta[1])


def training_rows(docs: DataFrame, labels: DataFrame, column: str, *, max_docs: int, folds: int = 5) -> DataFrame:
    """(doc_id, text, label) of at most ``max_docs`` documents whose crc32(doc_id) mod ``folds`` isn't 0, shared between the labels.

    The choice depends on the documents' ids alone: least hash first for each label.
    """
    own = labels.where(F.col(column).isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != 0)).select("doc_id", F.col(column).cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    half = max_docs // 2
    few = {r.label: r.n for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {x: min(few.get(x, 0), max(half, max_docs - few.get(1 - x, 0))) for x in (0, 1)}
    picked = [own.where(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for x, n in share.items()]
    sample = picked[0].unionByName(picked[1])
    one = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "text", "label")


def within(rows: list[tuple], most: int) -> list:
    """Ids of (id, label, size) that have at most ``most`` in all, in their order; each label keeps its share of the whole.

    What doesn't fit any more is passed over, so that long texts don't end the sample; a label's first row is always taken.
    """
    total = sum(r[2] for r in rows)
    out = []
    for label in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == label]
        left = most * sum(r[2] for r in own) // max(1, total)
        for k, (i, _, size) in enumerate(own):
            if size <= left or not k:
                left -= size
                out.append(i)
    return out


def sampled_texts(rows: DataFrame, max_chars: int) -> tuple[list[str | None], list[int]]:
    """Texts and labels of ``rows`` (doc_id, text, label), whole ones, least hash first; where they have more than
    ``max_chars`` characters in all, fewer rows (``within``)."""
    sizes = [tuple(r) for r in rows.select("doc_id", "label", F.coalesce(F.length("text"), F.lit(0))).collect()]
    if sum(r[2] for r in sizes) > max_chars:
        kept = rows.sparkSession.createDataFrame([(i,) for i in within(sizes, max_chars)], rows.select("doc_id").schema)
        rows = rows.join(F.broadcast(kept), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
    texts, labels = [], []
    for r in rows.select(F.col("text").cast("string").alias("text"), "label").toLocalIterator():
        texts.append(r.text)
        labels.append(int(r.label))
    return texts, labels


def train_on(docs: DataFrame, labels: DataFrame, *, max_docs: int = 4000, max_chars: int = 10_000_000) -> Model:
    """Train on a bounded sample of the labelled documents: at most ``max_docs``, and fewer beyond ``max_chars`` in all."""
    texts, toxic = sampled_texts(training_rows(docs, labels, "toxic", max_docs=max_docs), max_chars)
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    share, kinds = known.agg(F.avg(F.col("toxic").cast("int")), F.count_distinct(F.col("toxic").cast("int"))).first()
    if len(set(toxic)) == 1 and kinds > 1:
        raise ValueError("labels are of both kinds, but the documents to train on are of one kind only")
    return train(texts, [bool(x) for x in toxic], share)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_toxic, spans (array of start, end; code points, end exclusive) for every row."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, n_toxic long, spans array<struct<start:int,end:int>>"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                evidence, spans = m.tag(part.column(1).to_pylist())
                found = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span_type)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(evidence)), pa.array([len(s) for s in spans], pa.int64()), found], names=["doc_id", "score", "n_toxic", "spans"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                evidence, _ = m.tag(part.column(at).cast(pa.string()).to_pylist())
                yield part.filter(pa.array(m.score(evidence) < threshold))

    return docs.mapInArrow(run, docs.schema)
