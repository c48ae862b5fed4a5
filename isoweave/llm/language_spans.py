"""Language identification: script ranges narrow the candidates, and Viterbi over words labels spans of each language.

A word is a run of letters and marks, cut into pieces of at most ``PIECE``. Its score in a language is the sum of the
log-likelihoods of its three-letter groups, its edges included, hashed to ``BUCKETS`` and counted over all labelled
documents. Where a word's script is one that some language uses, only such languages are its candidates. The best
sequence of languages pays a penalty for every switch. A text's language is the one that labels most of its letters;
its score is their share. All scores are whole numbers, so ties are exact and go to the language with more labelled text.

Most texts need no search: if no stretch of words gains more in another language than one penalty, the sequence that
never switches is the best one, and this follows from running sums. Only other texts are searched word by word.

Counting is a pass with a partial aggregate, labelling a pass without a shuffle. The driver and every task hold a model of
``BUCKETS`` whole numbers for each language. Texts are worked on in chunks; of a whole text only its words' scores
are held.

Edge cases: null texts and those without a letter are ``und`` with score 0, as is everything where no language was
learned; words of a script that no language uses count for none; null ids are carried, and not learned from; repeated rows are labelled
once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS

BUCKETS, PIECE, CHUNK = 1 << 15, 64, 1 << 19
#: Scores are thousandths of a natural logarithm.
UNIT = 1000
#: A task hands on its counts when it has those of so many languages.
HELD_LANGUAGES = 64
#: Unicode ranges of scripts (first, last).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF)],
}
LAST = 0x323B0


@cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point up to ``LAST``: 1 for letters and 2 for marks, the lower-case letter, the script (0: none)."""
    kind = np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(LAST)] + [0], np.uint8)
    lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(LAST + 1)], np.uint32)
    script = np.zeros(LAST + 1, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            script[first : last + 1] = k
    return kind, lower, script


@dataclass
class Words:
    """Of a chunk: hashes of the letter groups, where each word's begin, and each word's start, letters and script."""

    groups: np.ndarray
    at: np.ndarray
    start: np.ndarray
    size: np.ndarray
    script: np.ndarray
    lettered: bool


def read_chunk(chunk: str, before: str, after: str) -> Words:
    """Words of a chunk that begins at a word's or piece's edge, with the two characters before and the one after it."""
    kinds, lower, scripts = characters()
    raw = np.minimum(np.frombuffer((before + chunk + (after or " ")).encode("utf-32-le", "surrogatepass"), "<u4"), LAST)
    kind, n, lead = kinds[raw], len(before) + len(chunk), len(before)
    word = kind > 0
    c = np.full(len(raw) + 2, 32, np.uint32)
    c[2:] = np.where(word, lower[raw], 32)
    one = c[1:-1]
    two = np.where(one == 32, 32, c[:-2])
    hashed = ((two * np.uint32(0x9E3779B1) ^ one) * np.uint32(0x85EBCA6B) ^ c[2:]) * np.uint32(0xC2B2AE35) >> np.uint32(32 - 15)
    behind = np.concatenate([[False], word[:-1]])
    used = word | behind
    used[:lead] = False
    used[n] = behind[n] and not word[n]
    if lead < n and not word[lead]:
        used[lead] = False
    place = np.arange(len(raw))
    opens = word & ~behind
    opens[lead] = word[lead]
    begins = word & ((place - np.maximum.accumulate(np.where(opens, place, 0))) % PIECE == 0)
    begins[:lead] = begins[n:] = False
    at, start = np.flatnonzero(used), np.flatnonzero(begins)
    first = np.searchsorted(at, start)
    size = np.add.reduceat(word[at].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return Words(hashed[at], first, start - lead, size, scripts[raw[start]], bool((kind[lead:n] == 1).any()))


def read_text(text: str, chunk: int = CHUNK) -> Iterator[tuple[int, Words]]:
    """(offset, words) of each chunk; chunks end after a character outside words, or within a word where a piece ends."""
    if chunk % PIECE:
        raise ValueError("chunks must be a multiple of pieces")
    kinds = characters()[0]
    at = 0
    while at < len(text):
        end = min(len(text), at + chunk)
        if end < len(text):
            codes = np.minimum(np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), "<u4"), LAST)
            out = np.flatnonzero(kinds[codes] == 0)
            end = at + int(out[-1]) + 1 if len(out) else end
        yield at, read_chunk(text[at:end], text[max(0, at - 2) : at], text[end : end + 1])
        at = end


@dataclass
class Model:
    """Languages, most labelled text first; weights (language, bucket); which languages a script admits."""

    languages: list[str]
    weights: np.ndarray
    admits: np.ndarray
    penalty: int

    def words(self, text: str | None, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        """Scores (word, language), starts, sizes, whether any language uses the script, and whether there is a letter."""
        parts, lettered = [], False
        for at, w in read_text(text or "", chunk):
            lettered |= w.lettered
            if not len(w.at):
                continue
            score = np.stack([np.add.reduceat(row[w.groups], w.at) for row in self.weights], 1).astype(np.int64)
            score[~self.admits[w.script]] = -(10**6) * UNIT
            known = self.admits[w.script].any(1)
            score[~known] = 0
            parts.append((score, w.start + at, w.size, known))
        if not parts:
            return np.zeros((0, len(self.languages)), np.int64), *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, bool), lettered
        return *(np.concatenate(x) for x in zip(*parts, strict=True)), lettered

    def path(self, score: np.ndarray) -> np.ndarray:
        """The language of each word."""
        best = int(score.sum(0).argmax())
        gain = np.cumsum(score - score[:, best : best + 1], 0)
        low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros_like(gain[:1]), gain[:-1]]), 0), 0) if len(gain) else gain
        if not len(gain) or (gain - low).max() <= self.penalty:
            return np.full(len(score), best)
        return best_path(score, self.penalty)

    def label(self, text: str | None) -> tuple[str, float, list[tuple[str, int, int]]]:
        """Language, score, and spans (language, start, end) of words in a row."""
        if not self.languages:
            return "und", 0.0, []
        score, start, size, known, lettered = self.words(text)
        if not lettered:
            return "und", 0.0, []
        path = self.path(score)
        by = np.bincount(path, size * known, len(self.languages))
        lang = int(by.argmax()) if known.any() else 0
        turns = np.flatnonzero(np.diff(path)) + 1
        first, last = np.concatenate([[0], turns]), np.concatenate([turns, [len(path)]]) - 1
        spans = [(self.languages[k], int(a), int(b)) for k, a, b in zip(path[first], start[first], start[last] + size[last], strict=True)]
        return self.languages[lang], float(by[lang] / size.sum()), spans


def best_path(score: np.ndarray, penalty: int) -> np.ndarray:
    """Viterbi: staying is free, any switch costs the penalty; ties stay, then go to the first."""
    came = np.zeros(score.shape, np.int32)
    value = score[0].tolist()
    every = range(len(value))
    for t, row in enumerate(score[1:].tolist(), 1):
        top = max(value)
        source, cut = value.index(top), top - penalty
        back = [k if value[k] >= cut else source for k in every]
        came[t] = back
        value = [(value[k] if value[k] >= cut else cut) + row[k] for k in every]
    path = np.empty(len(score), np.int64)
    k = value.index(max(value))
    for t in range(len(score) - 1, -1, -1):
        path[t] = k
        k = came[t, k]
    return path


def count_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's (lang, slot, n): letter groups by bucket, then letters by script."""
    held: dict[str, np.ndarray] = {}

    def handed() -> pa.RecordBatch:
        rows = [(lang, np.flatnonzero(n), n[n > 0]) for lang, n in held.items()]
        langs = pa.array([lang for lang, slots, _ in rows for _ in range(len(slots))], pa.string())
        slots, n = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in (1, 2))
        return pa.RecordBatch.from_arrays([langs, pa.array(slots, pa.int64()), pa.array(n, pa.int64())], names=["lang", "slot", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n = held.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1, np.int64))
            for _, w in read_text(text.as_py()):
                n[:BUCKETS] += np.bincount(w.groups, minlength=BUCKETS)
                n[BUCKETS:] += np.bincount(w.script, w.size, len(SCRIPTS) + 1).astype(np.int64)
            if len(held) >= HELD_LANGUAGES:
                yield handed()
                held.clear()
    yield handed()


def train(texts: DataFrame, *, penalty: float = 12.0, smoothing: float = 0.1, least_share: float = 0.001) -> Model:
    """A model from all rows of (lang, text) in which neither is null.

    A script admits the languages that write at least ``least_share`` of their letters in it.
    """
    rows = texts.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(count_groups, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    by: dict[str, np.ndarray] = {}
    lang = counted.column("lang").combine_chunks().dictionary_encode()
    index, slot, n = lang.indices.to_numpy(zero_copy_only=False), counted.column("slot").to_numpy(), counted.column("n").to_numpy()
    for k, name in enumerate(lang.dictionary.to_pylist()):
        row = by.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS) + 1))
        row[slot[index == k]] = n[index == k]
    languages = sorted((x for x in by if by[x].any()), key=lambda x: (-by[x][BUCKETS:].sum(), x))
    full = np.stack([by[x] for x in languages]) if languages else np.zeros((0, BUCKETS + len(SCRIPTS) + 1))
    groups, letters = full[:, :BUCKETS], full[:, BUCKETS:]
    weights = np.rint(UNIT * np.log((groups + smoothing) / (groups.sum(1, keepdims=True) + smoothing * BUCKETS))).astype(np.int32)
    admits = (letters >= least_share * letters.sum(1, keepdims=True)) & (letters > 0)
    return Model(languages, weights, admits.T.copy(), int(penalty * UNIT))


def label_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and spans (lang, start, end; code points) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = [m.label(t.as_py()) for t in part.column(1)]
                spans = pa.array([[{"lang": k, "start": a, "end": b} for k, a, b in r[2]] for r in rows], span)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), spans], names=["doc_id", "lang_pred", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang: string, start: bigint, end: bigint>>")
