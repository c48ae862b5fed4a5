"""Sequence packing as vector bin packing with the dot-product heuristic.

Each sequence (bin) has three capacities: tokens, segments and loss-bearing tokens. A document's piece (item) is a
vector of the same three. Among the open bins that can hold an item whole, the one whose free capacity has the largest
dot product with the item is taken. Where none can, the item is cut and its head fills the best open bin.

Packing needs no shuffle: each task streams its rows through a fixed number of open bins, so memory does not grow with
the input, and a hot source or a very long document is as good as any other. A document of more ids than a sequence
holds is emitted in full sequences as it comes. At a task's end the pieces of the emptiest bin go to the others until
one bin is left, and that one is cut at powers of two, which need no padding. A sequence that the limit on segments or
loss closes early is one sequence.

Edge cases: a null or empty text is a document of one token (the end token); an empty table gives no rows; repeated
rows are packed once each; a null id is carried as null; of bins with the same product the first one is taken; columns
other than the named ones are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS

#: Distinct words whose ids a worker remembers before it starts anew.
CACHE_WORDS = 600_000
#: New words that are encoded in one call.
JOINED_WORDS = 500


class WordTokenizer:
    """Token ids of whole texts through a cache of space-separated words.

    The tokenizer's pieces never cross white space, nor the border of a letter and a comma or stop before a space, so
    encoding each distinct word once is exact. New words of letters only are encoded many at a time and parted at the
    ids that end a word. Texts in which case, composition or special tokens could reach further (any mark or "<|") are
    encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        ends = self.used + np.cumsum(lengths)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        n = len(self.known)
        while n + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[n + 1 : n + 1 + len(words)] = ends
        self.used += len(flat)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        other = [w for w in words if not w.isalpha()]
        parts = [plain[i : i + JOINED_WORDS] for i in range(0, len(plain), JOINED_WORDS)]
        for part, ids in zip(parts, self._ids([" ".join(p) for p in parts]), strict=True):
            flat = np.array(ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[flat]) + 1
            if len(ends) == len(part):
                self._add(part, flat, np.diff(ends, prepend=0))
            else:  # a letter whose lower case is more than letters
                other += part
        if other:
            found = self._ids(other)
            self._add(other, np.fromiter((i for e in found for i in e), np.uint32), np.array([len(e) for e in found]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin (one more entry than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.flatnonzero(pc.match_substring_regex(texts, r"\p{M}|<\|").to_numpy(zero_copy_only=False))
        if not len(whole):
            return self._encode(texts)
        flat, bounds = self._encode(pc.if_else(pc.is_in(pa.array(np.arange(len(texts))), pa.array(whole)), "", texts))
        parts = np.split(flat, bounds[1:-1])
        for k, ids in zip(whole, self._ids([texts[int(k)].as_py() for k in whole]), strict=True):
            parts[k] = np.array(ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # in this order: lower-casing a slice of an array would go wrong
        lower = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        words = pc.split_pattern(pc.replace_substring_regex(lower, r"([a-z])([.,])( |$)", r"\1 \2\3"), " ")
        bounds = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self._reset()
        self._learn([w for w in distinct if w not in self.known])
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        words_at = at[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.empty(0, np.int64)
        first, length = self.starts[words_at], self.starts[words_at + 1] - self.starts[words_at]
        ends = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]
        return flat, ends[bounds - bounds[0]]


class Bin:
    """An open sequence."""

    __slots__ = ("pieces", "tokens")

    def __init__(self) -> None:
        self.pieces: list[tuple] = []
        self.tokens = 0


class VectorPacker:
    """Places items under limits on tokens, segments and loss-bearing tokens; at most ``open_bins`` are open at a time.

    ``out`` collects rows (key, start, length, crc32 of the ids, key's tokens, sequence, offset).
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, open_bins: int, first_sequence: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.max_tokens, self.max_segments, self.max_loss = max_tokens, max_segments, max_loss
        self.free = np.zeros((open_bins, 3))
        self.bins: list[Bin | None] = [None] * open_bins
        self.sequence = first_sequence
        self.fewest = False  # at the end, an item is rather cut than given a new bin
        self.out: list[tuple] = []

    def add(self, key: object, ids: np.ndarray, loss: np.ndarray | None = None) -> None:
        """``loss``: which of the ids bear loss; None means all. One of another length than ``ids`` is an error."""
        if loss is not None and len(loss) != len(ids):
            raise ValueError(f"loss has {len(loss)} marks for {len(ids)} ids")
        self._place(key, ids, loss, 0, len(ids))

    def _place(self, key: object, ids: np.ndarray, loss: np.ndarray | None, first: int, whole: int) -> None:
        """Place the ids of ``key`` from ``first`` on; ``whole`` is the number of all its ids."""
        before = np.concatenate([[0], np.cumsum(loss)]) if loss is not None else None
        start, total = 0, len(ids)
        while start < total:
            left = total - start
            if left >= self.max_tokens and before is None and self.max_loss >= self.max_tokens:
                self._emit([(key, first + start, ids[start : start + self.max_tokens], whole)])
                start += self.max_tokens
                continue
            need = left if before is None else int(before[total] - before[start])
            k = self._choose(np.array([left, 1, need], float))
            room = int(self.free[k, 0])
            take = min(left, room)
            if before is None:
                take = min(take, int(self.free[k, 2]))
            else:
                take = min(take, int(np.searchsorted(before, before[start] + self.free[k, 2], "right")) - 1 - start)
            got = take if before is None else int(before[start + take] - before[start])
            if take:
                b = self.bins[k]
                b.pieces.append((key, first + start, ids[start : start + take], whole, None if loss is None else loss[start : start + take]))
                b.tokens += take
                self.free[k] -= (take, 1, got)
                start += take
            if self.free[k, 0] < 1 or self.free[k, 1] < 1 or (self.free[k, 2] < 1 and before is None):
                self._close(k)
            elif start < total:  # the item needed more than the bin had, and only loss stands in the way
                self._close(k)

    def _choose(self, need: np.ndarray) -> int:
        free = self.free
        opened = free[:, 1] >= 1
        score = (free / self.limits) @ (need / self.limits)
        fits = opened & (free >= need).all(axis=1)
        if fits.any():
            return int(np.where(fits, score, -1).argmax())
        if not opened.all() and not (self.fewest and opened.any()):
            k = int((~opened).argmax())
            self.bins[k], self.free[k] = Bin(), self.limits
            return k
        return int(np.where(opened, score, -1).argmax())

    def _close(self, k: int) -> None:
        self._emit([p[:4] for p in self.bins[k].pieces])
        self.bins[k], self.free[k] = None, 0

    def _emit(self, pieces: list[tuple], cut: bool = False) -> None:
        """One sequence; with ``cut`` one whose length is below the limit becomes sequences of powers of two."""
        left = sum(len(p[2]) for p in pieces)
        at, done = 0, 0
        while left:
            size = 1 << (left.bit_length() - 1) if cut and left < self.max_tokens else left
            offset = 0
            while offset < size:
                key, start, ids, total = pieces[at]
                take = min(len(ids) - done, size - offset)
                part = ids[done : done + take]
                self.out.append((key, start + done, take, zlib.crc32(part.tobytes()), total, self.sequence, offset))
                offset += take
                done += take
                if done == len(ids):
                    at, done = at + 1, 0
            self.sequence += 1
            left -= size

    def finish(self) -> None:
        """Close the open bins: the pieces of the emptiest one go to the others by the heuristic until one bin is left.

        Only that last bin is cut at powers of two.
        """
        while (opened := [k for k, b in enumerate(self.bins) if b is not None]):
            k = min(opened, key=lambda i: (self.bins[i].tokens, i))
            pieces = self.bins[k].pieces
            self.bins[k], self.free[k] = None, 0
            if len(opened) == 1:
                self._emit([p[:4] for p in pieces], cut=True)
                return
            self.fewest = True
            for key, start, ids, total, loss in pieces:
                self._place(key, ids, loss, start, total)
            self.fewest = False


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    max_tokens: int = 4096,
    max_segments: int = 1024,
    max_loss: int = 4096,
    open_bins: int = 64,
) -> DataFrame:
    """Pack all documents; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document's ids are the tokenizer's,
    then ``end_id``. Every id bears loss.
    """
    id_type = docs.schema[id_col].dataType
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = "doc_id " + id_type.simpleString() + "".join(f", {n} long" for n in names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = WordTokenizer(tokenizer_path)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        packer = VectorPacker(max_tokens, max_segments, max_loss, open_bins, task << 36)
        kind = None

        def rows() -> pa.RecordBatch:
            cols = list(zip(*packer.out, strict=True))
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", *names])

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                flat, bounds = tokens.encode(part.column(1))
                for k, key in enumerate(part.column(0).to_pylist()):
                    packer.add(key, np.append(flat[bounds[k] : bounds[k + 1]], np.uint32(end_id)))
                if packer.out:
                    yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(pack, schema)


def pack_examples(items: DataFrame, *, max_tokens: int = 4096, max_segments: int = 64, max_loss: int = 2048, open_bins: int = 64) -> DataFrame:
    """Pack instruction examples given as rows (example_id, ids ARRAY<INT>, loss ARRAY<BOOLEAN>) under all three limits.

    ``loss`` null means that every id bears loss; a null or empty ``ids`` is placed nowhere. Columns as in ``pack_documents``.
    """
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = "doc_id " + items.schema["example_id"].dataType.simpleString() + "".join(f", {n} long" for n in names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        packer = VectorPacker(max_tokens, max_segments, max_loss, open_bins, task << 36)
        kind = pa.int64()

        def rows() -> pa.RecordBatch:
            cols = list(zip(*packer.out, strict=True))
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", *names])

        for batch in batches:
            kind = batch.schema.field(0).type
            for row in batch.to_pylist():
                if row["ids"]:
                    loss = None if row["loss"] is None else np.array([bool(x) for x in row["loss"]])
                    packer.add(row["example_id"], np.array(row["ids"], np.uint32), loss)
            if packer.out:
                yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    return items.select("example_id", "ids", "loss").mapInArrow(pack, schema)
