"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of five-word shingles (lower-case words without punctuation). An item is found in a
document if at least ``threshold`` of its shingles are in the document.

Size partitions: documents are dealt to partitions by the power of two above their number of shingles. In each
partition a document's signature is a one-permutation MinHash: the hash space is cut into ``bins_per_shingle`` times as
many bins as the partition's largest document has shingles, and each bin keeps its least hash. The number of bins
follows the size of the long documents, so a short item keeps its chance of a hit in a very long text, which a signature
of fixed length would lose. An item's signature is made anew for each partition. One equal bin makes a candidate; each
candidate is verified by counting exact shingles.

Recall: a shared shingle is missed only if another one of the document falls in its bin with a smaller hash, which has a
chance below 1 / (2 * bins_per_shingle). An item with q shingles shares at least 0.8 q with a document that holds it, so
with 8 bins a shingle it is missed with a chance below 16 ** -ceil(0.8 q). Where that is not below ``miss`` (items of up
to 8 shingles for 1e-9), the item is looked up by every shingle without bins, so none is missed.

Documents are read once and nothing is shuffled. The items travel in blocks of at most ``block_shingles`` shingles, whose
size is checked before they are sent; more items make more passes, all of them whole, with one block on the driver at a
time.

Edge cases: null, empty and wordless texts hold nothing and are held by nothing; an item of fewer than five words is one
shingle of all its words and is found where a document has exactly these words; repeated documents are reported once
each, equal rows of the benchmark once; null ids are carried; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, materialize

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WIDTH = 5


def shingles(text: bytes, width: int = WIDTH) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each shingle begins and ends in that line."""
    words = WORD.findall(text.lower())
    if not words:
        return b"", [], []
    line = b" ".join(words)
    if len(words) <= width:
        return line, [0], [len(line)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return line, [0, *(ends[:-width] + 1).tolist()], ends[width - 1 :].tolist()


def hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct XXH64 of the shingles."""
    import xxhash

    h = xxhash.xxh64_intdigest
    line, starts, ends = shingles(text, width)
    return np.unique(np.array([h(line[a:b]) for a, b in zip(starts, ends, strict=True)], np.uint64))


def signature(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """One-permutation MinHash with 2 ** bits bins: each bin's least hash, which also tells the bin."""
    if bits >= 64 or not len(sorted_hashes):
        return sorted_hashes
    bins = sorted_hashes >> np.uint64(64 - bits)
    return sorted_hashes[np.concatenate([[True], bins[1:] != bins[:-1]])]


class ItemIndex:
    """The items of a block, and their signatures for each size partition, made when first asked for."""

    def __init__(self, items: list[tuple], threshold: float, bins_per_shingle: int, least_shingles: int):
        self.threshold, self.extra = threshold, (bins_per_shingle - 1).bit_length()
        self.sets: list[tuple[object, frozenset[bytes]]] = []
        self.sketches: list[tuple[np.ndarray, bool]] = []
        for item_id, text in items:
            line, starts, ends = shingles((text or "").encode())
            grams = frozenset(line[a:b] for a, b in zip(starts, ends, strict=True))
            if grams:
                self.sets.append((item_id, grams))
                self.sketches.append((hashes(text.encode()), len(grams) < least_shingles))
        self.tables: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}

    def table(self, bits: int) -> tuple[np.ndarray, dict[int, list[int]]]:
        """Sorted signature values of all items in the partition, and the items of each."""
        if bits not in self.tables:
            owners = defaultdict(list)
            for k, (full, small) in enumerate(self.sketches):
                for v in (full if small else signature(full, bits)).tolist():
                    owners[v].append(k)
            self.tables[bits] = (np.array(sorted(owners), np.uint64), dict(owners))
        return self.tables[bits]

    def candidates(self, doc: np.ndarray) -> set[int]:
        """Items with an equal bin in the document's partition, and small items with an equal shingle."""
        if not len(doc):
            return set()
        bits = (len(doc) - 1).bit_length() + self.extra
        values, owners = self.table(bits)
        if not len(values):
            return set()
        at = np.searchsorted(values, doc)
        hit = doc[values[np.minimum(at, len(values) - 1)] == doc]
        if not len(hit):
            return set()
        binned = set(signature(doc, bits).tolist())
        return {k for v in hit.tolist() for k in owners[v] if self.sketches[k][1] or v in binned}

    def search(self, text: bytes) -> list[tuple]:
        """(item_id, shared shingles, item's shingles, containment) of every item that the text holds."""
        found = self.candidates(hashes(text))
        if not found:
            return []
        line, starts, ends = shingles(text)
        grams = {line[a:b] for a, b in zip(starts, ends, strict=True)}
        out = []
        for k in found:
            item_id, own = self.sets[k]
            shared = len(own & grams)
            if shared >= self.threshold * len(own):
                out.append((item_id, shared, len(own), shared / len(own)))
        return out


def least_binned(threshold: float, bins_per_shingle: int, miss: float) -> int:
    """The least number of an item's shingles from which on bins miss it with a chance below ``miss``."""
    n = 1
    while (1 / (2 * bins_per_shingle)) ** max(1, math.ceil(threshold * n)) >= miss:
        n += 1
    return n


class ItemBlocks:
    """The items in blocks of a checked size; one block for a benchmark of usual size. One is held at a time."""

    def __init__(self, benchmark: DataFrame, block_shingles: int):
        self.sc = benchmark.sparkSession.sparkContext
        items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
        items = items.withColumn("size", F.size(F.split(F.coalesce("text", F.lit("")), r"\W+")) + 1)
        total, longest = (x or 0 for x in items.agg(F.sum("size"), F.max("size")).first())
        self.n = max(1, -(-2 * total // block_shingles)) if total > block_shingles else 1
        while True:
            self.dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text", F.lit(1)), F.lit(self.n)))
            largest = self.dealt.groupBy("block").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0
            if largest <= block_shingles + longest:  # an item of its own size is not parted
                break
            self.n *= 2

    def sent(self) -> Iterator[Broadcast]:
        """Each block, sent to the tasks until the next one is asked for."""
        for k in range(self.n):
            shared = self.sc.broadcast([(r.item_id, r.text) for r in self.dealt.where(F.col("block") == k).select("item_id", "text").collect()])
            yield shared
            if self.n > 1:
                shared.destroy()

    def done(self, df: DataFrame) -> DataFrame:
        """What a block gave; written where another one follows."""
        return df if self.n == 1 else materialize(df, "items")


def find_contained(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, bins_per_shingle: int = 8, miss: float = 1e-9, block_shingles: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each item found in each document."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_shared long, n_item long, containment double"
    texts, least = docs.select("doc_id", F.col("text").cast("string")), least_binned(threshold, bins_per_shingle, miss)
    blocks, out = ItemBlocks(benchmark, block_shingles), None
    for shared in blocks.sent():

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, threshold, bins_per_shingle, least)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    ids = part.column(0).to_pylist()
                    rows = [(key, *hit) for key, t in zip(ids, part.column(1).cast(pa.binary()), strict=True) if t.is_valid for hit in index.search(t.as_py())]
                    if rows:
                        cols = list(zip(*rows, strict=True))
                        kinds = [part.schema.field(0).type, None, pa.int64(), pa.int64(), pa.float64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "n_shared", "n_item", "containment"])

        found = blocks.done(texts.mapInArrow(search, schema))
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, bins_per_shingle: int = 8, miss: float = 1e-9, block_shingles: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item; one pass over the rows for each block of items."""
    at, least = docs.columns.index("text"), least_binned(threshold, bins_per_shingle, miss)
    blocks = ItemBlocks(benchmark, block_shingles)
    for shared in blocks.sent():

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, threshold, bins_per_shingle, least)
            for batch in batches:
                texts = batch.column(at).cast(pa.binary())
                yield batch.filter(pa.array([not (t.is_valid and index.search(t.as_py())) for t in texts], pa.bool_()))

        docs = blocks.done(docs.mapInArrow(clean, docs.schema))
    return docs
