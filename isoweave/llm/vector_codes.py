"""Vector code compression: product codes whose codebooks are fitted by Lloyd's rounds with Elkan's bounds.

A vector becomes integers (floor of ``scale`` times each component) and is cut into equal parts; each part position has
a codebook. Between rounds every part keeps an upper bound of the distance to its own entry and one lower bound for each
entry. Bounds are whole numbers, rounded outwards, and are shifted by how far entries moved; an entry is passed over only
where the triangle inequality puts it strictly farther away. What remains is compared by exact integer distances, ties to
the lower index, so codes are those of a full search.

Each round is a pass over the written state without a shuffle; sums of parts by entry are a partial aggregate. The
driver holds the codebooks only (entries times the vectors' length), and a round's folder goes once the next is written.

Edge cases: vectors that are null or hold null or non-finite components are dropped; shorter vectors than the longest, and
lengths that the parts don't divide, are filled up with zeros; null ids come last and keep their rows; repeated rows count
as often as they occur; fewer vectors than entries give a smaller codebook; components whose exact distances would not
fit 56 bits are an error; no vector gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def floor_root(d: np.ndarray) -> np.ndarray:
    """The whole part of each root, exactly."""
    r = np.sqrt(d.astype(float)).astype(np.int64)
    r -= r * r > d
    return r + ((r + 1) * (r + 1) <= d)


def ceil_root(d: np.ndarray) -> np.ndarray:
    r = floor_root(d)
    return r + (r * r < d)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


@dataclass
class Bounds:
    """Of one part position: each row's entry, the upper bound of its distance, and lower bounds by entry."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    def shift(self, moved: np.ndarray) -> None:
        """Entries moved by at most so much."""
        self.upper = self.upper + moved[self.code]
        self.lower = np.maximum(self.lower - moved, 0)

    def assign(self, x: np.ndarray, book: np.ndarray) -> None:
        """Move every row to its nearest entry."""
        between = floor_root(squared(book[:, None], book[None]))
        every = np.arange(len(book))

        def open_(rows: np.ndarray) -> np.ndarray:
            up, own = self.upper[rows, None], self.code[rows]
            return (self.lower[rows] <= up) & (between[own] <= 2 * up) & (every != own[:, None])

        maybe = np.flatnonzero(open_(np.arange(len(x))).any(1) | (self.upper >= 2**31))
        own = squared(x[maybe], book[self.code[maybe]])
        self.upper[maybe] = ceil_root(own)
        still = open_(maybe)
        at, entry = np.nonzero(still)
        far = np.full((len(maybe), len(book)), np.iinfo(np.int64).max)
        far[at, entry] = squared(x[maybe[at]], book[entry])
        far[np.arange(len(maybe)), self.code[maybe]] = own
        known = far < np.iinfo(np.int64).max
        self.lower[maybe] = np.where(known, floor_root(np.where(known, far, 0)), self.lower[maybe])
        best = far.argmin(1)  # the first of equals
        self.code[maybe] = best
        self.upper[maybe] = ceil_root(far[np.arange(len(maybe)), best])


def integers(column: pa.Array, parts: int, width: int, scale: int) -> np.ndarray:
    """(rows, parts, width): whole numbers of a list column, with zeros behind."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
    if len(values) and width * (2 * float(np.abs(values).max()) + 2) ** 2 >= 2.0**56:
        raise ValueError("components are too large for exact distances")
    out = np.zeros((len(sizes), parts * width), np.int64)
    out[np.arange(parts * width) < sizes[:, None]] = values.astype(np.int64)
    return out.reshape(len(sizes), parts, width)


@dataclass
class Coder:
    """What tasks need: the shape, and the codebooks (parts, entries, width) with the ones before."""

    parts: int
    width: int
    scale: int
    books: np.ndarray
    before: np.ndarray | None = None

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[Bounds]]:
        """Parts and bounds of a batch of the state; the first round's rows have none yet."""
        n, k = batch.num_rows, self.books.shape[1]
        if self.before is None:
            x = integers(batch.column("vector"), self.parts, self.width, self.scale)
            return x, [Bounds(np.zeros(n, np.int64), np.full(n, 2**31), np.zeros((n, k), np.int64)) for _ in range(self.parts)]

        def numbers(name: str, kind: str, *shape: int) -> np.ndarray:
            return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(n, self.parts, *shape).astype(np.int64)

        x, code, upper, lower = numbers("x", "<i4", self.width), numbers("code", "u1"), numbers("upper", "<u4"), numbers("lower", "<u4", k)
        return x, [Bounds(code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()) for p in range(self.parts)]

    def assigned(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[Bounds]]:
        x, bounds = self.read(batch)
        for p, b in enumerate(bounds):
            if self.before is not None:
                b.shift(ceil_root(squared(self.books[p], self.before[p])))
            b.assign(x[:, p], self.books[p])
        return x, bounds

    def state(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The next state: vec_id, label, x, code, upper, lower."""
        for batch in batches:
            x, bounds = self.assigned(batch)

            def packed(a: np.ndarray, kind: str) -> pa.Array:
                return pa.array([row.tobytes() for row in a.astype(kind)], pa.binary())

            code, upper, lower = (np.stack([getattr(b, f) for b in bounds], 1) for f in ("code", "upper", "lower"))
            columns = [batch.column("vec_id"), batch.column("label"), packed(x, "<i4"), packed(code, "u1"), packed(upper, "<u4"), packed(lower, "<u4")]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "code", "upper", "lower"])

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counts (position ``width``) and component sums of each part's entries, as (slot, total)."""
        k = self.books.shape[1]
        total = np.zeros((self.parts, k, self.width + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i4").reshape(n, self.parts, self.width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), "u1").reshape(n, self.parts)
            for p in range(self.parts):
                np.add.at(total[p, :, :-1], code[:, p], x[:, p])
                total[p, :, -1] += np.bincount(code[:, p], minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["slot", "total"])

    def codes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, label, code in hex, and the exact error."""
        for batch in batches:
            x, bounds = self.assigned(batch)
            code = np.stack([b.code for b in bounds], 1)
            error = sum(squared(x[:, p], self.books[p][code[:, p]]) for p in range(self.parts))
            text = pa.array([row.tobytes().hex() for row in code.astype("u1")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])


def encode(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every kept row of (vec_id, embedding, label), and the codebooks.

    Codebooks start as the parts of the first ``entries`` vectors (at most 256) by vec_id.
    """
    spark = vectors.sparkSession
    vector = F.col("embedding").cast("array<double>")
    kept = vectors.select("vec_id", "label", vector.alias("vector")).where(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(min(entries, 256)).select("vector").collect()
    width = max(1, -(-longest // parts))
    books = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), parts, width, scale).transpose(1, 0, 2)
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    ids = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    coder, state, path = Coder(parts, width, scale, books), kept, None
    for _ in range(rounds if len(first) else 0):
        after, written = store(state.mapInArrow(coder.state, f"{ids}, x binary, code binary, upper binary, lower binary"), "code-round")
        if path:
            discard(spark, path)
        state, path = after, written
        total = np.zeros(books.shape[0] * books.shape[1] * (width + 1), object)
        for slot, n in state.select("x", "code").mapInArrow(coder.sums, "slot long, total long").groupBy("slot").agg(F.sum("total")).collect():
            total[slot] = n
        total = total.reshape(*books.shape[:2], width + 1)
        n = total[..., -1:]
        new = np.where(n > 0, total[..., :-1] // np.where(n > 0, n, 1), books.astype(object)).astype(np.int64)
        coder, books = Coder(parts, width, scale, new, books), new
    coded, _ = store(state.mapInArrow(coder.codes, f"{ids}, code string, error long"), "codes")
    if path:
        discard(spark, path)
    return coded, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of errors over equal labels, nulls together."""
    by = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
