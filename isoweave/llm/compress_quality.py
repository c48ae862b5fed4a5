"""Quality by compression: two zstandard dictionaries, one built from good and one from bad labelled text.

A text that compresses better with the good dictionary is more like good text. Texts are compressed in blocks, so that
a long text's own beginning doesn't stand in for the dictionary, once as they are and once as shapes (letters, capitals
and digits made alike), each with both dictionaries. The differences of the sizes, divided by the text's length, go
through a logistic curve that is fitted to labelled documents the dictionaries have not seen and weighted to the
labels' own shares, which makes the score a probability.

Scoring is one pass without a shuffle; the model has a fixed size. Training reads at most ``max_docs`` labelled
documents, least hash first, and fewer where they have more than ``max_chars`` characters in all; their texts are whole.

Edge cases: null and empty texts have no difference and get the curve's value at zero; null ids are carried; repeated
rows are scored once each; an empty table gives no rows; with labels of one kind only the score is that kind, with none
it is a half; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS
from .crf import sampled_texts, training_rows

BLOCK, DICT_BYTES = 1024, 32768
SHAPES = bytes(97 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 98 if c >= 128 else c for c in range(256))


def views(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw, raw.translate(SHAPES)]


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary from whole samples, or the samples themselves where there are too few to train on."""
    import zstandard

    parts = [b for s in samples for b in blocks(s)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICT_BYTES:]


@dataclass
class Model:
    """Dictionaries (good, bad) for each view, and the curve's weights with the offset last."""

    dictionaries: list[tuple[bytes, bytes]]
    curve: np.ndarray

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "curve": self.curve}

    def features(self, text: str | None) -> list[float]:
        """For each view: what the bad dictionary costs more than the good one, for each byte."""
        if not hasattr(self, "_zs"):
            import zstandard

            def z(d: bytes) -> zstandard.ZstdCompressor:
                return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)

            self._zs = [(z(g), z(b)) for g, b in self.dictionaries]
        out = []
        for (good, bad), data in zip(self._zs, views(text), strict=True):
            more = sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks(data))
            out.append(20.0 * more / (len(data) + 16))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[:-1] + self.curve[-1], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.01, steps: int = 50) -> np.ndarray:
    """Weights and offset by damped Newton steps."""
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta))
        beta += np.clip(np.linalg.solve(hess, design.T @ (w * (y - p)) - ridge * beta), -2, 2)
    return beta


def train(texts: list[str | None], good: list[int], share_good: float | None = None) -> Model:
    """Dictionaries from two of three documents, the curve from the rest; ``share_good`` is the labels' true share."""
    y = np.array(good, int)
    if len(set(good)) < 2:
        return Model([(b"\0" * 8, b"\0" * 8)] * 2, np.array([0.0, 0.0, 0.0 if not len(y) else 20.0 if y[0] else -20.0]))
    fit = [k for k in range(len(y)) if k % 3]
    held = [k for k in range(len(y)) if not k % 3]
    sets = [[build_dictionary([views(texts[k])[v] for k in fit if y[k] == label]) for label in (1, 0)] for v in (0, 1)]
    model = Model([(g, b) for g, b in sets], np.zeros(3))
    x = np.array([model.features(texts[k]) for k in held])
    label = y[held]
    share = float(y.mean()) if share_good is None else share_good
    weight = np.where(label == 1, share / max(1, label.sum()), (1 - share) / max(1, (1 - label).sum())) * len(label)
    model.curve = fit_logistic(x, label.astype(float), weight)
    return model


def train_on(docs: DataFrame, labels: DataFrame, *, max_docs: int = 4000, max_chars: int = 20_000_000) -> Model:
    """Train on a bounded sample of the labelled documents outside the held-out fold.

    At most ``max_docs`` documents reach the driver, and fewer where they have more than ``max_chars`` characters in all.
    """
    texts, good = sampled_texts(training_rows(docs, labels, "quality", max_docs=max_docs), max_chars)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    share = known.agg(F.avg("quality")).first()[0]
    return train(texts, good, share)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                x = np.array([m.features(t.as_py()) for t in part.column(1)]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(x))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
