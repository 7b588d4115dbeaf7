"""Text quality by compression: zstandard dictionaries built from good and from bad labelled text.

A text is compressed in chunks with either dictionary; every chunk starts from the dictionary alone, so the sizes say
what the text resembles however long it is, and not what it has in common with itself. The signal is the difference of
the two sizes, normalised by the text's length in bytes: bytes saved by the good dictionary for each byte of text. A
text that repeats itself is small with both, saves nothing with the good one, and so stands apart from good text too. One
monotone logistic fit of that difference alone calibrates the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import held_out, slices, texts_of
from tomolake.llm.toxicity import fit_logistic, labelled_sample

LEVEL = 3
CHUNK = 256
LEAST_SAMPLES = 16


def chunks(text: bytes) -> list[bytes]:
    """The whole text in runs of CHUNK bytes; an empty text is one empty chunk."""
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)] or [b""]


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary trained on the texts' chunks, or with few of them the end of the texts themselves."""
    pieces = [c for x in texts for c in chunks(x)]
    if len(pieces) >= LEAST_SAMPLES:
        try:
            return zstandard.train_dictionary(size, pieces).as_bytes()
        except zstandard.ZstdError:
            pass  # too little text to train on
    return b"\n".join(texts)[-size:] or b" " * 8


class Sizes:
    """Compressed sizes of texts with the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.makers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_checksum=False, write_dict_id=False) for x in (good, bad)]

    def saved(self, texts: list[bytes]) -> np.ndarray:
        """Bytes that the good dictionary saves against the bad one; 0 for an empty text."""
        out = np.zeros(len(texts))
        for i, x in enumerate(texts):
            good, bad = (sum(len(m.compress(c)) for c in chunks(x)) for m in self.makers)
            out[i] = bad - good
        return out


def normalised(saved: np.ndarray, length: np.ndarray, usual: float, lead: float) -> np.ndarray:
    """The difference for each byte of text, as if `lead` bytes of usual text went before: short texts hold little evidence."""
    return (saved + lead * usual) / np.maximum(length + lead, 1e-9)


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0  # not negative: the score never falls where the difference rises
    offset: float = 0.0
    usual: float = 0.0
    lead: float = 1.0

    def scores(self, texts: list[bytes], sizes: Sizes) -> np.ndarray:
        length = np.array([len(x) for x in texts], float)
        return 1 / (1 + np.exp(-np.clip(self.slope * normalised(sizes.saved(texts), length, self.usual, self.lead) + self.offset, -30, 30)))


def train(texts: list[bytes], y: np.ndarray, size: int = 1 << 16) -> Model:
    """Half of each class builds its dictionary, the other half calibrates. One class only: its smoothed share.

    The calibration is one logistic regression on the normalised difference; what a usual text saves and for how many
    bytes it counts are those, of a few, under which the calibrating half is likeliest.
    """
    half = np.zeros(len(texts), bool)
    for k in (0, 1):
        half[np.flatnonzero(y == k)[::2]] = True
    good, bad = (dictionary([x for x, k, h in zip(texts, y, half, strict=True) if k == c and h], size) for c in (1, 0))
    share = (y.sum() + 0.5) / (len(y) + 1)
    flat = Model(good, bad, offset=float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return flat
    rest = ~half if 0 < y[~half].sum() < (~half).sum() else half | True
    kept, want = [x for x, r in zip(texts, rest, strict=True) if r], y[rest].astype(float)
    saved, length = Sizes(good, bad).saved(kept), np.array([len(x) for x in kept], float)
    best, likelihood = flat, -np.inf
    for usual in np.quantile(saved / np.maximum(length, 1), (0.25, 0.5, 0.75, 0.9)):
        for lead in (8.0, 32.0, 128.0):
            apart = normalised(saved, length, float(usual), lead)
            scale = 1 / max(float(apart.std()), 1e-9)  # so that the ridge doesn't depend on the unit
            slope, offset = fit_logistic(scale * apart[:, None], want, ridge=1e-2)
            margin = scale * slope * apart + offset
            found = float((want * margin - np.logaddexp(0, margin)).sum())
            if slope > 0 and found > likelihood:
                best, likelihood = Model(good, bad, float(slope * scale), float(offset), float(usual), lead), found
    return best


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, size: int = 1 << 16) -> Model:
    """The model from about `per_class` labelled texts of each class (whole texts)."""
    rows = sorted((r["doc_id"], r["text"], r["y"]) for r in labelled_sample(docs, labels, "quality", per_class).collect())
    return train([r[1].encode() for r in rows], np.array([r[2] for r in rows], int), size)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, texts compressed whole.

    A null text scores as an empty one, which has the difference of a usual text. Without labels all rows score 0.5; with one class, its
    smoothed share. A score equal to the threshold is predicted 1. Repeated rows are scored each, alike; other columns of
    docs, whatever their names, are left out. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.value.good, model.value.bad)
        for batch in slices(batches, "text"):
            texts = [x.as_buffer().to_pybytes() for x in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.value.scores(texts, sizes))], ["doc_id", "held_out", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
