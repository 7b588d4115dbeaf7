"""Language identification by a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, kernel ridge.

Two texts compare by how many distinct character n-grams (one to three symbols) they share, divided by the root of the
product of how many each has. Symbols are letters without case, folded to 63 classes, and one for all else, so a
text's n-grams are flags in tables of fixed size however long it is. Landmarks are training texts; values against
them, whitened by their own kernel matrix, are the inputs of one ridge regression for each language against the rest.
Both the kernel values and the regressions are products of matrices over a block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import filtered, fold, held_out, slices, texts_of, written

CLASSES = 64
ORDERS = (1, 2, 3)
SIZES = [CLASSES**n for n in ORDERS]
BLOCK = 64
LEAST_LANDMARKS = 16  # under these, a text unlike all of them may still be in their languages
UNKNOWN = "und"


@cache
def classes() -> np.ndarray:
    """Code point (under 65536) to class: 0 no letter, 1 to 26 a to z, the rest by code point."""
    table = np.zeros(65536, np.uint8)
    for c in range(65536):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low % (CLASSES - 27)
    return table


def grams_of(text: str) -> np.ndarray:
    """Flags of the n-grams present in the whole text, n = 1, 2, 3 one after another; all false without a letter.

    Runs of non-letters count as one symbol, and the text's ends as non-letters.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(codes < 65536, classes()[np.minimum(codes, 65535)], np.uint8(27))
    if (codes >= 65536).any():
        c[codes >= 65536] = [27 + int(x) % (CLASSES - 27) if chr(x).isalpha() else 0 for x in codes[codes >= 65536]]
    flags = np.zeros(sum(SIZES), bool)
    if not c.any():
        return flags
    c = np.concatenate(([0], c, [0])).astype(np.int32)
    c = c[np.concatenate(([True], (c[1:] > 0) | (c[:-1] > 0)))]
    flags[c] = True
    two = c[:-1] * CLASSES + c[1:]
    flags[SIZES[0] + two] = True
    flags[SIZES[0] + SIZES[1] + two[:-1] * CLASSES + c[2:]] = True
    return flags


@dataclass(frozen=True)
class Landmarks:
    grams: np.ndarray  # of any landmark
    packed: np.ndarray  # a row of bits for each landmark: which of them it has
    sizes: np.ndarray

    @cached_property
    def matrix(self) -> np.ndarray:
        """A column for each landmark, over its norm; unpacked once a process."""
        bits = np.unpackbits(self.packed, axis=1, count=len(self.grams)).astype(np.float32)
        return (bits / np.sqrt(np.maximum(self.sizes, 1))[:, None].astype(np.float32)).T

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values against the landmarks, block by block; whether each text has a letter."""
        k, size = self.measured(texts)
        return k, size > 0

    def measured(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values against the landmarks, block by block; how many n-grams each text has, none without a letter."""
        out, size = np.zeros((len(texts), len(self.sizes)), np.float32), np.zeros(len(texts))
        for at in range(0, len(texts), BLOCK):
            rows = np.zeros((len(texts[at : at + BLOCK]), len(self.grams)), np.float32)
            for i, x in enumerate(texts[at : at + BLOCK]):
                flags = grams_of(x)
                rows[i], size[at + i] = flags[self.grams], np.count_nonzero(flags)
            out[at : at + BLOCK] = rows @ self.matrix
        return out / np.sqrt(np.maximum(size, 1))[:, None], size


def landmarks_of(texts: list[str]) -> Landmarks:
    return landmarks_from([np.packbits(grams_of(x)).tobytes() for x in texts])


def landmarks_from(bits: list[bytes]) -> Landmarks:
    """Landmarks from the packed flags of their n-grams."""
    flags = [np.frombuffer(x, np.uint8) for x in bits]
    grams = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(flags), count=sum(SIZES))) if flags else np.zeros(0, np.int64)
    own = [np.unpackbits(f, count=sum(SIZES))[grams] for f in flags]
    packed = np.packbits(np.array(own, np.uint8), axis=1) if own else np.zeros((0, 0), np.uint8)
    return Landmarks(grams.astype(np.int32), packed, np.array([int(o.sum()) for o in own], np.int64))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray  # from kernel values to a margin for each language
    constants: np.ndarray
    sharpness: float = 8.0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, `und` and 0 where it has no letter or no language was learned; its greatest kernel value.

        The latter is against any landmark: -1 without a letter, 1 where no language was learned, or from too few landmarks to tell.
        """
        names, scores, nearest = [], np.zeros(len(texts)), np.full(len(texts), -1.0)
        for at in range(0, len(texts), BLOCK):
            block = texts[at : at + BLOCK]
            k, lettered = self.landmarks.kernel(block)
            nearest[at : at + len(block)] = np.where(lettered, k.max(axis=1) if self.languages and len(self.landmarks.sizes) >= LEAST_LANDMARKS else 1.0, -1.0)
            if not self.languages:
                names += [UNKNOWN] * len(block)
                continue
            margin = self.sharpness * (k @ self.weights + self.constants)
            p = np.exp(margin - margin.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            scores[at : at + len(block)] = np.where(lettered, p[np.arange(len(block)), best], 0.0)
            names += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return names, scores, nearest

    def foreign(self, texts: list[str], least: float = 0.15, margin: float = 0.2, near: float = 0.45, few: int = 200, few_margin: float = -0.1, few_least: float = 0.3) -> np.ndarray:
        """Whether each text is without a letter or in none of the learned languages.

        The latter is told by the margin of the best of the regressions (about 1 for a learned language): under `margin`, and with no
        kernel value of `near`, as texts that mix learned languages have; of texts of fewer than `few` n-grams, which tell less, under
        `few_margin` and with no kernel value of `few_least`. A text with no kernel value of `least` is like no learned text at
        all. Where no language was learned, or from too few landmarks to tell, only texts without a letter are foreign.
        """
        out = np.zeros(len(texts), bool)
        for at in range(0, len(texts), BLOCK):
            k, size = self.landmarks.measured(texts[at : at + BLOCK])
            out[at : at + BLOCK] = size == 0
            if self.languages and len(self.landmarks.sizes) >= LEAST_LANDMARKS:
                nearest, best = k.max(axis=1), (k @ self.weights + self.constants).max(axis=1)
                out[at : at + BLOCK] |= (nearest < least) | np.where(size < few, (best < few_margin) & (nearest < few_least), (best < margin) & (nearest < near))
        return out


def sample(docs: DataFrame, per_language: int, seed: int) -> DataFrame:
    """(doc_id, text, lang) of about `per_language` rows of each language outside the held-out fold, by a seeded hash of id and text.

    The text is hashed too, so that an id that many rows share doesn't bring them all in; copies of one row count once.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(fold() != 0)
    sizes = written(known.groupBy("lang").count(), "sizes")  # broadcast only where its files are small
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count")) * (1 << 20)
    return known.join(sizes, "lang").where(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 20)) < share).select("doc_id", "text", "lang").distinct()


def fit(docs: DataFrame, per_language: int = 400, landmarks: int = 64, ridge: float = 1e-2, most_languages: int = 1024, most_rows: int = 1 << 14) -> Model:
    """The model from about `per_language` texts of each language, `landmarks` of which are landmarks.

    Bounds hold over all languages together. The `most_languages` with the most rows are learned (of equals the first by
    name); of many languages each has fewer rows, so that all have about `most_rows` rows, and `most_languages` landmarks, one
    for each language at least. Landmarks leave Spark as bits of their n-grams (33 kB each), the other rows as kernel
    values, no text does.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(fold() != 0).groupBy("lang").count()
    names = [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").limit(most_languages).collect()]
    n = max(1, len(names))
    # Written once: the landmarks, their counts and the kernel values are all read from the bounded sample.
    picked = written(sample(rows.where(F.col("lang").isin(names)), min(per_language, max(1, most_rows // n)), 1), "language_sample")
    chosen = sample(picked, min(landmarks, max(1, most_languages // n)), 2)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array([np.packbits(grams_of(x)).tobytes() for x in texts_of(batch, "text").to_pylist()], pa.binary())], ["lang", "doc_id", "bits"])

    marks = landmarks_from([r["bits"] for r in sorted(chosen.mapInArrow(bits, "lang string, doc_id long, bits binary").collect())])
    shared = spark.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            k, lettered = shared.value.kernel(texts_of(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(list(k.astype(float)), pa.list_(pa.float64())), pa.array(lettered)], ["doc_id", "lang", "k", "lettered"])

    values = [r for r in picked.mapInArrow(run, "doc_id long, lang string, k array<double>, lettered boolean").collect() if r["lettered"]]
    shared.unpersist()
    values.sort(key=lambda r: (r["doc_id"], r["lang"], r["k"]))
    return ridge_model(np.array([r["k"] for r in values]), [r["lang"] for r in values], marks, ridge)


def ridge_model(x: np.ndarray, langs: list[str], marks: Landmarks, ridge: float) -> Model:
    """One ridge regression for each language against the rest, on kernel values x whitened by the landmarks' own kernel matrix."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], marks, np.zeros((0, 0)), np.zeros(0))
    own = marks.matrix.T.astype(float) @ marks.matrix.astype(float)
    spectrum, vectors = np.linalg.eigh(own)
    good = spectrum > 1e-6 * spectrum.max()
    whiten = vectors[:, good] / np.sqrt(spectrum[good])
    phi = x @ whiten
    y = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = (1 / (y > 0).sum(axis=0))[(y > 0).argmax(axis=1)]  # each language counts alike
    weight /= weight.sum()
    mean, level = weight @ phi, weight @ y
    a = (phi - mean) * weight[:, None]
    solved = np.linalg.solve(a.T @ (phi - mean) + ridge / len(languages) * np.eye(phi.shape[1]) * 1e-2, a.T @ (y - level))
    # Without what the driver has unpacked.
    return Model(languages, Landmarks(marks.grams, marks.packed, marks.sizes), whiten @ solved, level - mean @ solved)


def identify(docs: DataFrame, per_language: int = 400, landmarks: int = 64) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, texts read whole.

    Null and empty texts, and texts without a letter, are `und` with score 0; so is everything where no row has a
    language to learn. Of languages that tie, the first by name. Repeated rows are each predicted alike; other columns of
    docs, whatever their names, are left out. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language, landmarks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, scores, _ = model.value.predict(texts_of(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def reject_unidentified(docs: DataFrame, per_language: int = 400, landmarks: int = 64) -> DataFrame:
    """docs without the rows whose language is not identified: no letter, or in none of the learned languages (Model.foreign).

    Null and empty texts have no letter. Where no language can be learned, or only from under LEAST_LANDMARKS texts, every
    text with a letter stays. Rows with repeated or null ids are judged each, equal texts alike; other columns pass through;
    an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language, landmarks))
    return filtered(docs, lambda: lambda texts: ~model.value.foreign(texts.to_pylist()))
