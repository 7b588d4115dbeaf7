"""Toxicity by a subsequence string kernel and a support vector machine over Nystroem landmarks.

Instances are words (or runs of spelled-out single letters, joined): letters only, so characters inserted between the
letters of a word drop out if they aren't letters, and the kernel bridges those that are. The kernel counts common
subsequences of three letters, weighted by `decay` to the power of their span, up to `reach` letters wide, and is
divided by the square roots of what strings of those lengths without repeated letters would have with themselves.

Training is multi-instance: each labelled text is a bag; of a toxic bag the word that scores highest is its witness,
words of the others are negative. Witnesses, hard negatives and the machine are refitted in turn. Kernel values against
the landmarks, whitened by the landmarks' own kernel matrix, are the machine's inputs. As the kernel is a product of
explicit subsequence weights, landmarks and machine fold into one table of weights by letter triple, which scores a
word without loss at a cost that doesn't depend on the number of landmarks. A text's score is its highest word's,
mapped to 0..1 by a logistic fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import filtered, fold, give_back, held_out, slices, texts_of

SYMBOLS = 48  # 0: no letter; 1 to 26: a to z; others by code point
#: Digits written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
NOTHING = -30.0  # the margin of a text without a word
ROWS = 128  # words whose subsequence weights are laid out at a time


@cache
def symbols() -> np.ndarray:
    """Code point (under 65536) to symbol."""
    table = np.zeros(65536, np.uint8)
    for c in range(65536):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    for digit, letter in LOOKALIKES.items():
        table[ord(digit)] = ord(letter) - 96
    return table


def symbols_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = symbols()
    return np.where(codes < 65536, table[np.minimum(codes, 65535)], np.uint8(27)), codes


@dataclass(frozen=True)
class Kernel:
    decay: float = 0.6
    reach: int = 7

    def gaps(self) -> list[tuple[int, int, float]]:
        return [(a, b, self.decay ** (a + b + 1)) for a in range(1, self.reach) for b in range(1, self.reach - a)]

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        """Square root of the self-kernel of strings of these lengths whose letters all differ."""
        own = np.zeros(len(lengths))
        for a, b, w in self.gaps():
            own += w * w * np.maximum(0, lengths - a - b)
        return np.sqrt(np.maximum(own, 1e-12))


class Words:
    """Distinct words of some texts as one array of symbols, and each text's words as indices."""

    def __init__(self, texts: pa.Array):
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        flat = pc.list_flatten(lists)
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(flat)
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        words = coded.dictionary
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        sym, codes = symbols_of("".join(words.to_pylist()))
        owner = np.repeat(np.arange(len(words)), lengths)
        letter = sym > 0
        self.sym, self.owner = sym[letter], owner[letter]
        self.n = np.bincount(self.owner, minlength=len(words)).astype(np.int64)
        self.index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = np.repeat(np.arange(len(counts)), counts)
        self._join_single(codes[letter])
        self.names = words

    def _join_single(self, codes: np.ndarray) -> None:
        """Runs of three or more words of one letter each become one more word; the single ones stay as they are."""
        single = self.n[self.index] == 1
        same = np.concatenate(([False], single[1:] & single[:-1] & (self.text[1:] == self.text[:-1]))) if len(single) else single
        run = np.cumsum(~same)
        counts = np.bincount(run[single]) if single.any() else np.zeros(0, np.int64)
        long = np.flatnonzero(counts >= 3)
        self.spelled = len(self.n)
        if not len(long):
            return
        members = np.flatnonzero(single & np.isin(run, long))
        first = np.searchsorted(self.owner, self.index[members])
        _, where, size = np.unique(run[members], return_index=True, return_counts=True)
        self.sym = np.concatenate((self.sym, self.sym[first]))
        self.owner = np.concatenate((self.owner, len(self.n) + np.repeat(np.arange(len(size)), size)))
        self.index = np.concatenate((self.index, len(self.n) + np.arange(len(size))))
        self.text = np.concatenate((self.text, self.text[members[where]]))
        self.n = np.concatenate((self.n, size))

    def name(self, i: int) -> bytes:
        a, b = np.searchsorted(self.owner, [i, i + 1])
        return self.sym[a:b].tobytes()


def word_scores(sym: np.ndarray, owner: np.ndarray, n: np.ndarray, table: np.ndarray, kernel: Kernel) -> np.ndarray:
    """For every word the sum over its letter triples of weight times decay by span, over its norm."""
    total = np.zeros(len(sym))
    wide = sym.astype(np.int64)
    for a, b, w in kernel.gaps():
        m = len(sym) - a - b
        if m > 0:
            value = table[(wide[:m] * SYMBOLS + wide[a : a + m]) * SYMBOLS + wide[a + b :]]
            value[owner[:m] != owner[a + b :]] = 0
            total[:m] += w * value
    return np.bincount(owner, total, minlength=len(n)) / kernel.norms(n)


def explicit(words: list[bytes], kernel: Kernel, columns: np.ndarray, width: int) -> np.ndarray:
    """Normalised subsequence weights, a row for each word; columns: of each letter triple, `width` for none."""
    n = np.array([len(x) for x in words], np.int64)
    sym, owner = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.repeat(np.arange(len(words)), n)
    out = np.zeros(len(words) * (width + 1))
    for a, b, w in kernel.gaps():
        m = len(sym) - a - b
        if m > 0:
            inside = owner[:m] == owner[a + b :]
            triple = (sym[:m] * SYMBOLS + sym[a : a + m]) * SYMBOLS + sym[a + b :]
            out += w * np.bincount((owner[:m] * (width + 1) + columns[triple])[inside], minlength=len(out))
    return out.reshape(len(words), width + 1)[:, :width] / kernel.norms(n)[:, None]


def triples_of(words: list[bytes], kernel: Kernel) -> np.ndarray:
    """The letter triples that occur in the words, sorted."""
    found = [np.zeros(0, np.int64)]
    for x in words:
        s = np.frombuffer(x, np.uint8).astype(np.int64)
        found += [(s[: len(s) - a - b] * SYMBOLS + s[a : len(s) - b]) * SYMBOLS + s[a + b :] for a, b, _ in kernel.gaps() if len(s) > a + b]
    return np.unique(np.concatenate(found))


def with_insertions(x: bytes, copies: int = 2) -> list[bytes]:
    """The word with a letter inserted between two of its own: places and letters follow from the word."""
    h, out = hash_name(x), []
    for i in range(copies):
        at, letter = 1 + (h >> (8 * i)) % max(1, len(x) - 1), 1 + (h >> (8 * i + 24)) % 26
        out.append(x[:at] + bytes([letter]) + x[at:])
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Primal squared-hinge linear machine by Newton steps; y is 1 or -1."""
    a = np.hstack([x, np.ones((len(x), 1))])
    u, ridge = np.zeros(a.shape[1]), np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(30):
        live = y * (a @ u) < 1
        aw = a[live] * (c * weight[live])[:, None]
        new = np.linalg.solve(ridge + aw.T @ a[live], aw.T @ y[live])
        done, u = np.abs(new - u).max() < 1e-6, new
        if done:
            break
    return u[:-1], float(u[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by damped Newton steps."""
    a, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


@dataclass(frozen=True)
class Model:
    table: np.ndarray
    constant: float
    slope: float
    offset: float
    kernel: Kernel
    prior: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        w = Words(texts)
        best = np.full(len(texts), NOTHING)
        if len(w.n):
            score = word_scores(w.sym, w.owner, w.n, self.table, self.kernel) + self.constant
            score[w.n == 0] = NOTHING
            np.maximum.at(best, w.text, score[w.index])
        return best

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -30, 30)))


def train(texts: list[str], toxic: np.ndarray, kernel: Kernel = Kernel(), landmarks: int = 160, rounds: int = 4, negatives: int = 6_000) -> Model:
    """Fits the machine on labelled texts (1 toxic, 0 not), in memory: the sample is bounded by the caller.

    With one class only, or none, every score is that class's prior (0.5 / 1 smoothed) below or above one half.
    """
    prior = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.0
    flat = Model(np.zeros(SYMBOLS**3), 0.0, 0.0, float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -30.0, kernel, prior)
    if not 0 < toxic.sum() < len(toxic):
        return flat
    w = Words(pa.array(texts, pa.string()))
    bag, word = np.unique(np.stack([w.text, w.index]), axis=1)
    long = w.n[word] >= 3
    bag, word = bag[long], word[long]
    seen = toxic[bag] == 1
    df1, df0 = np.bincount(word[seen], minlength=len(w.n)), np.bincount(word[~seen], minlength=len(w.n))
    odds = np.log((df1 + 0.02) / (df0 + 0.02)) + np.log(max(1, (toxic == 0).sum()) / toxic.sum())
    score = np.where(df0 == 0, odds, np.minimum(odds, 0))
    clean = np.flatnonzero((df0 > 0) & (4 * df0 * toxic.sum() >= df1 * (toxic == 0).sum()))  # not told apart by a few mislabelled texts
    rank = np.argsort([hash_name(w.name(i)) for i in clean], kind="stable")
    clean = clean[rank]
    common = clean[np.argsort(-df0[clean], kind="stable")][: negatives // 3]
    pool = np.unique(np.concatenate((common, clean[:negatives])))
    starts = np.flatnonzero(np.concatenate(([True], bag[1:] != bag[:-1]))) if len(bag) else np.zeros(0, int)
    for turn in range(rounds):
        best = [s + int(np.argmax(score[word[s:e]])) for s, e in zip(starts, [*starts[1:], len(bag)], strict=True)]
        best = np.array([i for i in best if toxic[bag[i]] == 1], int)
        witness = Counter(word[best].tolist())
        hard = clean[np.argsort(-score[clean], kind="stable")][: 2000 * (turn > 0)]
        pool = np.unique(np.concatenate((pool, hard)))
        ranked = [i for i, _ in sorted(witness.items(), key=lambda x: (-x[1], x[0]))]
        marks = ranked[: landmarks // 2] + [int(i) for i in (hard if turn else common)[: landmarks // 4]] + [int(i) for i in clean[: landmarks // 4]]
        names = [w.name(i) for i in marks]
        triples = triples_of(names, kernel)
        columns = np.full(SYMBOLS**3, len(triples))
        columns[triples] = np.arange(len(triples))
        phi = explicit(names, kernel, columns, len(triples))
        values, vectors = np.linalg.eigh(phi @ phi.T)
        good = values > 1e-6 * values.max()
        basis = (vectors[:, good] / np.sqrt(values[good])).T @ phi
        plus = [(w.name(i), float(witness[i])) for i in ranked]
        plus += [(x, 0.25 * n) for name, n in plus for x in with_insertions(name)]
        rows = [x for x, _ in plus] + [w.name(i) for i in pool]
        y = np.concatenate((np.ones(len(plus)), -np.ones(len(pool))))
        weight = np.concatenate((np.array([n for _, n in plus]), np.ones(len(pool))))
        weight[y > 0] *= 0.5 * len(pool) / weight[y > 0].sum()
        x = np.vstack([explicit(rows[at : at + ROWS], kernel, columns, len(triples)) @ basis.T for at in range(0, len(rows), ROWS)])
        u, constant = fit_svm(x, y, weight)
        table = np.zeros(SYMBOLS**3)
        table[triples] = u @ basis
        score = word_scores(w.sym, w.owner, w.n, table, kernel) + constant
        score[w.n == 0] = NOTHING
    model = Model(table, constant, 1.0, 0.0, kernel, prior)
    margin = model.margins(pa.array(texts, pa.string()))
    fitted = fit_logistic(np.clip(margin, -5, 5)[:, None], toxic.astype(float))
    return Model(table, constant, max(float(fitted[0]), 1e-3), float(fitted[1]), kernel, prior)


def hash_name(x: bytes) -> int:
    h = 1469598103934665603
    for c in x:
        h = (h ^ c) * 1099511628211 % (1 << 64)
    return h


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int = 48 << 20, text_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, text, y) of at most `per_class` texts and `class_bytes` bytes of each class outside the held-out fold.

    The texts with the least hashes of id and text are picked, a text that many rows of an id repeat once, and none of more
    than `text_bytes` bytes. Null ids, labels other than 0 and 1 and null texts are left out; a doc_id labelled more than
    once counts as 1 if any of its labels is. All rows are looked at; the bounds are on what leaves Spark, which is decided
    on ids, hashes and sizes.
    """
    y = labels.where(f"{label} IN (0, 1) AND doc_id IS NOT NULL").where(fold() != 0).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    narrow = rows.select("doc_id", "hash", F.octet_length("text").alias("n")).where(F.col("n") <= text_bytes).distinct().join(y.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    order = ["rank", "doc_id", "hash"]
    picked = []
    for k in (0, 1):
        total = 0
        for r in narrow.where(F.col("y") == k).withColumn("rank", F.xxhash64("doc_id", "hash")).orderBy(*order).limit(per_class).collect():
            total += r["n"]
            if total > class_bytes:
                break
            picked.append((r["doc_id"], r["hash"], k))
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, hash long, y int")
    return rows.join(F.broadcast(chosen), ["doc_id", "hash"]).groupBy("doc_id", "hash", "y").agg(F.first("text").alias("text")).select("doc_id", "text", "y")  # 2 per_class rows at most


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, kernel: Kernel = Kernel()) -> Model:
    """The model from at most `per_class` labelled texts of each class (whole texts, within labelled_sample()'s bytes)."""
    rows = sorted((r["doc_id"], r["text"], r["y"]) for r in labelled_sample(docs, labels, "toxic", per_class).collect())
    model = train([r[1] for r in rows], np.array([r[2] for r in rows], int), kernel)
    give_back()
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, texts scored whole.

    Null and empty texts, and texts without a letter, get the score of a text without a word, near 0. Without two
    classes among the labels, all rows get the prior. Words that tie for a text's highest give the same score. Repeated
    rows are scored each, alike; other columns of docs, whatever their names, are left out. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.value.scores(texts_of(batch, "text")))], ["doc_id", "held_out", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the threshold.

    Null and empty texts stay, unless the labels know toxic texts only. Rows with repeated or null ids are judged each, by
    text alone; all columns pass through, whatever their names; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))
    return filtered(docs, lambda: lambda texts: model.value.scores(texts) < threshold)
