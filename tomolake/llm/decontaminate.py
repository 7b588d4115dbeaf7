"""Benchmark decontamination by winnowing.

A window is `span` consecutive words of a benchmark item; an item of fewer words (but not none) is one window. From
every run of `span - k + 1` consecutive k-grams, winnowing keeps the least hash as a fingerprint, so that two texts
sharing `span` words in a row also share a fingerprint. Training and benchmark fingerprints are joined, and each hit
is extended to the windows around it, which are compared word by word: hash collisions report nothing. Items of fewer
than `span` words have one fingerprint, that of the whole item, compared with the documents' n-grams of its length.

The benchmark goes to every task, as arrays built once, only if its text was measured and is of at most eight bytes for
each of `broadcast_words`; beyond that, fingerprints are joined by a shuffle, and the windows around hits are joined to the
benchmark's distinct windows by their words. Neither texts nor items are copied for each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomolake.llm.common import numbered, slices, texts_of, written

SPAN = 10
K = 7
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are part of words stay, A-Z in lower case; others become spaces.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n word hashes (mixed, as the least of several is taken)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= BASE
        out += h[i : len(h) - n + 1 + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def winnow(h: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints: every k-gram that is the least of some run of span - k + 1 of them."""
    grams, run = gram_hashes(h, k), span - k + 1
    if len(grams) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(grams, run)
    at = np.unique(np.arange(len(least)) + least.argmin(axis=1))
    return at, grams[at]


def row_hashes(h: np.ndarray) -> np.ndarray:
    """gram_hashes of each row of word hashes, the row as one gram."""
    return gram_hashes(h.ravel(), h.shape[1])[:: h.shape[1]] if len(h) else np.zeros(0, np.uint64)


class Windows:
    """The benchmark's windows, as arrays for lookups from documents: some 100 bytes for each word of the benchmark."""

    def __init__(self, items: list[tuple[int | None, bytes]], span: int = SPAN, k: int = K):
        self.span, self.k, self.ids = span, k, {}
        prints, rows, owners = [np.zeros(0, np.uint64)], {}, {}
        for item, text in items:
            ids = np.array([self.ids.setdefault(w, len(self.ids)) for w in words_of(text)], np.int32)
            n = min(span, len(ids))
            if n:
                windows = np.lib.stride_tricks.sliding_window_view(ids, n)
                rows.setdefault(n, []).append(windows)
                owners.setdefault(n, []).append((item, len(windows)))
            if len(ids) >= span:
                prints.append(winnow(self.hashes(ids), span, k)[1])
        self.fingerprints = np.unique(np.concatenate(prints))
        self.items = np.array(sorted({i for i, _ in items if i is not None}), np.int64)
        self.by_length = {}
        for n in sorted(rows):
            words, place = np.unique(np.concatenate(rows[n]), axis=0, return_inverse=True)
            h = row_hashes(self.hashes(words))
            order = np.argsort(h, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            whose = np.concatenate([np.full(m, -1 if i is None else np.searchsorted(self.items, i)) for i, m in owners[n]])
            pairs = np.unique(np.stack([rank[place.ravel()], whose], axis=1)[whose >= 0], axis=0).astype(np.int32)
            first = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
            self.by_length[n] = h[order], words[order], first, pairs[:, 1].copy()

    @staticmethod
    def hashes(ids: np.ndarray) -> np.ndarray:
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(31))

    def starts(self, ids: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """Where windows of n words can begin: around shared fingerprints, or at any word for short items."""
        if n < self.span:
            return np.arange(max(0, len(ids) - n + 1))
        at, grams = winnow(h, self.span, self.k)
        if not len(at) or not len(self.fingerprints):
            return np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.fingerprints, grams), len(self.fingerprints) - 1)
        hit = at[self.fingerprints[place] == grams]
        around = np.unique((hit[:, None] - np.arange(self.span - self.k + 1)).ravel())
        return around[(around >= 0) & (around + self.span <= len(ids))]

    def search(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Flags of the words inside windows; the items whose windows occur."""
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        hit, items = np.zeros(len(words) + 1, np.int64), set()
        known = ids >= 0
        for n, (sorted_h, win, first, owners) in self.by_length.items():
            if len(ids) < n:
                continue
            ahead = np.concatenate(([0], np.cumsum(known)))
            full = ahead[n:] - ahead[:-n] == n  # runs of n benchmark words
            if not full.any():
                continue
            h = self.hashes(ids)
            at = self.starts(ids, h, n)
            at = at[full[at]]
            if not len(at):
                continue
            grams = gram_hashes(h, n)[at]
            left, right = np.searchsorted(sorted_h, grams, "left"), np.searchsorted(sorted_h, grams, "right")
            for step in range(int((right - left).max(initial=0))):  # one, unless hashes of windows collide
                live = left + step < right
                place, here = (left + step)[live], at[live]
                same = (win[place] == ids[here[:, None] + np.arange(n)]).all(axis=1)
                np.add.at(hit, here[same], 1)
                np.add.at(hit, here[same] + n, -1)
                for i in np.unique(place[same]):
                    items.update(self.items[owners[first[i] : first[i + 1]]].tolist())
        return np.cumsum(hit[:-1]) > 0, items


def _report(doc_ids: list, found: list[tuple[int, int, set[int]]]) -> pa.RecordBatch:
    digest = [sha256(",".join(sorted(map(str, items))).encode()).hexdigest() for _, _, items in found]
    columns = [pa.array(doc_ids, pa.int64()), *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)), pa.array([len(f[2]) for f in found], pa.int64()), pa.array(digest), pa.array([f[1] > 0 for f in found])]
    return pa.RecordBatch.from_arrays(columns, REPORT.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", "))


def _small(spark: SparkSession, docs: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    """The benchmark, its size checked, goes to every task as arrays."""
    shared = spark.sparkContext.broadcast(Windows([(r["item_id"], (r["text"] or "").encode()) for r in items.collect()], span, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in slices(batches, "text"):
            found = []
            for x in texts_of(batch, "text"):
                words = words_of(x.as_buffer().to_pybytes())
                hit, seen = windows.search(words)
                found.append((len(words), int(hit.sum()), seen))
            yield _report(batch.column("doc_id").to_pylist(), found)

    return docs.mapInArrow(run, REPORT)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _window_prints(h: np.ndarray, n: int, span: int, k: int) -> np.ndarray:
    """The fingerprint of the window of n words from each place on: of whole windows the least k-gram, of short ones the gram."""
    grams, run = gram_hashes(h, min(n, k) if n >= span else n), span - k + 1 if n >= span else 1
    return (np.lib.stride_tricks.sliding_window_view(grams, run).min(axis=1) if len(grams) >= run else np.zeros(0, np.uint64)).view(np.int64)


def _windows_at(words: list[bytes], starts: np.ndarray, n: int) -> list[str]:
    return [b" ".join(words[i : i + n]).decode() for i in starts.tolist()]


def _large(docs: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    """Fingerprints of both sides are joined by a shuffle, then windows with shared fingerprints by their words.

    A window that many documents or items hold is one row of the distinct windows: adaptive execution splits its join.
    """
    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for item, x in zip(batch.column("item_id").to_pylist(), texts_of(batch, "text"), strict=True):
                words = words_of(x.as_buffer().to_pybytes())
                n = min(span, len(words))
                if n:
                    prints = _window_prints(_word_hashes(words), n, span, k)
                    rows += [(item, n, p, w) for p, w in zip(prints.tolist(), _windows_at(words, np.arange(len(prints)), n), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))], ["item_id", "n", "print", "win"])

    windows = written(items.mapInArrow(of_items, "item_id long, n int, print long, win string").distinct(), "windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most `span`
    keyed = written(docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text"), "keyed")

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, prints = [], []
            for x in texts_of(batch, "text"):
                h = _word_hashes(words_of(x.as_buffer().to_pybytes()))
                counts.append(len(h))
                prints.append(np.unique(np.concatenate([np.zeros(0, np.int64), *(_window_prints(h, n, span, k) for n in lengths)])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], ["id", "doc_id", "n_words", "prints"])

    printed = written(keyed.mapInArrow(of_docs, "id long, doc_id long, n_words long, prints array<long>"), "printed")
    shared = printed.select("id", F.explode("prints").alias("print")).join(windows.select("print").distinct(), "print", "left_semi")
    live = keyed.join(shared.groupBy("id").agg(F.collect_list("print").alias("prints")), "id").select("id", "text", "prints")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for key, x, hits in zip(batch.column("id").to_pylist(), texts_of(batch, "text"), batch.column("prints"), strict=True):
                words = words_of(x.as_buffer().to_pybytes())
                h = _word_hashes(words)
                for n in lengths:
                    starts = np.flatnonzero(np.isin(_window_prints(h, n, span, k), hits.values.to_numpy()))
                    if len(starts):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), key)), pa.array(starts), pa.array(np.full(len(starts), n, np.int32)), pa.array(_windows_at(words, starts, n), pa.string())], ["id", "s", "n", "win"])

    found = live.mapInArrow(extend, "id long, s long, n int, win string").join(windows.select("n", "win").distinct(), ["n", "win"], "left_semi")
    found = written(found, "hits")
    before = Window.partitionBy("id").orderBy("s", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("s") + F.col("n")
    covered = found.withColumn("before", F.coalesce(F.max(end).over(before), F.lit(0))).groupBy("id").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("s", "before"))).alias("n_hit"))
    owned = found.select("id", "n", "win").distinct().join(windows.where("item_id IS NOT NULL").select("n", "win", "item_id").distinct(), ["n", "win"])
    named = owned.select("id", F.col("item_id").cast("string").alias("item")).distinct().groupBy("id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    out = printed.select("id", "doc_id", "n_words").join(covered, "id", "left").join(named, "id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, broadcast_words: int = 200_000) -> DataFrame:
    """docs without the rows that contamination() reports as contaminated.

    Rows with repeated or null ids are judged each; null and empty texts stay; all columns pass through.
    """
    rows, number = numbered(docs)
    found = contamination(rows.select(F.col(number).alias("doc_id"), "text"), benchmark, span, k, broadcast_words)
    hit = written(found.where("contaminated").select(F.col("doc_id").alias(number)), "contaminated")
    return rows.join(hit, number, "left_anti").select(docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, broadcast_words: int = 200_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits. Items that are null or empty have no windows; items without an
    id count for n_hit and contaminated, not for n_items and items_sha256 (the SQL leaves them out altogether); repeated
    items count once for each item_id. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _small(spark, docs, items, span, k) if size <= 8 * broadcast_words else _large(docs, items, span, k)


_WORDS = "[x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> '']"
ORACLE_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least({SPAN}, len(w)) AS n, array_to_string(w[s : s + least({SPAN}, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least({SPAN}, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
occ AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, s, occ.n, item_id FROM occ JOIN win ON occ.g = win.g AND occ.n = win.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
