"""Phrase collocations of each language, counted in counting quotient filters that merge across shards.

Words that occur often enough to be part of a reported phrase get dense ids. An n-gram of ids is packed into one integer,
a Feistel network permutes that integer without loss, and the result is cut into shard, quotient and full remainder. A
filter holds one shard's n-grams in that order: a bit vector of quotients in use, a bit vector of the last entry of each
quotient's run, remainders in as many bytes as they need, and counters of one byte (with eight for the few large ones).
Nothing is lost, so counts are exact and n-grams are read back from the filter by the inverse network. Tasks make filters
of bounded runs of n-grams; the filters of a shard are merged in sorted order. The permutation spreads n-grams evenly,
and an n-gram as frequent as all others together is one entry of each filter.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomolake.llm.common import give_back, numbered, slices, written

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bits of packed n-grams: five words of 25 bits.
BITS = 126
#: n-grams that a task gathers before it makes filters of them, and those of one shard on average.
RUN, SHARD = 1 << 22, 1 << 19
BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
_ROUNDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tokens(data: bytes) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased, with BREAK between pieces and b"" where spaces meet."""
    return data.translate(_TABLE).replace(b"\n", b" " + BREAK + b" ").split(b" ")


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _scrambled(x: np.ndarray, key: np.uint64, half: int) -> np.ndarray:
    x = x + key
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - half)


def permuted(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A one-to-one map of pairs of numbers below 2**half."""
    for key in _ROUNDS:
        left, right = right, left ^ _scrambled(right, key, half)
    return left, right


def restored(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of permuted()."""
    for key in reversed(_ROUNDS):
        left, right = right ^ _scrambled(left, key, half), left
    return left, right


def halves(n: int, width: int) -> int:
    """Bits of each half of a packed n-gram of ids below 2**width."""
    return (n * width + 1) // 2


def packed(ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each word of the n-grams, one array for each place, as two halves."""
    high, low, half, w = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64), halves(len(ids), width), np.uint64(width)
    for x in ids:
        high, low = high << w | low >> np.uint64(64 - width), low << w | x.astype(np.uint64)
    return (high << np.uint64(64 - half) | low >> np.uint64(half)) & _mask(half), low & _mask(half)


def unpacked(left: np.ndarray, right: np.ndarray, n: int, width: int) -> np.ndarray:
    """A row of ids for each n-gram: the inverse of packed()."""
    half, w, out = halves(n, width), np.uint64(width), []
    low, high = right | left << np.uint64(half), left >> np.uint64(64 - half)
    for _ in range(n):
        out.append(low & _mask(width))
        low, high = low >> w | high << np.uint64(64 - width), high >> w
    return np.stack(out[::-1], axis=1).astype(np.int64)


def summed(left: np.ndarray, right: np.ndarray, count: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(left << np.uint64(half) | right, kind="stable") if half <= 32 else np.lexsort((right, left))
    left, right, count = left[order], right[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))) if len(left) else np.zeros(0, np.int64)
    return left[first], right[first], np.add.reduceat(count, first) if len(first) else count[:0]


def filter_of(left: np.ndarray, right: np.ndarray, count: np.ndarray, half: int, shards: int) -> bytes:
    """A counting quotient filter of distinct, sorted keys of one shard (the top `shards` bits of left are all equal)."""
    n, rest = len(left), half - shards
    q = min(rest, max(0, n - 1).bit_length(), 30)
    tail = rest - q  # bits of left that belong to the remainder
    quotient = ((left & _mask(rest)) >> np.uint64(tail)).astype(np.int64)
    used = np.zeros(1 << q, bool)
    used[quotient] = True
    last = np.concatenate((quotient[1:] != quotient[:-1], [True]))[:n]
    left = left & _mask(tail)
    remainder = np.stack((left >> np.uint64(64 - half), right | left << np.uint64(half)), axis=1)
    size = (tail + half + 7) // 8
    stored = np.ascontiguousarray(remainder.astype(">u8").view(np.uint8).reshape(n, 16)[:, 16 - size :])
    return b"".join((struct.pack("<IB", n, q), np.packbits(used).tobytes(), np.packbits(last).tobytes(), stored.tobytes(), np.minimum(count, 255).astype(np.uint8).tobytes(), count[count >= 255].astype("<u8").tobytes()))


def entries(block: bytes, shard: int, half: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and counts of a filter, sorted: the inverse of filter_of()."""
    (n, q), at = struct.unpack_from("<IB", block), 5
    rest = half - shards
    tail, size = rest - q, (rest - q + half + 7) // 8

    def take(k: int) -> np.ndarray:
        nonlocal at
        at += k
        return np.frombuffer(block, np.uint8, k, at - k)

    used = np.flatnonzero(np.unpackbits(take(((1 << q) + 7) // 8))[: 1 << q])
    last = np.unpackbits(take((n + 7) // 8))[:n]
    quotient = used[np.cumsum(last) - last].astype(np.uint64)
    wide = np.zeros((n, 16), np.uint8)
    wide[:, 16 - size :] = take(n * size).reshape(n, size)
    high, low = wide.view(">u8").astype(np.uint64).T
    count = take(n).astype(np.int64)
    count[count == 255] = take(8 * int((count == 255).sum())).view("<u8").astype(np.int64)
    left = np.uint64(shard << rest) | quotient << np.uint64(tail) | ((high << np.uint64(64 - half) | low >> np.uint64(half)) & _mask(tail))
    return left, low & _mask(half), count


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n): all word occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in seen.items():
                found.pop(b"", None), found.pop(BREAK, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])
            seen.clear()

        for batch in slices(batches, "text"):
            for lang, x in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                seen.setdefault(lang, Counter()).update(tokens(x.as_buffer().to_pybytes()))
            if sum(map(len, seen.values())) > 200_000:
                yield from out()
        yield from out()
        give_back()

    return rows.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def with_ids(words: DataFrame, buckets: int = 1024) -> DataFrame:
    """words (lang, word) with dense ids from 0, numbered within buckets of their hash."""
    words = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)).cast("int"))
    sizes = dict(words.groupBy("bucket").count().collect())
    before = [0] * buckets
    for b in range(1, buckets):
        before[b] = before[b - 1] + sizes.get(b - 1, 0)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return words.withColumn("id", (F.element_at(F.lit(before), F.col("bucket") + 1) + rank - 1).cast("int")).drop("bucket")


def with_own_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows (lang, text) with the dictionary of each text: for dictionaries too large to go to every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [list(set(tokens(x.as_buffer().to_pybytes())) - {b"", BREAK}) for x in batch.column("text")]
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at)), batch.column("lang").take(pa.array(at)), pa.array(list(chain(*own)), pa.binary()).cast(pa.string())], ["row", "lang", "word"])

    rows, number = numbered(rows)
    rows = rows.withColumnRenamed(number, "row")
    known = rows.select("row", "lang", "text").mapInArrow(run, "row long, lang string, word string").join(words.select("lang", "word", "id"), ["lang", "word"])
    own = known.groupBy("row").agg(F.collect_list(F.struct("word", "id")).alias("own"))
    return rows.join(own, "row").select("lang", "text", F.col("own.word").alias("words"), F.col("own.id").alias("ids"))


def grams(rows: DataFrame, lengths: tuple[int, ...], width: int, shards: int, dictionary: dict[str, dict[bytes, int]] | None, pairs: np.ndarray | None) -> DataFrame:
    """(n, shard, block): filters of the n-grams of known words, in pieces of texts.

    rows: (lang, text), also (words, ids) where no dictionary of all words is given. pairs: sorted id pairs
    (first << width | second); if given, an n-gram counts only if all its neighbours are such pairs.
    """
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((dictionary, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, allowed = shared.value
        gathered: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in lengths}

        def out() -> Iterator[pa.RecordBatch]:
            for n, parts in gathered.items():
                if not parts:
                    continue
                half = halves(n, width)
                left, right = permuted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), half)
                parts.clear()
                left, right, count = summed(left, right, np.ones(len(left), np.int64), half)
                s = min(shards, half)
                of = (left >> np.uint64(half - s)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else np.zeros(1, np.int64)
                blocks = [filter_of(left[i:j], right[i:j], count[i:j], half, s) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(blocks), pa.int32()), pa.array(of[cut[:-1]], pa.int32()), pa.array(blocks, pa.binary())], ["n", "shard", "block"])

        size = 0
        for batch in slices(batches, "text"):
            found = []
            for i, (lang, x) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True)):
                own = known.get(lang, {}) if known is not None else dict(zip((w.encode() for w in batch.column("words")[i].as_py()), batch.column("ids")[i].as_py(), strict=True))
                words = tokens(x.as_buffer().to_pybytes())
                get = own.get
                found.append(np.fromiter((get(w, -1) if w else -2 for w in words), np.int64, len(words)))
                found.append(np.full(1, -1))
            ids = np.concatenate(found) if found else np.zeros(0, np.int64)
            ids = ids[ids != -2]
            whole = ids >= 0
            if allowed is not None:
                key = (ids[:-1] << width | ids[1:])
                near = np.minimum(np.searchsorted(allowed, key), max(0, len(allowed) - 1))
                linked = whole[:-1] & whole[1:] & (allowed[near] == key) if len(allowed) else np.zeros(len(key), bool)
            else:
                linked = whole[:-1] & whole[1:]
            run_of = whole
            for n in range(2, max(lengths) + 1):  # run_of: where n words in a row are linked
                run_of = run_of[:-1] & linked[n - 2 :]
                if n in gathered:
                    at = np.flatnonzero(run_of)
                    gathered[n].append(packed([ids[at + k] for k in range(n)], width))
                    size += len(at)
            if size >= RUN:
                yield from out()
                size = 0
        yield from out()
        give_back()

    return rows.mapInArrow(run, "n int, shard int, block binary")


def merged(filters: DataFrame, width: int, shards: int, least: int) -> DataFrame:
    """(ids, f) of the n-grams that all filters together count at least `least` times."""

    def run(part: pa.Table) -> pa.Table:
        n, shard = part["n"][0].as_py(), part["shard"][0].as_py()
        half = halves(n, width)
        left, right, count = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pending, size = [], 0
        for batch in part.select(["block"]).to_batches(64):
            more = [entries(b.as_py(), shard, half, min(shards, half)) for b in batch.column(0)]
            pending += more
            size += sum(len(x[0]) for x in more)
            if size > max(len(left), RUN):
                left, right, count = summed(*map(np.concatenate, zip((left, right, count), *pending, strict=True)), half)
                pending, size = [], 0
        left, right, count = summed(*map(np.concatenate, zip((left, right, count), *pending, strict=True)), half)
        keep = count >= least
        ids = unpacked(*restored(left[keep], right[keep], half), n, width).astype(np.int32)
        return pa.table({"ids": pa.ListArray.from_arrays(np.arange(0, ids.size + 1, n, dtype=np.int32), ids.reshape(-1)), "f": count[keep]})

    return filters.groupBy("n", "shard").applyInArrow(run, "ids array<int>, f long")


def _shards(total: int) -> int:
    return min(20, max(0, total // SHARD).bit_length())


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, most: int = 500_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: (ids, f) of the phrases of 1 to `longest` words that occur `least` times; (lang, word, n, id); (lang, total).

    A phrase can't occur more often than its words or its pairs of neighbours, so n-grams are counted over words that
    occur often enough, and those of three words and more only over such pairs. Words and pairs go to every task while
    they are at most `most`. Of more words, each text is joined with its own; of more pairs, all n-grams are counted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = written(word_counts(rows), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    words = written(with_ids(counted.where(F.col("n") >= least)), "dictionary")
    n_words, occurrences = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = max(1, max(0, n_words - 1).bit_length())
    if longest * width > BITS:
        raise ValueError(f"{n_words} frequent words don't fit into {BITS} bits for {longest} words")
    dictionary: dict[str, dict[bytes, int]] | None = None
    if n_words <= most:
        dictionary = {}
        for batch in words.select("lang", "word", "id").toArrow().to_batches():
            for lang, word, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                dictionary.setdefault(lang, {})[word.encode()] = i
    else:
        rows = with_own_words(rows, words)
    shards = _shards(occurrences)
    singles = words.select(F.array("id").alias("ids"), F.col("n").alias("f"))
    if longest < 2:
        return singles, words, totals
    two = written(merged(grams(rows, (2,), width, shards, dictionary, None), width, shards, least), "pairs")
    if longest < 3:
        return singles.unionByName(two), words, totals
    n_pairs, occurrences = two.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    pairs = None
    if n_pairs <= most:
        key = F.shiftleft(F.col("ids")[0].cast("long"), width).bitwiseOR(F.col("ids")[1].cast("long"))
        pairs = np.sort(two.select(key.alias("key")).toArrow().column("key").to_numpy())
    shards = _shards(occurrences * (longest - 2))
    longer = written(merged(grams(rows, tuple(range(3, longest + 1)), width, shards, dictionary, pairs), width, shards, least), "phrases")
    return singles.unionByName(two).unionByName(longer), words, totals


def _part(start: Column | int, length: Column) -> Column:
    return F.slice("ids", start, length)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, most: int = 500_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    A phrase of 2 to `longest` words within a piece counts if it occurs `least` times. Of the places to cut it, that of
    the lowest floor(1000 a n / (l r)) counts, the first of equals. Phrases that a longer candidate holds in all
    their occurrences go. Null languages are `und`; null and empty texts have no words; repeated rows count each time; ids
    and other columns play no part; an empty table gives no rows.
    """
    found, words, totals = phrases(docs, lang_col, text_col, least, longest, most)
    found = found.withColumn("size", F.size("ids"))
    whole = found.where("size > 1")
    longer = found.where("size > 2").select(F.explode(F.array(_part(1, F.col("size") - 1), _part(2, F.col("size") - 1))).alias("ids"), F.col("f").alias("over")).groupBy("ids").agg(F.max("over").alias("over"))
    kept = whole.join(longer, "ids", "left").where("over IS NULL OR over < f").select("ids", "size", F.col("f").alias("a"))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("first", _part(1, F.col("k"))).withColumn("rest", _part(F.col("k") + 1, F.col("size") - F.col("k")))
    cuts = cuts.join(found.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(found.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    named = cuts.withColumn("id", F.col("ids")[0]).join(words.select("id", "lang"), "id").join(totals, "lang")
    whole_number = "decimal(20,0)"
    score = F.expr(f"CAST(CAST(1000 AS decimal(4,0)) * CAST(CAST(a AS decimal(15,0)) * CAST(total AS decimal(19,0)) AS decimal(34,0)) AS decimal(38,0)) DIV (CAST(l AS {whole_number}) * CAST(r AS decimal(18,0)))")
    best = named.withColumn("score", score).groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("lang").alias("lang"), F.first("total").alias("n"))
    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts"))
    out = best.join(spelled.select("ids", F.array_join("parts.word", " ").alias("phrase")), "ids").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (
  SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM piece GROUP BY lang),
f AS (SELECT lang, size, w[s : s + size - 1] AS g, CAST(count(*) AS HUGEINT) AS a FROM (
  SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM piece, (SELECT unnest(range(1, {LONGEST + 1})) AS size) WHERE len(w) >= size)
  GROUP BY ALL HAVING count(*) >= {LEAST}),
inner_part AS (SELECT DISTINCT lang, g[s : s + size - 1] AS g, a FROM (
  SELECT f.lang, f.g, f.a, size.size, unnest(range(1, f.size - size.size + 2)) AS s FROM f, (SELECT unnest(range(2, {LONGEST})) AS size) AS size WHERE size.size < f.size)),
cand AS (SELECT * FROM f WHERE size > 1 AND NOT EXISTS (SELECT 1 FROM inner_part i WHERE i.lang = f.lang AND i.g = f.g AND 100 * i.a >= 100 * f.a)),
cut AS (SELECT c.lang, c.g, c.a, k, l.a AS l, r.a AS r, n, (1000 * c.a * n) // (l.a * r.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c JOIN total USING (lang)
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1 : c.size]),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM cut),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best WHERE o = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {TOP}
"""
