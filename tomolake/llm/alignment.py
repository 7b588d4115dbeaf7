"""Alignment of two tokenizers over the same texts, groups labelled by pointer jumping.

Every token points to the overlapping token that reaches farthest right; the tokens of both tokenizers that hang together
then all lead to one terminal token. Successors are doubled for all tokens at once until nothing changes, which takes
as many steps as the logarithm of the longest chain. The terminal's end is where both tokenizers end a token, so terminals
label the groups.

Neither tokenizer merges across the place between a character that isn't white space and a space, so a text is cut
there and each distinct piece is tokenized and aligned once in a stretch of texts. A text with a piece whose tokens don't
spell it is tokenized as a whole instead, and has no tokens if that doesn't spell it either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import give_back, slices, written

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct pieces that a task remembers.
REMEMBERED = 300_000
#: A link's code is a * B_IDS + b.
B_IDS = 1 << 20
SPACE_MARK = "▁"


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: str) -> None:
        self.a = tokenizers.Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]  # shown as themselves by byte-level vocabularies
        shown = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(plain))}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(shown[x] for x in token) if all(x in shown for x in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > B_IDS or any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError(f"{b_file}: a piece goes on after a space, so texts can't be cut at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]

        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # Ids as they are spelled in groups, each with what follows it: A "," A "|" B "," B ";".
        ids = [range(len(x)) for x in (self.a_bytes, self.b_bytes)]
        self.said = pa.array([f"{i}{mark}" for own, marks in zip(ids, (",|", ",;"), strict=True) for mark in marks for i in own], pa.large_binary())
        self.spellings = [pa.array(x, pa.large_binary()) for x in (self.a_bytes, self.b_bytes)]

    def encode(self, pieces: list[str]) -> tuple["Tokens", "Tokens"]:
        """Ids of both for pieces that start with a space, which the second tokenizer adds itself."""
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        return Tokens(a, self.a_size, self.spellings[0]), Tokens(self.b.encode([p[1:] for p in pieces], num_threads=1), self.b_size, self.spellings[1])


class Tokens:
    """Token ids of pieces, one after the other."""

    def __init__(self, ids: list[list[int]], size: np.ndarray, spelling: pa.Array) -> None:
        self.n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, int(self.n.sum()))
        self.size, self.spelling = size, spelling

    def bytes_of_pieces(self) -> np.ndarray:
        return _sums(self.size[self.ids], np.concatenate(([0], np.cumsum(self.n))))

    def only(self, keep: np.ndarray) -> "Tokens":
        """These, with no tokens in the other pieces."""
        out = object.__new__(Tokens)
        out.n, out.ids, out.size, out.spelling = np.where(keep, self.n, 0), self.ids[np.repeat(keep, self.n)], self.size, self.spelling
        return out

    def spelled(self) -> np.ndarray:
        return np.frombuffer(self.spelling.take(pa.array(self.ids)).buffers()[2] or b"", np.uint8)


@cache
def loaded(a_file: str, b_file: str) -> Tokenizers:
    return Tokenizers(a_file, b_file)


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of either sequence the index, in the second one, of its group's terminal token.

    Ends are ascending byte offsets of gapless tokens over the same bytes.
    """
    n = len(a_ends)
    over = np.searchsorted(b_ends, a_ends)  # the token of b that holds the last byte of a token of a reaches as far or farther
    back = np.searchsorted(a_ends, b_ends)
    own = np.arange(len(b_ends)) + n
    succ = np.concatenate((over + n, np.where(a_ends[back] > b_ends, back, own)))
    while True:
        farther = succ[succ]
        if (farther == succ).all():
            return succ[:n] - n, succ[n:] - n
        succ = farther


def faithful(pieces: list[bytes], a: Tokens, b: Tokens) -> np.ndarray:
    """Whether the tokens of both spell each piece."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ok = (a.bytes_of_pieces() == size) & (b.bytes_of_pieces() == size)
    want, ends = np.frombuffer(b"".join(p for p, good in zip(pieces, ok.tolist(), strict=True) if good), np.uint8), np.cumsum(size[ok])
    for tokens in (a, b):
        wrong = np.flatnonzero(tokens.only(ok).spelled()[: len(want)] != want)
        bad = np.flatnonzero(ok)[np.searchsorted(ends, wrong, "right")]
        if len(bad):
            ok[bad] = False
            return ok & faithful([p if good else b"" for p, good in zip(pieces, ok.tolist(), strict=True)], a.only(ok), b.only(ok))
    return ok


def aligned(a: Tokens, b: Tokens, tok: Tokenizers) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Of each piece the tokens of a and b and the groups (a row of three), the groups spelled out, each followed by ";", the
    codes of the linked pairs of all pieces, and where each piece's end among these.

    The tokens of both must spell the same pieces.
    """
    if not len(a.ids):
        return np.zeros((len(a.n), 3), np.int64), [b""] * len(a.n), np.zeros(0, np.int64), np.zeros(len(a.n), np.int64)
    of_a, of_b = terminals(np.cumsum(a.size[a.ids]), np.cumsum(b.size[b.ids]))
    # Terminals ascend along either sequence: a group is a run of tokens with the same terminal.
    last_a, last_b = (np.append(x[1:] != x[:-1], True) for x in (of_a, of_b))
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    upto = np.concatenate(([0], np.cumsum(last_b)))[np.cumsum(b.n)]  # groups up to the end of each piece
    # Each group is its tokens of a, then those of b; a token's place in that order is what stands before it.
    order = np.empty(len(a.ids) + len(b.ids), np.int64)
    before_a, before_b = np.concatenate(([0], np.cumsum(np.bincount(group_a)))), np.concatenate(([0], np.cumsum(np.bincount(group_b))))
    n, m = len(tok.a_size), len(tok.b_size)
    order[np.arange(len(a.ids)) + before_b[group_a]] = a.ids + n * last_a
    order[np.arange(len(b.ids)) + before_a[group_b + 1]] = b.ids + 2 * n + m * last_b
    said = tok.said.take(pa.array(order))
    text, offsets = said.buffers()[2].to_pybytes(), np.frombuffer(said.buffers()[1], np.int64)
    ends = offsets[np.cumsum(a.n + b.n)].tolist()
    lines = [text[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
    return np.stack((a.n, b.n, np.diff(upto, prepend=0)), axis=1), lines, a.ids[last_a] * B_IDS + b.ids[last_b], upto


def cuts(data: np.ndarray) -> np.ndarray:
    """Offsets of spaces that follow a character other than white space; only some characters of three bytes and more count."""
    at = np.flatnonzero(data == 0x20)
    at = at[at >= 4]
    one, two, three = data[at - 1], data[at - 2], data[at - 3]
    plain = (one > 0x20) & (one < 0x7F)
    pair = (one >= 0x80) & (two >= 0xC3) & (two <= 0xDF)  # two bytes; those from 0xC2 hold white space
    triple = (one >= 0x80) & (two >= 0x80) & (two < 0xC0) & (three >= 0xE4) & (three <= 0xEF)  # no white space here
    return at[plain | pair | triple]


class Pieces:
    """What is known of the pieces met so far."""

    def __init__(self, tok: Tokenizers) -> None:
        self.tok, self.index = tok, {}
        self.clear()

    def clear(self) -> None:
        self.index.clear()
        self.lines: list[bytes] = []
        self.sizes, self.odd = np.zeros((0, 3), np.int64), np.zeros(0, bool)
        self.links, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of the pieces, of which new ones are aligned now."""
        if len(self.index) > REMEMBERED:
            self.clear()
        new = [p for p in pieces if p not in self.index]
        if new:
            a, b = self.tok.encode([p.decode() for p in new])
            ok = faithful(new, a, b)
            sizes, lines, links, ends = aligned(a.only(ok), b.only(ok), self.tok)
            self.index.update(zip(new, range(len(self.lines), len(self.lines) + len(new)), strict=True))
            self.lines += lines
            self.sizes, self.odd = np.concatenate((self.sizes, sizes)), np.concatenate((self.odd, ~ok))
            self.links, self.ends = np.concatenate((self.links, links)), np.concatenate((self.ends, self.ends[-1] + ends))
        return np.fromiter((self.index[p] for p in pieces), np.int64, len(pieces))

    def links_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of the pieces one after the other, and how many each has."""
        n = self.ends[which + 1] - self.ends[which]
        return self.links[np.repeat(self.ends[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring edges."""
    return np.diff(np.concatenate((np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)))[edges], axis=0)


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, codes, times) of each row; with doc_id null and n_a null, sums over many rows.

    codes are the distinct linked pairs of the text (a id * 2**20 + b id) and times how often each is linked. The rows with
    n_a null hold the same of all rows of a stretch of a task, for corpus-wide counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(a_file, b_file)
        known = Pieces(tok)
        names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "times"]
        total: dict[int, int] = {}

        def sums() -> pa.RecordBatch:
            one = lambda values: pa.ListArray.from_arrays([0, len(values)], pa.array(values, pa.int64()))
            empty = pa.nulls(1, pa.int64())
            out = pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.nulls(1, pa.string()), one(list(total)), one(list(total.values()))], names)
            total.clear()
            return out

        for batch in slices(batches, "text"):
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text")]
            data = np.frombuffer(b"".join([b" " + x for x in texts if x]), np.uint8)
            sizes = np.fromiter((len(x) + 1 if x else 0 for x in texts), np.int64, len(texts))
            starts = np.cumsum(sizes) - sizes
            cut = np.unique(np.concatenate((starts[sizes > 0], cuts(data)))).astype(np.int32)
            of = np.searchsorted(starts + sizes, cut, "right")  # the text of each piece
            encoded = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(np.append(cut, np.int32(len(data))).tobytes()), pa.py_buffer(data)]).dictionary_encode()
            numbers = known.learn(encoded.dictionary.to_pylist())[encoded.indices.to_numpy()] if len(cut) else np.zeros(0, np.int64)
            edge = np.searchsorted(of, np.arange(len(texts) + 1))
            counts, odd = _sums(known.sizes[numbers], edge), known.odd[numbers]
            lines, picked, extra = [], np.ones(len(numbers), bool), []
            inner = numbers.tolist()
            for d in range(len(texts)):
                i, j = int(edge[d]), int(edge[d + 1])
                if odd[i:j].any():
                    picked[i:j] = False
                    whole = b" " + texts[d]
                    a, b = tok.encode([whole.decode()])
                    ok = faithful([whole], a, b)
                    size, (line,), links, _ = aligned(a.only(ok), b.only(ok), tok)
                    counts[d] = size[0]
                    extra += [(d, x) for x in links.tolist()]
                else:
                    line = b"".join([known.lines[k] for k in inner[i:j]])
                lines.append(hashlib.sha256(line[:-1]).hexdigest() if line else "")
            code, n = known.links_of(numbers[picked])
            where = np.concatenate((np.repeat(of[picked], n), np.array([d for d, _ in extra], np.int64)))
            code, number = np.unique(np.concatenate((code, np.array([x for _, x in extra], np.int64))), return_inverse=True)
            key, times = np.unique(where << 32 | number, return_counts=True)
            offsets = np.searchsorted(key, np.arange(len(texts) + 1) << 32).astype(np.int32)
            listed = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (code[key & 0xFFFFFFFF], times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(3)), pa.array(lines, pa.string()), *listed], names)
            for x, k in zip(code.tolist(), np.bincount(number).tolist(), strict=True):
                total[x] = total.get(x, 0) + k
            if len(total) > 500_000:
                yield sums()
        yield sums()
        give_back()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, codes array<long>, times array<long>")


def link_counts(rows: DataFrame) -> DataFrame:
    """(code, n, best) of every pair that align() has linked: how often, and whether no pair of its B id has more."""
    pairs = rows.where("n_a IS NULL").select(F.explode(F.arrays_zip("codes", "times")).alias("x")).groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.times").alias("n"))
    pairs = pairs.withColumn("b", F.col("code").bitwiseAND(B_IDS - 1))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def corpus_alignment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, most: int = 4_000_000) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_links: pairs of an a and a b token that end together; count_sum: over these, how often the corpus links that pair of
    ids; n_best: those whose pair the corpus links at least as often as any other pair of its b id. Null and empty
    texts, and texts that the tokens of either don't spell, have zeros and an empty groups_sha256. Repeated rows count each
    time; null and repeated ids pass; other columns are ignored; an empty table gives no rows.

    Each text is tokenized once, and its distinct pairs are written. The corpus's counts go to every task while they are at
    most `most` pairs; beyond, they are joined with the written pairs.
    """
    spark = docs.sparkSession
    rows = written(align(docs, doc_id, text, a_file, b_file).withColumn("row", F.monotonically_increasing_id()), "alignment")
    counts = written(link_counts(rows), "links")
    found = rows.where("n_a IS NOT NULL")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() > most:
        each = found.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
        sums = each.join(counts, "code").groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        return found.drop("codes", "times").join(sums, "row", "left").fillna(0, ["n_links", "n_best", "count_sum"]).select(columns)
    table = counts.orderBy("code").toArrow()
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for batch in batches:
            lists, times = batch.column("codes"), batch.column("times").flatten().to_numpy()
            at = np.searchsorted(code, lists.flatten().to_numpy())
            edge = lists.offsets.to_numpy().astype(np.int64)
            out = [_sums(x, edge - edge[0]) for x in ((times, times * best[at], times * n[at]) if len(at) else (times,) * 3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns[:4]), *map(pa.array, out), batch.column("groups_sha256")], columns)
        give_back()

    return found.drop("row").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
