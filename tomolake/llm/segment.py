"""Sampled SentencePiece segmentations without replacement: Gumbel top-k by perturbed A-star search over the lattice.

The lattice of a text has an edge for every vocabulary piece that matches a substring, and byte pieces for characters
outside the vocabulary. Edges weigh `alpha` times the piece's log weight; a segmentation's probability is in
proportion to the exponential of its sum. Backward sums give each edge its probability given the place it starts
from, so a region of the search space - all segmentations that begin with some edges and don't continue with certain
others - has an exact log mass, which bounds the search.

The root's perturbed value is a Gumbel variable. A region's is the maximum over its segmentations: a Gumbel variable
of its mass, no higher than that of the region it is split from. The search pops the region of the highest value,
draws the segmentation that attains it, and splits off, for each edge of it, the region that leaves it there. The
segmentations popped are distinct, in falling order of perturbed log probability: a sample without replacement. The
next region's value is the threshold for the inclusion scores, log(1 - exp(-exp(log_prob - threshold))).

Noise is a hash of the row's key, the sample and the place, so results don't depend on partitions or batches. No piece
of the model may cross from a character other than a space to a space; lattices then fall apart at spaces, and the
edges of each distinct word of a block of texts are found once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import slices, texts_of

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
FLOOR = 37.0  # -log of the smallest uniform variable used, 2**-53
AHEAD = 256
SCHEMA = "key long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, decoded_ok boolean"


def uniform(seed: np.ndarray | int, counter: np.ndarray | int) -> np.ndarray:
    """Uniform variables in (0, 1): a mixing hash of seed and counter."""
    return mixed(blend(seed, counter))


def key_of(seed: np.ndarray | int, number: np.ndarray | int) -> np.ndarray:
    """A seed of its own for each number (a word's place, or a sample's) under a seed, whatever the counters used with it."""
    return scramble(blend(seed, number))


def blend(seed: np.ndarray | int, counter: np.ndarray | int) -> np.ndarray:
    """Linear in both, so that counters may be added up later: blend(s, a + b) = blend(s, a) + blend(0, b)."""
    return np.atleast_1d(np.asarray(seed, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.atleast_1d(np.asarray(counter, np.uint64)) * np.uint64(0xD1B54A32D192ED03)


def scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values; x is used up."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def mixed(x: np.ndarray) -> np.ndarray:
    """Uniform variables in (0, 1) of what blend() gives; x is used up."""
    x = scramble(x)
    x >>= np.uint64(11)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


def truncated_gumbel(log_mass: np.ndarray, limit: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of these masses, given that they are no higher than the limit."""
    return -np.logaddexp(-limit, -log_mass + np.log(-np.log(u)))


class Table:
    """Lookups of many whole numbers at once: an open hash table in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length() + 1))
        self.keys = np.full(1 << int(64 - self.shift), -1, np.int64)
        self.values = np.full(len(self.keys), -1, np.int32)
        at = self._at(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) % len(self.keys)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 where there is none."""
        at = self._at(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Vocabulary:
    """Pieces as a trie in arrays, with log weights and bytes."""

    def __init__(self, model_file: str, alpha: float):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        byte = np.array([sp.is_byte(i) for i in range(n)])
        plain = [i for i in range(n) if not (byte[i] or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        #: A BPE model's scores are falling ranks: weights then follow a power law of the rank. A unigram model's are log probabilities.
        ranked = len(plain) > 1 and bool(np.all(score[plain] == np.round(score[plain])))
        self.weight = alpha * (-np.log(2 - np.minimum(score, 0)) if ranked else score)
        self.weight[byte] = alpha * (-np.log(2.0 + n) if ranked else score[plain].min() - 10)
        self.byte_id = {bytes([int(pieces[i][3:5], 16)])[0]: i for i in range(n) if byte[i]}
        if len(self.byte_id) < 256:
            raise ValueError("the model has no byte fallback: texts could not be restored")
        if any(a != SPACE and b == SPACE for i in plain for a, b in zip(pieces[i], pieces[i][1:], strict=False)):
            raise ValueError("a piece crosses from a word into a space")
        data = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(pieces[i][3:5], 16)]) if byte[i] else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.length = np.array([len(x) for x in data])
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        alphabet = sorted({c for i in plain for c in pieces[i]})
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        self.width = len(alphabet)
        edges, ends = {}, {}
        for i in plain:
            node = 0
            for c in pieces[i]:
                node = edges.setdefault(node * self.width + int(self.letter[ord(c)]), len(edges) + 1)
            ends[node] = i
        self.edges = Table(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32))
        self.piece = np.full(len(edges) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())

    def decode_all(self, ids: np.ndarray, size: np.ndarray) -> tuple[bytes, list[int]]:
        """The bytes of runs of ids, one after another, and where each run's end; the space before each text is left in."""
        length = self.length[ids]
        ends = np.concatenate(([0], np.cumsum(length)))[np.cumsum(size)]
        return gather(self.bytes, self.start[ids], length).tobytes(), ends.tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids; the space put before it on encoding is taken off."""
        return gather(self.bytes, self.start[ids], self.length[ids])[1:].tobytes()


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start : start + length] for each pair, one after another."""
    if len(length) and length.min(initial=1) == length.max(initial=1) == 1:
        return flat[start]
    before = np.cumsum(length) - length
    return flat[np.repeat(start - before, length) + np.arange(int(length.sum()))]


@cache
def vocabulary(model_file: str, alpha: float) -> Vocabulary:
    return Vocabulary(model_file, alpha)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each with the spaces before it, with the index of each text's words and their counts.

    A text is read with one space before it. Spaces are SPACE; one in the text itself is put as U+FFFFF, outside any
    vocabulary, so that its bytes are kept.
    """
    lists = pc.split_pattern(texts, " ")
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    empty = pc.index(coded.dictionary, "").as_py()
    words = pc.binary_join_element_wise(SPACE, pc.replace_substring(coded.dictionary, SPACE, "\U000fffff"), "")
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    follows = np.zeros(len(index), bool)  # words that belong to a run of spaces before them
    if empty >= 0:
        text = np.repeat(np.arange(len(count)), count)
        follows[1:] = (index[:-1] == empty) & (text[1:] == text[:-1])
    if follows.any():
        known: dict[str, int] = {}  # they begin with two spaces at least, or are spaces only: no other word does
        if empty >= 0:
            known[SPACE] = empty
        head = np.flatnonzero(~follows)
        tail = np.append(head[1:], len(index))
        for a in np.flatnonzero(tail - head > 1):
            x = SPACE * int(tail[a] - head[a] - 1) + words[int(index[tail[a] - 1])].as_py()
            index[head[a]] = known.setdefault(x, len(words) + len(known) - (empty >= 0))
        words = pa.concat_arrays([words, pa.array([x for x in known if x != SPACE], words.type)])
        index, count = index[head], np.bincount(text[head], minlength=len(count))
    return words, index, count


class Lattice:
    """The lattices of distinct words: places, edges in order of their start, and cumulative edge probabilities."""

    def __init__(self, words: pa.Array, v: Vocabulary):
        letters = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_py()
        codes = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
        self.first = np.cumsum(size, dtype=np.int32) - size
        end = np.repeat(self.first + size, size)  # of the word each place is in
        letters = v.letter[codes]
        n = len(codes)
        found = []
        live, node, step = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), 0
        many = np.zeros(n + 1, np.int32)  # edges from each place
        while len(live):
            letter = letters[live + step]
            node = np.where(letter >= 0, v.edges.get(node.astype(np.int64) * v.width + letter), np.int32(-1))
            live, node = live[node >= 0], node[node >= 0]
            piece = v.piece[node]
            ends = piece >= 0
            found.append((live[ends], piece[ends]))
            many[live[ends]] += 1
            if step == 0:
                fallback = np.flatnonzero(many[:n] == 0).astype(np.int32)
                many[fallback] += 1
            step += 1
            more = live + step < end[live]
            live, node = live[more], node[more]
        self.begin = np.concatenate(([0], np.cumsum(many[:n]))).astype(np.int32)
        total = int(self.begin[-1])
        self.stop, emit = np.empty(total, np.int32), np.empty(total, np.int32)
        free = self.begin[:-1].copy()
        self.simple = not len(fallback)
        extra, weight_of = [], v.weight
        for step, (at, piece) in enumerate(found):
            self.stop[free[at]], emit[free[at]] = at + step + 1, piece
            free[at] += 1
            if step == 0 and len(fallback):
                extra = [np.array([v.byte_id[b] for b in (SPACE if c == 0xFFFFF else chr(c)).encode("utf-8", "surrogatepass")]) for c in codes[fallback].tolist()]
                self.stop[free[fallback]], emit[free[fallback]] = fallback + 1, len(v.weight) + np.arange(len(fallback))
                free[fallback] += 1
                weight_of = np.concatenate((v.weight, [v.weight[x].sum() for x in extra]))
        self.emit = emit
        if extra:
            self.flat = np.concatenate((np.arange(len(v.weight)), *extra)).astype(np.int32)
            self.flat_length = np.concatenate((np.ones(len(v.weight), np.int64), [len(x) for x in extra]))
            self.flat_start = np.cumsum(self.flat_length) - self.flat_length
        weight = weight_of[emit]
        self.start = np.repeat(np.arange(n, dtype=np.int32), many[:n])
        self.end_of_word = self.stop == end[self.start]
        far = (end - np.arange(n, dtype=np.int32))[self.start]
        longest = int(far.max(initial=0))
        turn = np.argsort(far.astype(np.uint16) if longest < 1 << 16 else far, kind="stable")
        bounds = np.cumsum(np.bincount(far, minlength=longest + 1))
        value = np.zeros(n + 1)  # log of the summed weight from a place to its word's end
        for a, b in zip(bounds, bounds[1:], strict=False):
            e = turn[a:b]
            if len(e):
                sums = weight[e] + np.where(self.end_of_word[e], 0.0, value[self.stop[e]])
                place = self.start[e]
                heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                value[place[heads]] = np.logaddexp.reduceat(sums, heads)
        weight += np.where(self.end_of_word, 0.0, value[self.stop])
        weight -= value[self.start]
        self.log_p = np.minimum(weight, 0.0)
        p = np.exp(self.log_p)
        run = np.cumsum(p)
        run -= np.repeat((run - p)[self.begin[:-1]], many[:n])
        self.cumulative = run + self.start  # so that one search finds the edge of any place

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each place."""
        edge = np.searchsorted(self.cumulative, place + u, side="right")
        return np.clip(edge, self.begin[place], self.begin[place + 1] - 1)

    def paths(self, word: np.ndarray, seeds: np.ndarray, number: np.ndarray, samples: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each sample an independent path for each word occurrence: edges one word after another, and how many each word has.

        seeds and number: the row's seed and the word's number in its text.
        """
        turn = np.argsort(word.astype(np.uint32))  # equal words together, for the caches
        heads, noise = self.first[word[turn]], blend(key_of(seeds, number), 0)[turn]
        out = []
        for sample in range(samples):
            live, place, mine = turn, heads, noise
            counts, taken, step = np.zeros(len(word), np.int64), [], 0
            while len(live):
                edge = self.draw(place, mixed(mine + blend(0, step * samples + sample)))
                taken.append((live, edge))
                counts[live] += 1
                more = ~self.end_of_word[edge]
                live, place, mine = live[more], self.stop[edge[more]], mine[more]
                step += 1
            edges, at = np.zeros(int(counts.sum()), np.int64), np.cumsum(counts) - counts
            for step, (who, edge) in enumerate(taken):
                edges[at[who] + step] = edge
            out.append((edges, counts))
        return out

    def ids(self, edges: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of paths that lie one after another, and how many each has; size: of the paths in edges."""
        ids = self.emit[edges]
        if self.simple:
            return ids, size
        length = self.flat_length[ids]
        ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(size)))]
        return gather(self.flat, self.flat_start[ids], length), np.diff(ends)


class Chain:
    """A drawn segmentation and the regions split off along it, from edge `own` on (earlier ones belong to its parent).

    Masses only fall along a chain and noise is bounded, so values are worked out as far as one could be the highest.
    """

    def __init__(self, lattice: Lattice, edges: np.ndarray, value: float, own: int, banned: list[int], seed: int, number: int):
        self.lattice, self.edges, self.value, self.own, self.banned, self.seed = lattice, edges, value, own, [*banned, int(edges[own])], int(key_of(seed ^ 0x5851F42D4C957F2D, number)[0])
        self.log_p = lattice.log_p[edges]
        self.prefix = np.cumsum(self.log_p) - self.log_p
        self.gone: set[int] = set()
        self.values = np.zeros(0)

    def best(self) -> tuple[float, int]:
        top = self.values.max(initial=-np.inf)
        while (at := self.own + len(self.values)) < len(self.edges) and self.prefix[at] + FLOOR >= top:
            to = min(len(self.edges), at + max(AHEAD, len(self.values)))
            to = at + max(1, int(np.searchsorted(-self.prefix[at:to], FLOOR - top, side="right")))
            rest = -np.expm1(self.log_p[at:to])  # 0 where an edge is the only one of its place
            if at == self.own:
                rest[0] = self._left()
            mass = self.prefix[at:to] + np.log(np.maximum(rest, 1e-300))
            u = uniform(self.seed, np.arange(at, to, dtype=np.uint64))
            values = truncated_gumbel(mass, self.value, u)
            values[rest <= 0] = -np.inf
            self.values = np.concatenate((self.values, values))
            for i in self.gone:
                if i - self.own < len(self.values):
                    self.values[i - self.own] = -np.inf
            top = self.values.max(initial=-np.inf)
        return (float(top), self.own + int(self.values.argmax())) if len(self.values) else (-np.inf, -1)

    def _left(self) -> float:
        """The probability of the edges at `own` that no segmentation has taken."""
        return float(sum(np.exp(self.lattice.log_p[e]) for e in self.others()))

    def others(self, at: int | None = None) -> list[int]:
        at = self.own if at is None else at
        place, taken = self.lattice.start[self.edges[at]], self.bans(at)
        return [e for e in range(self.lattice.begin[place], self.lattice.begin[place + 1]) if e not in taken]

    def bans(self, at: int) -> list[int]:
        return self.banned if at == self.own else [int(self.edges[at])]

    def drop(self, at: int) -> None:
        self.gone.add(at)
        self.values[at - self.own] = -np.inf


def search(lattice: Lattice, fresh: list[tuple[np.ndarray, np.ndarray]], k: int, seed: int) -> tuple[list[Chain], float]:
    """Up to k chains in order of value, and the value of the best region left.

    fresh: for each sample a path drawn independently (edges, edges of each word), of which the part after the first
    word that differs is used.
    """
    root = float(-np.log(-np.log(uniform(seed, 1)[0])))
    chains = [Chain(lattice, fresh[0][0], root, 0, [], seed, 0)]
    while True:
        top, at, parent = max(((*c.best(), c) for c in chains), key=lambda x: x[0])
        if len(chains) == k or top == -np.inf:
            return chains, top
        number = len(chains)
        choices = parent.others(at)
        p = np.cumsum(np.exp(lattice.log_p[choices]))
        own = int(key_of(seed ^ 0x2545F4914F6CDD1D, number)[0])
        u = uniform(own, np.arange(32))
        edge = choices[min(int(np.searchsorted(p, u[0] * p[-1], side="right")), len(choices) - 1)]
        bans = parent.bans(at)
        word = int(lattice.end_of_word[parent.edges[:at]].sum())
        part, step = [edge], 1
        while not lattice.end_of_word[part[-1]]:
            more = u[step] if step < len(u) else uniform(own, step)[0]
            part.append(int(lattice.draw(np.array([lattice.stop[part[-1]]]), np.array([more]))[0]))
            step += 1
        edges, counts = fresh[number]
        after = edges[int(counts[: word + 1].sum()) :]
        parent.drop(at)
        chains.append(Chain(lattice, np.concatenate((parent.edges[:at], part, after)).astype(np.int64), top, at, bans, seed, number))


def log_inclusion(log_prob: float, threshold: float) -> float:
    x = log_prob - threshold
    if x > 30 or threshold == -np.inf:
        return 0.0
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))


@dataclass(frozen=True)
class Samples:
    """The samples of a block of texts, one after another: `count` of each text, `size` ids of each sample."""

    count: np.ndarray
    size: np.ndarray
    ids: np.ndarray
    log_prob: np.ndarray
    perturbed: np.ndarray
    log_inclusion: np.ndarray
    decoded_ok: np.ndarray


def segment_block(texts: pa.Array, seeds: np.ndarray, v: Vocabulary, k: int) -> Samples:
    words, index, count = words_of(texts)
    lattice = Lattice(words, v)
    ends = np.cumsum(count)
    number = np.arange(len(index)) - np.repeat(ends - count, count)
    draws = lattice.paths(index, np.repeat(seeds, count), number, k)
    edge_ends = [np.concatenate(([0], np.cumsum(c)))[np.concatenate(([0], ends))] for _, c in draws]
    edges, scores, found = [np.zeros(0, np.int64)], [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        a, b = int(ends[i] - count[i]), int(ends[i])
        fresh = [(e[cut[i] : cut[i + 1]], c[a:b]) for (e, c), cut in zip(draws, edge_ends, strict=True)]
        chains, threshold = search(lattice, fresh, k, int(seeds[i]))
        found[i] = len(chains)
        for c in chains:
            log_prob = float(c.log_p.sum())
            edges.append(c.edges)
            scores.append((log_prob, c.value, log_inclusion(log_prob, threshold)))
    size = np.array([len(e) for e in edges[1:]], np.int64)
    edges = np.concatenate(edges)
    ids, size = lattice.ids(edges, size)
    data, made = v.decode_all(ids, size)
    want = [x.as_buffer().to_pybytes() for x in texts]
    ok = [data[a + 1 : b] == want[i] for i, a, b in zip(np.repeat(np.arange(len(want)), found).tolist(), [0, *made[:-1]], made, strict=True)] if made else []
    log_prob, perturbed, included = np.array(scores, float).reshape(-1, 3).T
    return Samples(found, size, ids.astype(np.int32), log_prob, perturbed, included, np.array(ok, bool))


def segment_texts(texts: pa.Array, seeds: np.ndarray, v: Vocabulary, k: int) -> list[list[tuple]]:
    """For each text its samples: (ids, log_prob, perturbed, log_inclusion, decoded_ok)."""
    s = segment_block(texts, seeds, v, k)
    rows = list(zip(np.split(s.ids, np.cumsum(s.size)[:-1]), s.log_prob.tolist(), s.perturbed.tolist(), s.log_inclusion.tolist(), s.decoded_ok.tolist(), strict=True)) if len(s.size) else []
    ends = np.cumsum(s.count).tolist()
    return [rows[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def sample_segmentations(docs: DataFrame, model_file: str = DEFAULT_MODEL, k: int = 2, alpha: float = 1.0, seed: int = 42, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k distinct segmentations of each whole text, best perturbed value first.

    Columns: key, sample (from 0), ids, log_prob, perturbed, log_inclusion, decoded_ok (the ids decode to the text).
    Fewer than k rows where the text has fewer segmentations. Null and empty texts are read as the space that goes
    before any text. Rows with equal keys and texts get equal samples; a null key is seeded as a key of its own.
    model_file must be readable on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file, alpha)
        for batch in slices(batches, "text"):
            texts = texts_of(batch, "text")
            seeds = batch.column("seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            found = segment_block(texts, seeds, v, k)
            keys = pc.take(batch.column("key"), pa.array(np.repeat(np.arange(len(texts)), found.count)))
            number = np.arange(len(found.size)) - np.repeat(np.cumsum(found.count) - found.count, found.count)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(found.size))), pa.int32()), pa.array(found.ids))
            columns = [keys, pa.array(number, pa.int32()), ids, *(pa.array(x) for x in (found.log_prob, found.perturbed, found.log_inclusion, found.decoded_ok))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "sample", "ids", "log_prob", "perturbed", "log_inclusion", "decoded_ok"])

    return docs.select(F.col(key_col).cast("long").alias("key"), F.xxhash64(F.lit(seed), F.col(key_col)).alias("seed"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decode(segmented: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """(key, sample, text): the texts of the ids. Null ids give a null text, none an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file, 1.0)
        for batch in batches:
            texts = [None if not x.is_valid else v.decode(x.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") if len(x) else "" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("sample"), pa.array(texts, pa.string())], ["key", "sample", "text"])

    return segmented.select("key", "sample", "ids").mapInArrow(run, "key long, sample int, text string")


def digests(segmented: DataFrame) -> DataFrame:
    """What the query returns of each sample: the ids as their number and hash."""
    return segmented.select(F.col("key").alias("doc_id"), "sample", F.size("ids").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "log_inclusion", "decoded_ok")
