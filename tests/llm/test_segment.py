import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomolake.llm import segment


@pytest.fixture(scope="module")
def vocab():
    return segment.vocabulary(segment.DEFAULT_MODEL, 1.0)


def segmentations(lattice, place=0):
    for e in range(lattice.begin[place], lattice.begin[place + 1]):
        tails = [((), 0.0)] if lattice.end_of_word[e] else segmentations(lattice, lattice.stop[e])
        for rest, p in tails:
            yield (e, *rest), float(lattice.log_p[e]) + p


def test_sampling_without_replacement(vocab):
    words, _, _ = segment.words_of(pa.array(["hello"]))
    lattice = segment.Lattice(words, vocab)
    p = {tuple(lattice.ids(np.array(k), np.array([len(k)]))[0].tolist()): np.exp(v) for k, v in segmentations(lattice)}
    assert abs(sum(p.values()) - 1) < 1e-9
    n = 6000
    found = segment.segment_texts(pa.array(["hello"] * n), np.arange(n).astype(np.uint64) * np.uint64(977), vocab, 3)
    assert all(len({tuple(s[0].tolist()) for s in x}) == 3 and x[0][2] >= x[1][2] >= x[2][2] for x in found)
    pairs = Counter((tuple(x[0][0].tolist()), tuple(x[1][0].tolist())) for x in found)
    top = sorted(p, key=p.get)[-3:]
    for a, b in itertools.permutations(top, 2):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(pairs[a, b] / n - want) < 4 * (want / n) ** 0.5 + 1e-3
    assert abs(np.mean([sum(np.exp(s[1] - s[3]) for s in x) for x in found]) - 1) < 0.02  # inclusion scores weigh out


def test_exhausts_and_restores(vocab):
    texts = ["", " ", "  a  b ", "▁x▁ \U0001f600 漢字\n\n  z  ", "a" * 3000, "é\x00\tü", "word " * 5000]
    for t, x in zip(texts, segment.segment_texts(pa.array(texts), np.arange(7).astype(np.uint64), vocab, 3), strict=True):
        assert x and all(s[4] for s in x), t
    assert len(segment.segment_texts(pa.array([""]), np.array([1], np.uint64), vocab, 3)[0]) == 1


def test_operator(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "x"), (None, "other text", "x"), (4, "hello world", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    a = segment.sample_segmentations(docs).cache()
    b = segment.sample_segmentations(docs.repartition(5))
    key = ["key", "sample", "ids", "log_prob", "perturbed", "log_inclusion"]
    assert sorted(map(str, a.select(key).collect())) == sorted(map(str, b.select(key).collect()))
    assert a.where("NOT decoded_ok").isEmpty() and a.where("key = 1").count() == 4
    texts = {(r["key"], r["text"]) for r in segment.decode(a).collect()}
    assert texts == {(1, "hello world"), (2, ""), (None, "other text"), (4, "hello world")}
    one, four = (a.where((F.col("key") == k) & (F.col("sample") == 0)).first()["perturbed"] for k in (1, 4))
    assert one != four
    assert segment.digests(segment.sample_segmentations(docs.limit(0))).count() == 0
