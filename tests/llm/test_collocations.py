"""Collocations: filters read back without loss, whole results against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tomolake.llm import collocations as c


@pytest.mark.parametrize("n,width,shards", [(2, 1, 0), (2, 15, 3), (3, 7, 2), (4, 22, 6), (5, 25, 8), (5, 12, 0)])
def test_filters_lose_nothing(n, width, shards):
    rng = np.random.default_rng(n * width)
    ids = [rng.integers(0, 1 << width, 3000) for _ in range(n)]
    half = c.halves(n, width)
    left, right = c.packed(ids, width)
    assert (c.unpacked(left, right, n, width) == np.stack(ids, axis=1)).all()
    pl, pr = c.permuted(left, right, half)
    assert all((a == b).all() for a, b in zip(c.restored(pl, pr, half), (left, right), strict=True))
    sl, sr, count = c.summed(pl, pr, rng.integers(1, 1000, 3000), half)
    s = min(shards, half)
    of = (sl >> np.uint64(half - s)).astype(int)
    for shard in np.unique(of).tolist():
        own = of == shard
        back = c.entries(c.filter_of(sl[own], sr[own], count[own], half, s), shard, half, s)
        assert all((a == b[own]).all() for a, b in zip(back, (sl, sr, count), strict=True))


def plain(rows, least, longest, top):
    """As the docstring says, by dictionaries."""
    f, n, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(words)
            f.update((lang, words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    cand = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    for (lang, p), a in cand.items():
        if any(x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in cand.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(own[:top])]
    return sorted(ranked)


def corpus():
    rng = random.Random(5)
    words = ["a", "b", "New", "YORK", "Ünder", "é", "the x", "日本", "c\x1cd", "z"]
    rows = [("en" if i % 3 else None, " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(rng.randrange(60)))) for i in range(80)]
    return rows + [("en", None), (None, ""), ("en", "new york city hall of new york " * 30), ("fr", "a a a a a a"), ("fr", " ... ,, \n")] + [("de", "x y z, x y w")] * 9


@pytest.mark.parametrize("most", [500_000, 0])
def test_collocations_match_plain_counting(spark, most):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "lang string, text string, n long, word string").repartition(5)
    got = sorted(tuple(r) for r in c.collocations(docs, least=4, top=40, most=most).collect())
    want = plain(rows, 4, 5, 40)
    assert got == want and len(got) > 60


def test_short_phrases_and_no_rows(spark):
    docs = spark.createDataFrame(corpus(), "lang string, text string")
    got = sorted(tuple(r) for r in c.collocations(docs, least=3, longest=2, top=5).collect())
    assert got == plain(corpus(), 3, 2, 5)
    assert c.collocations(docs.limit(0)).collect() == []
    assert c.collocations(docs, least=10**9).collect() == []


def test_run_and_shards_change_nothing(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(c, "SHARD", 16)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in c.collocations(docs, least=3, top=30).collect()) == plain(rows, 3, 5, 30)


def test_scores_beyond_64_bits(spark):
    """The score's arithmetic at the counts of a very large corpus."""
    a, n, left, right = 4 * 10**12, 3 * 10**16, 5 * 10**12, 7 * 10**12
    score = spark.sql(f"SELECT CAST(CAST(1000 AS decimal(4,0)) * CAST(CAST({a}L AS decimal(15,0)) * CAST({n}L AS decimal(19,0)) AS decimal(34,0)) AS decimal(38,0)) DIV (CAST({left}L AS decimal(20,0)) * CAST({right}L AS decimal(18,0)))").first()[0]
    assert score == 1000 * a * n // (left * right)
