"""Token alignment against whole texts aligned token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tomolake.llm import alignment


def plain(rows):
    """As the docstrings say, with whole texts and sets of offsets."""
    tok = alignment.loaded(alignment.A_FILE, alignment.B_FILE)
    out, links = [], []
    for doc_id, text in rows:
        a = tok.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tok.b.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(tok.a_bytes[i] for i in a) != want or b"".join(tok.b_bytes[i] for i in b) != want:
            a = b = []
        ends_a, ends_b = np.cumsum([len(tok.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(tok.b_bytes[i]) for i in b]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        groups, start = [], 0
        for end in both:
            groups.append(",".join(str(i) for i, e in zip(a, ends_a, strict=True) if start < e <= end) + "|" + ",".join(str(i) for i, e in zip(b, ends_b, strict=True) if start < e <= end))
            start = end
        line = ";".join(groups)
        links.append([(a[ends_a.index(e)], b[ends_b.index(e)]) for e in both])
        out.append([doc_id, len(a), len(b), len(both), hashlib.sha256(line.encode()).hexdigest() if line else ""])
    count = Counter(x for own in links for x in own)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(((*r[:4], len(own), sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), r[4]) for r, own in zip(out, links, strict=True)), key=repr)


def corpus():
    rng = random.Random(3)
    bits = ["the", "token", "Ünder", "naïve", "日本 語", "don't", "123456", "\n", "\t x", "  ", "   y", "<|endoftext|>", "<s>", "ﬁ", "é", " ", "　", " ", "\x00", "🙂", "...", "a▁b", "▁", "x" * 70, "=====", "\r\n"]
    rows = [(i, " ".join(rng.choice(bits[: 6 + i % 21]) for _ in range(rng.randrange(25)))) for i in range(260)]
    rows += [(i, "".join(rng.choice(bits[: 6 + i % 21] + [" "] * 9) for _ in range(rng.randrange(25)))) for i in range(260, 400)]
    return rows + [(400, None), (401, ""), (402, " "), (None, "no id"), (5, "twice"), (5, "twice"), (403, " lead"), (404, "trail "), (405, "▁"), (406, "a▁ b"), (407, "a ▁b")]


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_alignment_matches_whole_texts(spark, most):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, row string, n_a int").repartition(3)
    got = sorted((tuple(r) for r in alignment.corpus_alignment(docs, most=most).collect()), key=repr)
    assert got == plain(rows)
    assert sum(r[1] == 0 for r in got) > 3 < sum(r[1] > 20 for r in got)


def test_documents_match_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").where("length(text) < 8000").collect()]
    got = alignment.corpus_alignment(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_pointers_reach_the_terminal_of_long_chains():
    a = np.append(np.arange(2, 4001, 2), 4001)
    b = np.append(np.arange(1, 4000, 2), 4001)  # never together before the end
    of_a, of_b = alignment.terminals(a, b)
    assert set(of_a) == set(of_b) == {len(b) - 1}


def test_a_task_that_forgets(spark, monkeypatch):
    tok = alignment.loaded(alignment.A_FILE, alignment.B_FILE)
    monkeypatch.setattr(alignment, "REMEMBERED", 1)
    known = alignment.Pieces(tok)
    for words in ([b" one", b" two"], [b" two", b" three four"], [b" one"]):
        at = known.learn(words)
        assert [known.lines[k] for k in at] == [alignment.aligned(*tok.encode([w.decode()]), tok)[1][0] for w in words]


def test_no_rows(spark):
    assert alignment.corpus_alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []
