import numpy as np
import xxhash

from tomolake.llm import embeddings, simhash

DOCS = "doc_id long, text string, fp string"


def reference(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(ids, near):
    root = {i: i for i in ids}
    while True:
        new = {i: min(root[j] for j in ids if near(i, j)) for i in ids}
        if new == root:
            return root
        root = new


def test_fingerprints_and_components(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 400)) for _ in range(12)]
    texts = base + [b + " end" for b in base] + [b.upper() for b in base[:4]] + [None, "", " \t\n", "one", "One two", "É é x\u000b y"]
    texts += [base[0]] * 80 + [base[1] + f" tail{i}" for i in range(90)]
    rows = [(i + 3, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    fps = {i: reference(t) for i, t, _ in rows}
    want = closure(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for hot in (64, 2):
        got = simhash.near_duplicates(docs, hot=hot).select("id", simhash.hex_fingerprint(simhash.F.col("fp")).alias("h"), "component").collect()
        assert {r["id"]: r["h"] for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
        assert {r["id"]: r["component"] for r in got} == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_null_ids_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "a b c d", "x"), (5, "a b c d", "x"), (None, "a b c d", "x"), (9, None, "x")], DOCS)
    got = sorted(((r["id"], r["component"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (9, 9)], key=str)
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(docs).collect()) == ["5", "9"]  # one of each group, named ones first
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one_goes_by_rows(spark):
    rng = np.random.default_rng(2)
    t = [" ".join(rng.choice([f"w{i}" for i in range(500)], 60)) for _ in range(12)]
    rows = [(7, t[0]), (3, t[0]), (7, t[1]), (3, t[2])]  # 7 is led by 3 in one text only
    rows += [(8, t[3]), (8, t[3]), (8, t[4])] + [(50, x) for x in t[5:9]]  # one id, several texts
    rows += [(None, t[9]), (None, t[9]), (None, t[10]), (60, t[10]), (None, t[11])]
    docs = spark.createDataFrame([(i, x, "x") for i, x in rows], DOCS).repartition(3)
    want = [(3, t[0]), (7, t[1]), (3, t[2]), (8, t[3]), (8, t[4]), *((50, x) for x in t[5:9]), (None, t[9]), (60, t[10]), (None, t[11])]
    for hot in (64, 1):
        assert sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs, hot).collect()), key=str) == sorted(want, key=str)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 16))
    x = np.vstack([centres[i % 60] + 0.06 * rng.standard_normal(16) for i in range(700)])
    rows = [(i, [float(np.float32(v)) for v in e], int(i % 60) % 3) for i, e in enumerate(x)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [None] * 16, 1), (1005, rows[0][1], None), (None, rows[0][1], 0), (1007, rows[0][1], rows[0][2]), (1008, rows[0][1][:8], 0), (1009, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(e, float), c) for i, e, c in rows if i is not None and i < 1000 or i == 1007]
    u = np.array([e / np.linalg.norm(e) for _, e, _ in good])
    near = (u @ u.T >= 0.98) & (np.array([c for *_, c in good])[:, None] == np.array([c for *_, c in good]))
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, leaf=64, block=20).collect()}
    assert len(got) == len(rows)
    links = np.array([got[i]["n_links"] for i, *_ in good])
    assert near.sum() > 500 and (links <= near.sum(axis=1)).all() and links.sum() >= 0.98 * near.sum()
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1008, 1009):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["kept"]) == (0, False)
    whole = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df, block=50).collect()}
    assert [whole[i] for i, *_ in good] == near.sum(axis=1).tolist()  # one leaf in blocks: exact
    rows_of = {r["vec_id"]: r for r in embeddings.near_vectors(df, block=50).collect()}
    place = {i: k for k, (i, *_) in enumerate(good)}
    want = closure(list(place), lambda a, b: a == b or near[place[a], place[b]])
    assert {i: rows_of[i]["component_id"] for i in place} == want
    assert {i: rows_of[i]["kept"] for i in place} == {i: want[i] == i for i in place}
    deep = {r["vec_id"]: r for r in embeddings.near_vectors(df, leaf=200, most=24, block=20, sample_rows=30).collect()}  # split on in rounds
    links = np.array([deep[i]["n_links"] for i, *_ in good])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.95 * near.sum()
    assert embeddings.near_vectors(spark.createDataFrame([], df.schema)).count() == 0


def test_leaves_are_split_on(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8))
    x[:150] = x[0] + 1e-4 * rng.standard_normal((150, 8))  # copies that no split tells apart
    first = embeddings.FIRST
    routed = spark.createDataFrame([("a" if i % 4 else None, str(i), 8, [float(v) for v in e], [first, first + 7]) for i, e in enumerate(x)], "label string, same string, width int, embedding array<double>, leaves array<long>").where("label = 'a'")
    out = embeddings.split_on(routed, 60, 0.01, 5)
    sizes = {r["leaf"]: r["count"] for r in out.select(simhash.F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
    assert len(sizes) > 12 and sum(n > 60 for n in sizes.values()) <= 2 * 4  # the copies' leaves, in either tree
    assert out.count() == 450 and all(r["leaves"] == sorted(set(r["leaves"])) and len(r["leaves"]) >= 2 for r in out.collect())
