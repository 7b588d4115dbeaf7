import random
import re
from hashlib import sha256

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_near_duplicates import closure, reference

from tomolake.llm import decontaminate, language, segment, simhash, toxicity

DOCS = "doc_id long, text string, n_hit string"


def words(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text) if w]


def brute(text, items):
    w, hit, seen = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(10, len(x))
        for s in range(len(x) - n + 1 if x else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[s : s + n]:
                    hit.update(range(p, p + n))
                    seen.add(i)
    return len(w), len(hit), len(seen), sha256(",".join(sorted(map(str, seen))).encode()).hexdigest(), bool(hit)


def test_against_brute_force(spark):
    rng = random.Random(4)
    pick = lambda n: [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)]
    items = [(i, " ".join(pick(n))) for i, n in enumerate([30, 12, 10, 9, 3, 25, 25])] + [(20, None), (21, "--"), (22, "Éa b-c"), (100, None)]
    items.append((9, items[0][1]))
    texts = [None, "", "?!", "É A", "x éA B c y"]
    for _ in range(60):
        t = pick(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            x = words(items[rng.randrange(7)][1])
            a = rng.randrange(len(x))
            at = rng.randrange(len(t) + 1)
            t[at:at] = x[a : a + rng.randrange(1, 20)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(t).upper() if rng.random() < 0.3 else " ".join(t))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute(t, items) for i, t in enumerate(texts)}
    assert sum(w[4] for w in want.values()) > 10
    for bound in (2_000_000, 0):
        got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(docs, bench, broadcast_words=bound).collect()}
        assert got == want
        kept = decontaminate.remove_contaminated(docs, bench, broadcast_words=bound)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[4]}
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").isEmpty()
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_items_without_an_id_hit(spark):
    long, short = " ".join(f"w{i}" for i in range(14)), "two words"
    bench = spark.createDataFrame([(None, long), (None, short), ((1 << 60) + 1, short)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {long} b", "x"), (2, f"a {short}", "x"), (3, "a b", "x")], DOCS)
    digest = lambda x: sha256(x.encode()).hexdigest()
    want = {(1, 16, 14, 0, digest(""), True), (2, 3, 2, 1, digest(str((1 << 60) + 1)), True), (3, 2, 0, 0, digest(""), False)}
    for bound in (2_000_000, 0):
        assert {tuple(r) for r in decontaminate.contamination(docs, bench, broadcast_words=bound).collect()} == want
        assert [r["doc_id"] for r in decontaminate.remove_contaminated(docs, bench, broadcast_words=bound).collect()] == [3]


def test_winnowing_shares_a_fingerprint():
    rng = random.Random(1)
    for _ in range(200):
        shared = [rng.getrandbits(60) for _ in range(10)]
        a = [rng.getrandbits(60) for _ in range(rng.randrange(30))] + shared + [rng.getrandbits(60)]
        b = shared + [rng.getrandbits(60) for _ in range(rng.randrange(30))]
        x, y = (set(decontaminate.winnow(decontaminate.np.array(s, decontaminate.np.uint64))[1].tolist()) for s in (a, b))
        assert x & y


def test_pipeline_stages(spark):
    """Each stage against its operator, on what the one before kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "segmentation"]
    f = dict(corpus_pipeline.STAGES)
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    one = f["toxicity"](spark, docs, DATA).cache()
    assert ids(one) == ids(toxicity.score_toxicity(docs, labels).where("predicted = 0")) and one.columns == docs.columns
    two = f["language"](spark, one, DATA).cache()
    assert ids(two) == ids(language.identify(one).where("lang_pred != 'und'"))
    three = f["near_duplicates"](spark, two, DATA).cache()
    found = simhash.near_duplicates(two).cache()
    assert ids(three) == {r["component"] for r in found.collect()} and three.columns == docs.columns
    four = f["decontamination"](spark, three, DATA).cache()
    assert ids(four) == ids(decontaminate.contamination(three, bench).where("NOT contaminated"))
    assert len(ids(four)) > 0.6 * len(ids(three))
    five = f["segmentation"](spark, four, DATA)
    assert ids(five) == ids(four) and five.where("NOT decoded_ok").isEmpty()
    assert five.columns == segment.digests(segment.sample_segmentations(docs.limit(0))).columns


def test_pipeline_against_plain_code(spark):
    """Raw rows through all five stages, row by row on the driver; only the two models are fitted by Spark."""
    sf = "/root/testdata/sf0.001"
    table = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    docs = table("documents")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    toxic = toxicity.fit(docs, table("labels"))
    rows = [r for r in rows if toxic.scores([r["text"] or ""])[0] < 0.5]
    tongues = language.fit(spark.createDataFrame(rows, docs.schema))
    rows = [r for r in rows if re.search(r"[^\W\d_]", r["text"] or "") and not tongues.foreign([r["text"]])[0]]
    prints = {r["doc_id"]: reference(r["text"]) for r in rows}
    root = closure(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    rows = [r for r in rows if root[r["doc_id"]] == r["doc_id"]]
    windows = {}
    for item in table("benchmark").collect():
        x = words(item["text"])
        n = min(10, len(x))
        windows.setdefault(n, set()).update(tuple(x[s : s + n]) for s in range(len(x) - n + 1 if x else 0))
    clean = lambda w: not any(tuple(w[p : p + n]) in found for n, found in windows.items() if n for p in range(len(w) - n + 1))
    want = {r["doc_id"] for r in rows if clean(words(r["text"]))}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == want and 100 < len(want) < docs.count()
    assert all(r["decoded_ok"] for r in out)
