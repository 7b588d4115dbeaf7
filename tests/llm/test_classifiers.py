import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from tests.conftest import DATA

from tomolake.llm import language, quality, toxicity

EDGE = [(1, None, "en", "a"), (2, "", "de", "b"), (3, "12 -- 34", None, "c"), (None, "hello there", "en", "d"), (5, "x" * 200_000, "en", "e"), (5, "x" * 200_000, "en", "e")]
DOCS = "doc_id long, text string, lang string, score string"


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def accuracy(scored, labels, label):
    hit = scored.where("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    return hit


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    assert accuracy(toxicity.score_toxicity(docs, labels), labels, "toxic") >= 0.85  # forty toxic texts to learn from
    assert accuracy(quality.score_quality(docs, labels), labels, "quality") >= 0.9
    found = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97


def test_gapped_and_inserted_insults():
    insults, words = ["grumblefax", "snorkwit", "blitherdop"], "river stone candle morning window garden paper silver forest market table cloud".split()
    texts, y = [], []
    for i in range(240):
        bad = i % 3 == 0
        body = [words[(i * 7 + j * 5) % 12] for j in range(9)] + ([insults[i // 3 % 3]] if bad else [])
        texts.append(" ".join(body))
        y.append(int(bad))
    model = toxicity.train(texts, toxicity.np.array(y))
    tests = ["the grumblefax river", "grum-ble-fax", "g r u m b l e f a x", "grumblexfax stone", "snorkkwit", "sn.ork.wit", "b l i t h e r d o p"]
    assert (model.scores(pa.array(tests)) >= 0.5).all()
    assert (model.scores(pa.array(["river candle forest", "", "12 34", "a b c d e", "markets windows"])) < 0.5).all()


def test_kernel_table_equals_landmark_kernels():
    k = toxicity.Kernel()
    words = [bytes(toxicity.symbols_of(w)[0]) for w in ("idiot", "stupid", "river", "stone", "idxiot")]
    triples = toxicity.triples_of(words, k)
    columns = toxicity.np.full(toxicity.SYMBOLS**3, len(triples))
    columns[triples] = toxicity.np.arange(len(triples))
    phi = toxicity.explicit(words, k, columns, len(triples))
    table = toxicity.np.zeros(toxicity.SYMBOLS**3)
    table[triples] = phi[0] * 2 - phi[2]
    w = toxicity.Words(pa.array(["idiot stupid river stone idxiot"]))
    got = toxicity.word_scores(w.sym, w.owner, w.n, table, k)
    assert toxicity.np.allclose(got, phi @ (phi[0] * 2 - phi[2]))


def test_edges(spark):
    docs, labels = tables(spark)
    edge, empty = spark.createDataFrame(EDGE, DOCS), spark.createDataFrame([], DOCS)
    none = labels.limit(0)
    for f in (toxicity.score_toxicity, quality.score_quality):
        assert f(edge, labels).count() == 6 and f(empty, none).count() == 0
        assert all(0 <= r["score"] <= 1 for r in f(edge, none).collect())
    assert toxicity.reject_toxic(edge, none).columns == edge.columns
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(edge).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got
    assert {r["doc_id"] for r in language.reject_unidentified(edge).collect()} == {None, 5}
    assert language.identify(empty).count() == 0 and {r["lang_pred"] for r in language.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_nothing_but_letterless_texts_goes_where_no_language_is_known(spark):
    docs = tables(spark)[0].limit(40).withColumn("lang", F.lit(None).cast("string"))
    blank = docs.limit(3).withColumns({"doc_id": -F.col("doc_id") - 1, "text": F.lit("12 -- 34")})
    part = docs.unionByName(blank).cache()
    assert {r["doc_id"] for r in language.reject_unidentified(part).collect()} == {r["doc_id"] for r in docs.where(F.col("text").rlike("\\p{L}")).collect()}
    held = part.withColumn("lang", F.when(language.held_out(), "en"))
    assert language.reject_unidentified(held).count() == language.reject_unidentified(part).count() > 30


def test_every_language_is_sampled(spark):
    docs = spark.range(13_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id) AS lang")
    got = {r["lang"] for r in language.sample(docs, 1, 1).collect()}
    assert got == {r["lang"] for r in docs.where(language.fold() != 0).collect()} and len(got) > 10_000


def test_scores_do_not_read_ids_or_labels(spark):
    docs, labels = tables(spark)
    part = docs.limit(50)
    model = toxicity.fit(docs, labels)
    texts = [r["text"] for r in part.collect()]
    a = model.scores(pa.array(texts))
    other = labels.withColumn("toxic", F.when(language.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = part.withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    for f in (toxicity.score_toxicity, quality.score_quality):  # held-out labels, lang and source change nothing
        one, two = (sorted((r["doc_id"], r["score"]) for r in f(d, y).where("held_out").collect()) for d, y in ((docs, labels), (moved.unionByName(docs.join(part, "doc_id", "left_anti")), other)))
        assert one == two
    b = toxicity.np.concatenate([model.scores(pa.array([t])) for t in texts])
    assert toxicity.np.allclose(a, b)  # whatever texts share the block


def test_subsequence_kernel_against_enumeration():
    k, decay, reach = toxicity.Kernel(), 0.6, 7
    words = ["idiot", "idxiot", "iddiot", "river", "mississippi", "ab", "abcabcabc"]

    def weights(w):
        out = {}
        for i, j, m in itertools.combinations(range(len(w)), 3):
            if m - i + 1 <= reach:
                key = w[i] + w[j] + w[m]
                out[key] = out.get(key, 0.0) + decay ** (m - i + 1)
        return out

    def norm(n):  # of a word of n different letters
        return max(1e-12, sum(decay ** (2 * (m - i + 1)) for i, _, m in itertools.combinations(range(n), 3) if m - i + 1 <= reach)) ** 0.5

    plain = np.array([[sum(x * weights(b).get(t, 0.0) for t, x in weights(a).items()) / norm(len(a)) / norm(len(b)) for b in words] for a in words])
    names = [bytes(toxicity.symbols_of(w)[0]) for w in words]
    triples = toxicity.triples_of(names, k)
    columns = np.full(toxicity.SYMBOLS**3, len(triples))
    columns[triples] = np.arange(len(triples))
    phi = toxicity.explicit(names, k, columns, len(triples))
    # The library's decay counts letters skipped and taken after the first: one power less than the span on either side.
    scale = (phi @ phi.T)[0, 0] / plain[0, 0]
    assert np.allclose(phi @ phi.T, plain * scale) and plain[0, 1] > 0.3 * plain[0, 0] > plain[0, 3]


def test_presence_kernel_against_sets():
    texts = ["Hello world", "hello, there!", "ich gehe nach Hause", "12 ab", "zzz", "été à Paris", "a"]

    def grams(text):
        c = [0, *(int(language.classes()[ord(x)]) for x in text), 0]
        c = [x for i, x in enumerate(c) if i == 0 or x or c[i - 1]]
        return {tuple(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1)}

    marks = language.landmarks_of(texts[:4])
    got, lettered = marks.kernel(texts)
    want = [[len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5 for b in texts[:4]] for a in texts]
    assert np.allclose(got, want, atol=1e-6) and lettered.all()


def test_ridge_against_least_squares():
    rng = np.random.default_rng(3)
    words = {"en": "the and of with hello there".split(), "de": "der und mit nicht schon hier".split(), "fr": "le et avec pas encore ici".split()}
    rows = [(lang, " ".join(rng.choice(w, 6))) for lang, w in words.items() for _ in range(20 if lang == "en" else 12)]
    marks = language.landmarks_of([t for _, t in rows[::5]])
    x, _ = marks.kernel([t for _, t in rows])
    x, ridge = x.astype(float), 1e-2
    model = language.ridge_model(x, [lang for lang, _ in rows], marks, ridge)
    own = marks.matrix.T.astype(float) @ marks.matrix.astype(float)
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values.max()
    phi = x @ (vectors[:, good] / np.sqrt(values[good]))
    share = np.array([1 / sum(b == a for b, _ in rows) for a, _ in rows]) / 3
    for i, lang in enumerate(sorted(words)):
        y = np.where([a == lang for a, _ in rows], 1.0, -1.0)
        a = np.sqrt(share)[:, None] * np.hstack([phi, np.ones((len(rows), 1))])
        a = np.vstack([a, np.hstack([np.sqrt(ridge / 3 * 1e-2) * np.eye(phi.shape[1]), np.zeros((phi.shape[1], 1))])])
        u = np.linalg.lstsq(a, np.concatenate((np.sqrt(share) * y, np.zeros(phi.shape[1]))), rcond=None)[0]
        assert np.allclose(x @ model.weights[:, i] + model.constants[i], phi @ u[:-1] + u[-1], atol=1e-6)
    assert model.predict([t for _, t in rows])[0] == [lang for lang, _ in rows]


def test_texts_of_no_learned_language_go(spark):
    rng = np.random.default_rng(5)
    words = {"en": "the and of with hello there".split(), "de": "der und mit nicht schon hier".split(), "fr": "le et avec pas encore ici".split(), None: "\u0440\u0435\u043a\u0430 \u043a\u0430\u043c\u0435\u043d\u044c \u043d\u043e\u0447\u044c \u0434\u043e\u043c".split()}
    rows = [(i, " ".join(rng.choice(w, 8)), lang, "x") for i, (lang, w) in enumerate((lang, w) for lang, w in words.items() for _ in range(30))]
    kept = language.reject_unidentified(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"] for r in kept} == {i for i, _, lang, _ in rows if lang}


def test_quality_is_the_compressed_difference_alone(spark):
    docs, labels = tables(spark)
    model = quality.fit(docs, labels)
    texts = [(r["text"] or "").encode() for r in docs.limit(400).collect()] + [b""]
    good, bad = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad))
    plain = []
    for x in texts:
        cut = [x[i : i + 256] for i in range(0, len(x), 256)]
        saved = sum(len(bad.compress(c)) - len(good.compress(c)) for c in cut)
        plain.append((saved + model.lead * model.usual) / (len(x) + model.lead))
    score = model.scores(texts, quality.Sizes(model.good, model.bad))
    assert np.allclose(score, 1 / (1 + np.exp(-np.clip(model.slope * np.array(plain) + model.offset, -30, 30))))
    assert model.slope > 0 and (np.diff(score[np.argsort(plain, kind="stable")]) >= 0).all()
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs.limit(400), labels).collect()}
    assert len(got) == 400 and all(0 <= x <= 1 for x in got.values())
