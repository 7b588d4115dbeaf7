"""What reaches the driver or one task when an id, a language or a page holds very many rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomolake.llm import language, toxicity, warc


@pytest.mark.parametrize("copies", [True, False])
def test_a_labelled_id_of_very_many_rows(spark, copies):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:2]
    text = F.lit("same text") if copies else F.concat(F.lit("text "), F.col("id"))
    docs = spark.range(200_000).select((F.element_at(F.lit(ids), (F.col("id") % 2 + 1).cast("int"))).cast("long").alias("doc_id"), text.alias("text"))
    labels = spark.createDataFrame([(i, k, k) for k, i in enumerate(ids)], "doc_id long, toxic int, quality int")
    got = toxicity.labelled_sample(docs, labels, "toxic", 10).collect()
    assert len(got) == (2 if copies else 20) and len({(r["doc_id"], r["text"]) for r in got}) == len(got)
    assert all(r["y"] == ids.index(r["doc_id"]) for r in got)


def test_labelled_texts_are_bounded_in_bytes(spark):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, "x" * (i + 1)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", 10**6, class_bytes=50_000, text_bytes=900).collect()
    for k in (0, 1):
        own = [len(r["text"]) for r in got if r["y"] == k]
        assert max(own) <= 900 and 40_000 < sum(own) <= 50_000


def test_very_many_languages(spark):
    rng = np.random.default_rng(2)
    letters = ["".join(map(chr, rng.permutation(26)[:6] + 97)) for _ in range(3000)]
    names = spark.createDataFrame(list(enumerate(letters)), "k long, own string")
    docs = spark.range(60_000).withColumn("k", F.col("id") % 3000).join(F.broadcast(names), "k").select(F.col("id").alias("doc_id"), F.concat_ws(" ", "own", F.col("id").cast("string"), "own").alias("text"), F.concat(F.lit("l"), F.col("k")).alias("lang"))
    model = language.fit(docs, most_languages=64, most_rows=1000)
    assert len(model.languages) == 64 and len(model.landmarks.sizes) <= 128
    few = language.fit(docs.where("doc_id % 3000 < 10"), most_languages=64, most_rows=1000)
    assert len(few.languages) == 10 and 10 <= len(few.landmarks.sizes) <= 128


@pytest.mark.parametrize("out", ["en", "de", "fr", "es"])
def test_a_language_that_was_not_learned_goes(spark, out):
    """Three languages learned: at least 90 % of the fourth's texts go and less than 1 % of the three's."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 0")
    model = spark.sparkContext.broadcast(language.fit(docs.where(F.col("lang") != out)))
    judged = docs.select("doc_id", "lang", F.pandas_udf(lambda x: __import__("pandas").Series(model.value.foreign(x.tolist())), "boolean")("text").alias("gone"))
    share = {r["own"]: r["share"] for r in judged.groupBy((F.col("lang") == out).alias("own")).agg(F.avg(F.col("gone").cast("int")).alias("share")).collect()}
    assert share[True] > 0.9 and share[False] < 0.01, share


def test_texts_of_other_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 0")
    model = language.fit(docs)
    words = ["ja on ei se että hän oli mutta kuin mikä niin tämä jos kun myös vain sitten nyt aika talo vesi maa päivä vuosi", "ve bir bu için ile çok daha ama gibi kadar olan var yok ben sen biz onlar ev su gün yıl insan hayat", "i w na z do nie się to jest że jak ale po co tak za od przez dla czy może być dom woda dzień"]
    rng = np.random.default_rng(1)
    for line in words:
        texts = [" ".join(rng.choice(line.split(), 40)) for _ in range(100)]
        assert model.foreign(texts).mean() > 0.95
    mine = [r["text"] for r in docs.limit(2000).collect()]
    assert model.foreign(mine).mean() < 0.005
    assert model.foreign(["", "12 -- 34"]).all()


def test_equal_pages_fill_many_shards(spark, tmp_path):
    pages = spark.range(20_000).select(F.lit(7).cast("long").alias("page_id"), F.lit("http://a/").alias("url"), F.lit("<p>same</p>").alias("html"))
    pages = pages.unionByName(spark.createDataFrame([(1, "http://b/", "<p>same</p>"), (9, "http://c/", "x")], "page_id long, url string, html string"))
    cut = warc.shards(pages, 1 << 18)
    manifest = warc.write_archive(pages, f"file://{tmp_path}/a", shard_bytes=1 << 18)
    per = [r["n"] for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()]
    assert cut.count > 30 and len(per) > 30 and max(per) < 1200 and sum(per) == 20_002
    back = warc.read_archive(manifest, f"file://{tmp_path}/a").cache()
    ids = [c for c in back.columns if "record_id" in c]
    assert back.count() == 20_002 == back.select(*ids).distinct().count() and back.where("NOT intact").isEmpty()
    assert {tuple(r) for r in back.groupBy("page_id", "record_type").count().collect()} == {(7, "response", 20_000), (1, "revisit", 1), (9, "response", 1)}


def test_an_archive_over_an_archive(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * i) for i in range(50)], "page_id long, url string, html string")
    for part in (pages, pages.where("page_id > 20"), pages):
        manifest = warc.write_archive(part, f"file://{tmp_path}/b")
        assert warc.read_archive(manifest, f"file://{tmp_path}/b").where("intact").count() == part.count()
