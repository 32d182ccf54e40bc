"""Quality: held-out accuracy and cases."""

import pytest

pytest.importorskip("markerlake.llm")
from markerlake.llm.quality import learn, op3_quality, score  # noqa: E402


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return sum((p > neg).sum() + 0.5 * (p == neg).sum() for p in pos) / (len(pos) * len(neg))


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    out = op3_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    test = out[out.held_out]
    a, acc = auc(test.quality.values, test.score.values), (test.predicted == test.quality).mean()
    print("auc", a, "accuracy", acc, "share", test.quality.mean(), len(test))
    assert a > 0.9 and acc > 0.9
    assert out.score.between(0, 1).all()


def test_cases(spark):
    docs = spark.createDataFrame([(1, "good words here", 5), (2, None, 6), (3, "", 7), (3, "x" * 10_000, 8), (None, "bad", 9)], "doc_id long, text string, score int")
    none = learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in score(docs, none).collect()} == {0.5}
    one = learn(docs, spark.createDataFrame([(1, 1), (3, 1), (3, 0), (2, None)], "doc_id long, quality int"))
    assert {r.predicted for r in score(docs, one).collect()} == {1}
    assert score(docs.filter("doc_id = 9"), none).count() == 0


def test_model_is_the_same_in_any_order(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.select("doc_id", "text").unionByName(docs.selectExpr("doc_id", "concat(text, ' again') AS text"))
    models = [learn(d, labels, max_rows=300, max_bytes=150_000) for d in (twice, twice.repartition(7).orderBy("text"))]
    assert models[0]["dictionaries"] and models[0] == models[1]
