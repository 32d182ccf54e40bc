"""Language ID: held-out accuracy and cases."""

import zlib

import numpy as np
import pytest

pytest.importorskip("markerlake.llm")
from markerlake.llm.language_id import Profiles, identify, learn, op6_language_id, predict  # noqa: E402


def test_profile_is_the_bound_bundle():
    p = Profiles(3, 64)
    want = np.zeros(64)
    from markerlake.llm.language_id import _letter_vector as v

    s = "_ab_c_"
    for i in range(len(s) - 2):
        w = np.ones(64)
        for k, c in enumerate(reversed(s[i : i + 3])):
            w = w * np.roll(v(0 if c == "_" else ord(c), 64), k)
        want += w
    assert np.array_equal(p.profile("Ab, C"), want.astype(np.float32))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = op6_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    test = out[out.held_out]
    assert len(out) == 1000 and (test.lang_pred == test.lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (4, "the then that", "en"), (5, "the then that", "en"), (8, "el que los", "es"), (9, "el los que ñ", "es"), (None, "the that", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score")
    got = {r.doc_id: r for r in identify(df).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[None].lang_pred == "en"
    none = predict(df, learn(df.filter("lang = 'xx'"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert identify(df.filter("doc_id = 77")).count() == 0


def test_pieces(monkeypatch):
    """Cut into pieces, with the vectors begun anew again and again, a text of several scripts has the same profile."""
    import markerlake.llm.language_id as m

    p, t = Profiles(3, 64), "abc dé,  fgh ЖЩИ 中文字 ..;" * 30 + "end"
    whole = p.profile(t)
    for size in (1, 7, 50):
        monkeypatch.setattr(m, "PIECE", size)
        monkeypatch.setattr(m, "CHUNK", 8)
        monkeypatch.setattr(m, "CACHE", 32)
        assert np.array_equal(Profiles(3, 64).profile(t), whole)


def test_plain_version(spark, sf):
    """The whole query against a loop over documents."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    p, unit = Profiles(), {}
    for i, t, _ in rows:
        if t and any(map(str.isalpha, t)):
            v = p.profile(t).astype(np.float64)
            unit[i] = v / np.linalg.norm(v)
    protos = {}
    for i, _, lang in rows:
        if lang is not None and i in unit and zlib.crc32(str(i).encode()) % 4 != 2:
            protos[lang] = protos.get(lang, 0) + unit[i]
    langs = sorted(protos)
    m = np.stack([protos[k] / np.linalg.norm(protos[k]) for k in langs])
    got = {r.doc_id: r for r in op6_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        cos = m @ unit[i] if i in unit else None
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if cos is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            assert abs(got[i].score - min(1, max(0, cos.max()))) < 1e-4
            assert got[i].lang_pred == langs[int(cos.argmax())] or np.sort(cos)[-1] - np.sort(cos)[-2] < 1e-4


def test_scripts(spark):
    """Languages of several scripts with many letters are told apart, and null lang throughout gives no model."""
    words = {"ru": "это язык который мы учим каждый день", "zh": "我们 每天 学习 这种 语言 的 文字", "ko": "우리는 매일 이 언어를 배웁니다", "el": "αυτή είναι η γλώσσα που μαθαίνουμε", "en": "this is the language that we learn"}
    rows = [(k * 10 + j, t, lang) for k, (lang, t) in enumerate(words.items()) for j in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang for r in identify(df).collect())
    assert learn(df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))["langs"] == []
