"""The pipeline against a plain version of its stages."""

import hashlib

import pytest

pytest.importorskip("markerlake.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from markerlake.llm.registry import tokenizer_path  # noqa: E402

from .test_decontamination import shingles  # noqa: E402
from .test_line_dedup import plain  # noqa: E402
from .test_near_dedup import brute  # noqa: E402


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_run(spark, sf):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    rows = [(i, t) for i, _, _, t in plain(rows)]
    stay = {i for i, _, c in brute(rows, 5, 80) if i == c}
    rows = [(i, t) for i, t in rows if i in stay]
    rows = [(i, t) for i, t in rows if not any(b and 100 * len(shingles(t) & b) >= 80 * len(b) for b in items)]
    want = {}
    for i, t in rows:
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(t))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < 200


def test_stages_keep_columns_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        assert name == "bpe" or out.columns == docs.columns


def test_released_gives_the_same_batches_even_where_they_stop_early():
    from markerlake.llm.shared import released

    assert list(released(lambda batches: (2 * b for b in batches))([1, 2, 3])) == [2, 4, 6]
    some = released(iter)([1, 2])
    assert next(some) == 1
    some.close()
    assert list(released(iter)([])) == []
