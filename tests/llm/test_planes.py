"""Plane files: exact round trips, and digests against the tokenizers library."""

import zlib

import numpy as np
import pytest

pytest.importorskip("markerlake.llm")
from markerlake.llm.planes import FileReader, FileWriter, op5_token_planes, read_digests, read_ids, write_ids  # noqa: E402
from markerlake.llm.registry import tokenizer_path  # noqa: E402
from markerlake.llm.shared import new_path  # noqa: E402


def want(rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, ids))
        start += len(ids)
    return out


def test_file():
    rnd = np.random.default_rng(4)
    docs = [(i, rnd.integers(0, 2**32, n, dtype=np.uint64).tolist()) for i, n in enumerate((0, 1, 15, 16, 17, 100, 0, 3))]
    w = FileWriter(16)
    for i, ids in docs:
        for k in range(0, len(ids), 7):
            w.add(ids[k : k + 7])
        w.close(None if i == 3 else i, 9)
    f = FileReader(w.bytes())
    assert f.doc_ids == [0, 1, 2, None, 4, 5, 6, 7]
    for d in (5, 0, 7, 3, 2, 1, 4, 6):
        assert np.concatenate(list(f.pieces(d))).tolist() == docs[d][1] + [9]
    with pytest.raises(ValueError):
        FileReader(b"x" * 40)


def test_cases(spark):
    rows = [(None, "null id"), (1, None), (2, ""), (3, "a b"), (3, "a b"), (7, "x" * 3000), (8, "<|endoftext|> it's")]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").selectExpr("*", "5 AS start")
    path = new_path(spark, "test")
    write_ids(df, path, tokenizer_path(), file_ids=20, block_ids=8)
    got = sorted(((r.doc_id, r.start, list(r.ids)) for r in read_ids(spark, path).collect()), key=lambda r: r[1])
    assert got == want(rows)
    empty = new_path(spark, "test")
    write_ids(df.filter("doc_id < 0"), empty, tokenizer_path())
    assert read_digests(spark, empty).count() == 0


def test_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op5_token_planes(spark, sf).collect()}
    for i, start, ids in want(rows):
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
