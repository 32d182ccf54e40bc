"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

pytest.importorskip("markerlake.llm")
from markerlake.llm.embedding_dedup import embedding_dedup, op7_embedding_dedup  # noqa: E402


def brute(rows):
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])]
    comp = {r[0]: r[0] for r in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    n = {}
    for x, (i, li, a) in enumerate(good):
        for y, (j, lj, b) in enumerate(good[:x]):
            if li == lj and len(a) == len(b):
                a1, b1 = np.array(a, float), np.array(b, float)
                if a1 @ b1 / np.linalg.norm(a1) / np.linalg.norm(b1) >= 0.98:
                    n[x], n[y] = n.get(x, 0) + 1, n.get(y, 0) + 1
                    p, q = root(i), root(j)
                    comp[max(p, q)] = min(p, q)
    place = {id(r): k for k, r in enumerate(good)}
    return sorted(((r[0], n.get(place.get(id(r)), 0), None if r[0] is None else root(r[0])) for r in rows), key=repr)


def test_cases(spark):
    rnd = np.random.default_rng(1)
    rows = []
    base = rnd.normal(size=(10, 8))
    for i in range(150):
        v = base[i % 10] + rnd.normal(size=8) * 0.12
        rows.append((i, int(i % 3), v.astype(np.float32).tolist()))
    same = rows[0][2]
    rows += [(200 + i, 0, same) for i in range(7)] + [(300, 1, same), (301, None, same), (302, 0, None), (303, 0, []), (304, 0, [0.0] * 8), (305, 0, [float("nan")] + [1.0] * 7), (306, 0, same[:7]), (307, 0, [None] + same[1:]), (None, 0, same)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    want = brute(rows)
    for more in ({}, {"block": 8}, {"per_pivot": 2}):
        got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup(df, **more).collect()), key=repr)
        assert got == want
    assert embedding_dedup(df.filter("vec_id = -1")).count() == 0


def test_table(spark, sf):
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in op7_embedding_dedup(spark, sf).collect()), key=repr)
    want = brute(rows)
    links = sum(n for _, n, _ in want)
    assert sum(n for _, n, _ in got) >= 0.9 * links
    assert got == want


def test_sizes_of_components(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for k, size in enumerate((1e300, 1e-300, 1.0)):
        v = rnd.normal(size=6)
        rows += [(10 * k + i, 0, (size * (v + rnd.normal(size=6) * 0.01)).tolist()) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df).collect()}
    assert got == {10 * k + i: (2, 10 * k) for k in range(3) for i in range(3)}


def test_recall_with_many_pivots(spark):
    """All the pivots that the bound allows for a far larger table, held against brute force."""
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(400, 32))
    v = np.repeat(base, 8, 0) + rnd.normal(size=(3200, 32)) * rnd.choice([0.03, 0.08, 0.12], 3200)[:, None]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup(df, per_pivot=1, root=60).collect()}
    assert want.sum() > 1000
    assert sum(got.values()) >= 0.9 * want.sum() and all(got[i] <= want[i] for i in got)
