"""Decontamination against SQL and by cases."""

import random

import pytest

pytest.importorskip("markerlake.llm")
from markerlake.llm.decontamination import OP9_SQL, contaminated, op9_decontamination  # noqa: E402

from .helpers import same_as_sql  # noqa: E402


def test_sql(spark):
    for d in ("sf0.001", "sf0.01"):
        same_as_sql(op9_decontamination(spark, f"/root/testdata/{d}"), OP9_SQL, f"/root/testdata/{d}")


def shingles(t):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (t or "").translate(low)).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_cases(spark):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([5, 6, 9, 20, 40, 70])))) for i in range(30)] + [(40, None), (41, ""), (42, "Two words"), (43, "two\twords"), (None, "x y z a b")]
    docs = [(100, None), (101, ""), (102, "TWO \n words"), (103, "two words more"), (None, items[0][1]), (104, "x y z a b")]
    for i in range(200):
        w = rnd.choices(words, k=rnd.randint(0, 200))
        t = rnd.choice(items[:30])[1].split()
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = "changed"
        k = rnd.randint(0, len(w))
        docs.append((i, " ".join(w[:k] + t + w[k:]).upper()))
    want = []
    for d, t in docs:
        for i, u in items:
            a, b = shingles(t), shingles(u)
            if None not in (d, i) and b and 100 * len(a & b) >= 80 * len(b):
                want.append((d, i, len(b), len(a & b)))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS s")
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in contaminated(df, bench).collect())
    assert got == sorted(want) and len(want) > 50
    assert contaminated(df.filter("doc_id < 0"), bench).count() == 0
    assert contaminated(df, bench.filter("item_id < 0")).count() == 0
