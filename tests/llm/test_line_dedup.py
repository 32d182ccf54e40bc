"""Line dedup against a plain version."""

import pytest

pytest.importorskip("markerlake.llm")
from pyspark.sql import functions as F  # noqa: E402

from markerlake.llm.line_dedup import LineRuns, OP1_SQL, _sorted_scans, line_dedup, op1_line_dedup  # noqa: E402

from .helpers import same_as_sql  # noqa: E402

LONG = "x" * 40


def plain(rows, min_chars=40, min_docs=5):
    space = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(space).translate(low)
    held = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= min_chars:
                    held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in held or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_cases(spark):
    rows = [(i, f"own line {i}\n  {LONG.upper()}\t\nshort") for i in range(6)]
    rows += [(6, None), (7, ""), (8, LONG + "\n" + LONG), (8, LONG + "\nmore"), (None, LONG), (9, "é" * 39), (10, "\n\n")]
    rows += [(20 + i, "é" * 40 + "\n" + "y" * 41) for i in range(5)] + [(30 + i, "z" * 50) for i in range(4)] + [(40, "w" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup(df).collect()), key=repr)
    assert got == plain(rows)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup(df, batches=5, fanout=3).collect()), key=repr) == plain(rows)


def test_empty(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql(spark, sf):
    same_as_sql(op1_line_dedup(spark, sf), OP1_SQL, sf)


def test_runs(spark):
    """A key is fresh in one batch only; neither the anti-join's runs nor a compaction are shuffled or sorted."""
    runs = LineRuns(spark, fanout=3)
    batches = [[(1, 1, 1), (2, 1, 1), (1, 2, 2)], [(5, 1, 1), (6, 3, 3)], [(7, 3, 3), (8, 1, 1), (9, 4, 4)]]
    lines = [spark.createDataFrame(b, "doc_id long, h1 long, h2 long") for b in batches]
    try:
        runs.add(lines[0])
        runs.add(lines[1])
        one, two = runs.runs()
        assert sorted(map(tuple, one.collect())) == [(1, 1, 2, 2), (2, 2, 1, 1)] and [tuple(r) for r in two.collect()] == [(3, 3, 1, 6)]
        with _sorted_scans(spark):
            counted = lines[2].groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
            marked, merged = runs.marked(counted), runs.merged(one, two)
            plans = [df._jdf.queryExecution().executedPlan().toString() for df in (marked, merged)]
        assert plans[0].count("Exchange") == 1 and plans[0].count("Sort [") <= 1 and plans[0].count("SortMergeJoin") == 2
        assert "Exchange" not in plans[1] and "Sort [" not in plans[1] and "SortMergeJoin" in plans[1]
        assert {r.h1: r.fresh for r in marked.collect()} == {1: False, 3: False, 4: True}
        runs.add(lines[2])
        assert [len(level) for level in runs.levels] == [0, 1]
        assert sorted(map(tuple, runs.repeated(2).collect())) == [(1, 1, 8), (3, 3, 7)]
        assert sorted(r.h1 for r in runs.runs()[0].collect()) == [1, 2, 3, 4]
    finally:
        runs.clear()
