"""Near-dedup and components against brute force."""

import random

import numpy as np
import pytest

pytest.importorskip("markerlake.llm")
from markerlake.llm.components import components  # noqa: E402
from markerlake.llm.near_dedup import near_components, near_dedup, op4_near_dedup  # noqa: E402


def brute(rows, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (t or "").translate(low)).split(" ") if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    comp = {i: i for i, _ in rows if i is not None}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            if i is not None and j is not None and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)), key=repr)


def test_cases(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "One two"), (5, "one\ttwo"), (6, "one two three"), (7, "straße ÄÖ x y z"), (None, "one two"), (5, "one two")]
    base = [rnd.choices(words, k=120) for _ in range(8)]
    for i in range(120):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS kept")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_components(df, 4, ahead=2, crowd=3, wide=200).collect()), key=repr)
    assert got == brute(rows, 4, 80)
    out = near_dedup(df)
    assert out.columns == ["doc_id", "text", "component_id", "kept"] and out.count() == len(rows)
    assert near_components(df.filter("doc_id = -1")).count() == 0


def test_chain_and_star(spark):
    n = 300
    links = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(5000, 4000), (4000, 5000), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[1000 + i] == 1000 for i in range(n)) and got[5000] == 4000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op4_near_dedup(spark, sf).collect()), key=repr)
    assert got == brute(rows, 4, 80)


def test_dense_group(spark):
    """Edited versions of one long template, most pairs a little below the share: no link is missed by default."""
    rnd, n, size = random.Random(11), 1000, 400
    rows, whole, links = [], np.ones((n, size - 3), np.int64), []
    for i in range(n):
        w = [f"w{k}" for k in range(size)]
        for k in rnd.sample(range(size), 8):
            w[k] = f"e{i}_{k}"
            whole[i, max(0, k - 3) : k + 1] = 0
        rows.append((i, " ".join(w)))
    common = whole @ whole.T  # only shingles of the template are shared
    for i, j in np.argwhere(100 * common >= 80 * (2 * (size - 3) - common)):
        if i < j:
            links.append((int(i), int(j)))
    comp = list(range(n))
    for _ in range(n):
        old = list(comp)
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == old:
            break
    assert 100 < len(set(comp)) < n
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert [(r.doc_id, r.component_id) for r in got.collect() if r.component_id != comp[r.doc_id]] == []


def test_edited_copies(spark):
    """2,000 copies of one text with two to five words changed, mostly a little below the share: with the query's own
    parameters every document gets the component that all true links give."""
    rnd, n, size = random.Random(5), 2000, 200
    base = rnd.choices(range(5000), k=size)
    rows, seen, entries = [], {}, []
    for i in range(n):
        w = list(base)
        for k in rnd.sample(range(size), rnd.randint(2, 5)):
            w[k] = rnd.randrange(5000)
        rows.append((i, " ".join(f"v{x}" for x in w)))
        entries += [(i, seen.setdefault(tuple(w[k : k + 4]), len(seen))) for k in range(size - 3)]
    whole = np.zeros((n, len(seen)), np.float32)
    whole[tuple(np.array(entries).T)] = 1
    often = whole[:, whole.sum(0) > 1]
    common, sizes = often @ often.T, whole.sum(1)
    link = 100 * common >= 80 * (sizes[:, None] + sizes[None, :] - common)
    comp = np.arange(n)
    while True:
        new = np.where(link, comp[None, :], n).min(1)
        if (new == comp).all():
            break
        comp = new
    assert 10 < len(set(comp.tolist())) < n
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4)
    assert [(r.doc_id, r.component_id) for r in got.collect() if r.component_id != comp[r.doc_id]] == []
