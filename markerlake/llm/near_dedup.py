"""MinHash near-dedup by an LSH forest.

Each document's set of word shingles gets a MinHash signature. Documents with equal sets are one class, and its
smallest id stands for it. Every tree orders the classes by another run of signature values. A first look takes, in
a few trees, the next `ahead` neighbours whose longest common prefix has at least `least_prefix` values; it only saves
work. Then all trees are searched whole: every run of classes with an equal prefix of `least_prefix` values that holds
several components is a place where links may be left. What comes next depends on how crowded the region is:

* a run of fewer than `crowd` classes gives its pairs of unlike components as candidates, but for those whose
  signatures agree on so few values that a pair at the share asked for has a chance below `MISS` of it;
* longer runs, and those that a partition's border cuts, join their classes to regions (runs with a class in common
  are one region). A region's classes are dealt into blocks of at most `wide` classes and about as many shingles; each
  pair of blocks that holds several components is one group, which counts the common shingles of all its classes at
  once as a product of matrices. Only a spanning tree of the links that it finds leaves a group.

So no pair of a crowded region is ever a row, no task holds a region, and a set travels once for each pair of blocks.
All links are verified on full sets; they give components, contracted in rounds over written tables.

Cases: a text with fewer words than a shingle has one shingle, its whole sequence; null text, empty text and text
without words have none and link with nothing; equal sets are linked; rows with a null id link with nothing and
have no component; rows that repeat an id are one node, linked by what any of them holds; a text of any length
enters with its whole set; columns called n_shingles, component_id or kept are replaced, others kept.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .hashing import MinHash, shingles, word_hashes
from .shared import broadcast_if_small, released, shuffle_partitions, small_batches, table, written

SIZE, DEPTH = 128, 12
FIRST, MISS, BLOCK = 8, 1e-9, 128
PAIR, ROW, EDGE = range(3)
#: Shingles a block; products up to which a hash goes pair by pair; columns or entries at a time.
WEIGHT, RARE, STEP = 1 << 17, 256, 4096


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, sig): size and 128-bit hash of the shingle set, and its signature."""

    def run(batches):
        minhash = MinHash(SIZE)
        for b in batches:
            n, s1, s2, sig = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(word_hashes(t), words)
                n.append(len(s))
                h = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                s1.append(h and int.from_bytes(h[:8], "little", signed=True))
                s2.append(h and int.from_bytes(h[8:], "little", signed=True))
                sig.append(minhash.signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, s1, s2)), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def _orders(reps: DataFrame, trees: int, depth: int, some: range, *more: str) -> DataFrame:
    """Rows (doc_id, t, key, *more) of some of the trees, sorted by (t, key, *more) within partitions dealt by range."""
    step = max(1, SIZE // trees)
    twice = F.concat("sig", "sig")
    keys = F.array(*(F.struct(F.lit(t).cast("short").alias("t"), F.substring(twice, 2 * (t * step % SIZE) + 1, 2 * depth).alias("key")) for t in some))
    rows = reps.select("doc_id", F.explode(keys).alias("k"), *more).select("doc_id", "k.t", "k.key", *more)
    by = ("t", "key", *more, "doc_id")
    return rows.repartitionByRange(shuffle_partitions(reps.sparkSession), *by).sortWithinPartitions(*by)


def _neighbours(batches, ahead: int, least_prefix: int):
    """Batches of (a, b) from sorted rows: pairs whose components differ."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column("doc_id").to_numpy(), b.column("t").to_numpy(), _values(b.column("key"), DEPTH), b.column("component").to_numpy()]
        old = 0 if last is None else len(last[0])
        rows = new if last is None else [np.concatenate(x) for x in zip(last, new)]
        ids, t, key, component = rows
        found = []
        for k in range(1, min(ahead + 1, len(ids))):
            lo = max(0, old - k)  # pairs within the carried rows are out already
            x = np.arange(lo, len(ids) - k)
            x = x[(t[x + k] == t[x]) & (component[x + k] != component[x]) & (key[x + k, :least_prefix] == key[x, :least_prefix]).all(1)]
            found.append(np.stack((ids[x], ids[x + k])))
        if found:
            pair = np.sort(np.concatenate(found, 1), 0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])
        last = [v[-ahead:] for v in rows]


def _values(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, width)


def forest_candidates(reps: DataFrame, trees: int, some: range, ahead: int, least_prefix: int) -> DataFrame:
    """(a, b) with a < b: neighbours in the order of some trees, each pair once. reps: (doc_id, sig, component)."""

    def run(batches):
        yield from _neighbours(batches, ahead, least_prefix)

    # The key comes before the component in the order: neighbours are those of the longest prefix.
    return _orders(reps, trees, DEPTH, some, "component").mapInArrow(released(run), "a long, b long").filter("a < b").distinct()


def _least_agreeing(share: float) -> int:
    """The most values for which a pair at the share agrees on fewer with a chance of at most MISS."""
    chance = 0.0
    for k in range(SIZE):
        chance += comb(SIZE, k) * share**k * (1 - share) ** (SIZE - k)
        if chance > MISS:
            return k
    return SIZE


def _groups(batches, names: list[str]):
    """Tables of whole groups, rows of equal names that follow each other, from sorted batches."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        new = pa.Table.from_batches([b])
        rows = new if held is None else pa.concat_tables([held, new])
        key = [rows.column(n).to_numpy() for n in names]
        same = np.logical_and.reduce([k == k[-1] for k in key])
        start = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if start:
            yield rows.slice(0, start)
        held = rows.slice(start)
    if held is not None:
        yield held


def _runs(batches, crowd: int):
    """From sorted rows (t, key, component, doc_id): (kind, a, b, c, t, key) of runs with equal (t, key) and several
    components. PAIR: ids a < b of a short run. ROW: id a, component b, and the least component c of its run.
    EDGE: the least component c of a run (t, key) that a partition's border cuts; its rows are ROWs at any length."""
    held, first = None, True

    def pairs(ids, component):
        i, j = np.triu_indices(len(ids), 1)
        apart = (component[i] != component[j]) & (ids[i] != ids[j])
        return np.sort(np.stack((ids[i[apart]], ids[j[apart]])), 0)

    def found(rows: pa.Table, inner: bool, last: bool):
        nonlocal first
        t, ids, component = (rows.column(n).to_numpy() for n in ("t", "doc_id", "component"))
        key = np.array(rows.column("key").to_pylist(), object)
        at = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.append(0, at), np.append(at, len(t))
        mixed = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
        cut = np.zeros(len(starts), bool)
        cut[0], cut[-1] = first, last
        first = False
        out = [np.empty((4, 0), np.int64)]
        edges: list[tuple] = []
        for k in np.flatnonzero(mixed | cut):
            one = slice(starts[k], ends[k])
            n, low = ends[k] - starts[k], component[one].min()
            if cut[k]:
                edges.append((int(low), int(t[starts[k]]), key[starts[k]]))
            if cut[k] or n >= crowd:
                out.append(np.stack((np.full(n, ROW), ids[one], component[one], np.full(n, low))))
            else:
                p = pairs(ids[one], component[one])
                out.append(np.stack((np.full(p.shape[1], PAIR), *p, p[0])))
        kind, x, y, z = np.concatenate(out, 1)
        m, e = len(kind), len(edges)
        low, where, what = zip(*edges) if e else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(kind, np.full(e, EDGE)), pa.int64()), *(pa.array(np.append(v, np.array(low, np.int64)), pa.int64()) for v in (x, y, z)),
                pa.array([None] * m + list(where), pa.int16()), pa.array([None] * m + list(what), pa.binary()),
            ],
            names=["kind", "a", "b", "c", "t", "key"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t, key = rows.column("t"), rows.column("key")
        same = pc.and_(pc.equal(t, t[-1]), pc.equal(key, key[-1])).to_numpy()
        start = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if start:  # the last run may go on
            yield from found(rows.slice(0, start), True, False)
        held = rows.slice(start)
    if held is not None:
        yield from found(held, False, True)


def crowded_places(reps: DataFrame, trees: int, crowd: int, least_prefix: int) -> DataFrame:
    """The rows of `_runs` over all trees. reps: (doc_id, sig, component)."""

    def run(batches):
        yield from _runs(batches, crowd)

    rows = _orders(reps, trees, least_prefix, range(trees), "component")
    return rows.mapInArrow(released(run), "kind long, a long, b long, c long, t short, key binary")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree on enough values."""
    least = _least_agreeing(percent / 100)

    def run(batches):
        for b in batches:
            near = (_values(b.column("x"), SIZE) == _values(b.column("y"), SIZE)).sum(1) >= least
            yield pa.RecordBatch.from_arrays([b.column(n).filter(pa.array(near)) for n in "ab"], names=["a", "b"])

    x, y = (reps.select(F.col("doc_id").alias(i), F.col("sig").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(released(run), "a long, b long").distinct()


def _common(x: list[np.ndarray], y: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of the sets of x with those of y (of x with each other): rare hashes pair by pair,
    frequent ones as a product of 0/1 matrices."""

    def by_column(sets):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return *np.unique(flat, return_inverse=True, return_counts=True), row

    ux, ix, nx, rx = by_column(x)
    uy, iy, ny, ry = by_column(y) if y is not None else (ux, ix, nx, rx)
    cx, cy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)[1:] if y is not None else (np.flatnonzero(nx > 1),) * 2
    p, q = nx[cx], ny[cy]
    h, w = len(x), len(y if y is not None else x)
    out = np.zeros(h * w, np.int32)

    def entries(columns, inverse, row, chosen):
        """Rows of the entries of the chosen columns, sorted by column."""
        place = np.full(columns, -1)
        place[chosen] = np.arange(len(chosen))
        at = place[inverse]
        kept = np.flatnonzero(at >= 0)
        order = kept[np.argsort(at[kept], kind="stable")]
        return row[order], at[order]

    rare = p * q <= RARE
    (ex, kx), (ey, _) = entries(len(ux), ix, rx, cx[rare]), entries(len(uy), iy, ry, cy[rare])
    n = q[rare]
    first = np.cumsum(n) - n
    for k in range(0, len(ex), STEP):
        many = n[kx[k : k + STEP]]
        at = np.repeat(first[kx[k : k + STEP]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        out += np.bincount(np.repeat(ex[k : k + STEP], many) * w + ey[at], minlength=h * w).astype(np.int32)
    out = out.reshape(h, w)
    often = np.flatnonzero(~rare)
    for k in range(0, len(often), STEP):
        some = often[k : k + STEP]
        sides = []
        for size, columns, inverse, row, chosen in ((h, len(ux), ix, rx, cx[some]), (w, len(uy), iy, ry, cy[some])):
            e, c = entries(columns, inverse, row, chosen)
            m = np.zeros((size, len(some)), np.float32)
            m[e, c] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int32)  # exact: below 2 ** 24
    return out


def _region_links(batches, percent: int):
    """Batches of (a, b) from rows (x, y, block, cluster, component, doc_id, s) sorted by (x, y): within each pair of
    blocks every id that links reach from a smaller one, and the smallest such."""
    for rows in _groups(batches, ["x", "y"]):
        x, y, block, cluster, component, ids = (rows.column(n).to_numpy() for n in ("x", "y", "block", "cluster", "component", "doc_id"))
        flat = rows.column("s").combine_chunks()
        edges = np.append(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, len(x))
        start = 0
        for end in edges:
            own = np.arange(start, end)
            start = end
            left, right = own[block[own] == x[own[0]]], own[block[own] == y[own[0]]]
            sets = {i: flat[i].values.to_numpy() for i in own.tolist()}
            n = lambda side: np.array([len(sets[i]) for i in side.tolist()])
            alone = x[own[0]] == y[own[0]]
            common = _common([sets[i] for i in left.tolist()], None if alone else [sets[i] for i in right.tolist()])
            linked = 100 * common >= percent * (n(left)[:, None] + n(right)[None, :] - common)
            linked &= (component[left][:, None] != component[right][None, :]) & (cluster[left][:, None] == cluster[right][None, :])
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            i, j = left[i], right[j]
            low = ids.copy()
            while True:
                old = low.copy()
                np.minimum.at(low, i, low[j])
                np.minimum.at(low, j, low[i])
                if (low == old).all():
                    break
            moved = own[low[own] != ids[own]]
            yield pa.RecordBatch.from_arrays([pa.array(low[moved]), pa.array(ids[moved])], names=["a", "b"])


def _placed(batches, wide: int):
    """Sorted rows (cluster, component, doc_id, s) with their partition and the weight of its rows before them."""
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        weight = np.maximum(pc.list_value_length(b.column("s")).to_numpy(zero_copy_only=False).astype(np.int64), WEIGHT // wide)
        total = before + np.cumsum(weight)
        columns = [pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(total - weight), pa.array(weight)]
        yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=["cluster", "component", "doc_id", "s", "part", "before", "weight"])
        before = int(total[-1]) if b.num_rows else before


def region_links(docs: DataFrame, places: DataFrame, words: int, percent: int, wide: int) -> DataFrame:
    """(a, b): links between the components that meet in crowded places, a tree of them for each pair of blocks."""
    spark = docs.sparkSession
    rows = places.filter(F.col("kind") == ROW)
    cut = written(places.filter(F.col("kind") == EDGE).select("t", "key", "c"), "near-cut")  # two a partition at most
    over = cut.groupBy("t", "key").agg(F.min("c").alias("low"))
    over = cut.join(F.broadcast(over), ["t", "key"]).select(F.col("c").alias("a"), F.col("low").alias("b"))
    meet = rows.select(F.col("b").alias("a"), F.col("c").alias("b")).unionByName(over)
    clusters = components(meet)
    several = broadcast_if_small(clusters.select(F.col("id").alias("b"), F.col("component").alias("cluster")), clusters.count())
    members = written(rows.select("a", "b").distinct().join(several, "b").select(F.col("a").alias("doc_id"), F.col("b").alias("component"), "cluster"), "near-members")
    held = sets_of(docs, members.select("doc_id"), members.count(), words)
    parts = shuffle_partitions(spark)
    by = ("cluster", "component", "doc_id")
    ordered = members.join(held, "doc_id").select(*by, "s").repartitionByRange(parts, *by).sortWithinPartitions(*by)

    def place(batches):
        yield from _placed(batches, wide)

    def run(batches):
        yield from _region_links(batches, percent)

    placed = written(ordered.mapInArrow(place, "cluster long, component long, doc_id long, s array<long>, part int, before long, weight long"), "near-placed")
    offsets, total = [], 0
    for part, weight in sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.sum("weight").alias("n")).collect()):  # a row a partition
        offsets.append((part, total))
        total += weight
    starts = spark.createDataFrame(offsets, "part int, start long")
    block = F.floor((F.col("start") + F.col("before")) / WEIGHT)
    dealt = placed.join(F.broadcast(starts), "part").select(block.alias("block"), *by, "s")  # a row a partition
    spans = written(dealt.groupBy("cluster", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi")), "near-spans")
    left, right = (spans.select("cluster", *(F.col(c).alias(f"{c}{e}") for c in ("block", "lo", "hi"))) for e in "xy")
    both = left.join(right, "cluster").filter("blockx <= blocky AND NOT (lox = hix AND loy = hiy AND lox = loy)")
    both = both.select(F.col("blockx").alias("x"), F.col("blocky").alias("y")).distinct()
    each = written(both.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block")), "near-block-pairs")
    rows = dealt.join(broadcast_if_small(each, each.count()), "block").repartition(parts, "x", "y").sortWithinPartitions("x", "y")
    return rows.select("x", "y", "block", *by, "s").mapInArrow(released(run), "a long, b long").distinct()


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingle set as sorted 64-bit hashes)."""

    def run(batches):
        for b in batches:
            sets = [shingles(word_hashes(t), words).view(np.int64) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "s"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, s array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, n: int, words: int) -> DataFrame:
    """The sets of the n documents whose ids are the one column of ids, as a written table."""
    named = broadcast_if_small(ids.toDF("_i"), n)
    return written(shingle_sets(docs.join(named, F.col("doc_id").cast("long") == F.col("_i"), "left_semi"), words), "near-sets")


def _numbered(batches):
    """(id, block): rows in order, BLOCK of them a block."""
    block, n = TaskContext.get().partitionId() << 40, 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(block + (n + np.arange(b.num_rows)) // BLOCK)], names=["id", "block"])
        n += b.num_rows


def _linked(batches, percent: int):
    """Batches of linked (a, b) from rows sorted by (x, y, b): sets (b null) before the pairs of the blocks."""
    for rows in _groups(batches, ["x", "y"]):
        sets, linked, last = {}, [], None
        flat, b = rows.column("s").combine_chunks(), rows.column("b").to_pylist()
        for k, (x, y, i) in enumerate(zip(*(rows.column(n).to_pylist() for n in "xya"))):
            if (x, y) != last:
                sets, last = {}, (x, y)
            if b[k] is None:
                sets.setdefault(i, []).append(flat[k].values.to_numpy())
                continue
            for p in sets.get(i, ()):
                for q in sets.get(b[k], ()):
                    n, m = len(p), len(q)
                    if 100 * min(n, m) >= percent * max(n, m):
                        z = np.concatenate((p, q))
                        z.sort(kind="stable")
                        common = int((z[1:] == z[:-1]).sum())
                        if 100 * common >= percent * (n + m - common):
                            linked.append((i, b[k]))
        if linked:
            a, b = zip(*linked)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. Ids are numbered in blocks, those with a common least
    neighbour side by side; the sets of a pair of blocks come to its pairs once, however many these are."""

    def run(batches):
        yield from _linked(batches, percent)

    parts = shuffle_partitions(docs.sparkSession)
    ends = pairs.select(F.col("a").alias("id"), "a").unionAll(pairs.select(F.col("b").alias("id"), "a"))
    near = ends.groupBy("id").agg(F.min("a").alias("near"))
    ids = written(near.repartitionByRange(parts, "near", "id").sortWithinPartitions("near", "id").select("id").mapInArrow(_numbered, "id long, block long"), "near-ids")
    n = ids.count()
    sets = sets_of(docs, ids.select("id"), n, words)
    x, y = (broadcast_if_small(ids.select(F.col("id").alias(e), F.col("block").alias(c)), n) for e, c in ("ax", "by"))
    dealt = written(pairs.join(x, "a").join(y, "b").select("x", "y", "a", "b"), "near-dealt")
    need = dealt.select("x", "y", F.col("a").alias("doc_id")).unionAll(dealt.select("x", "y", F.col("b").alias("doc_id"))).distinct()
    rows = need.join(sets, "doc_id").select("x", "y", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "s")
    rows = rows.unionByName(dealt.withColumn("s", F.lit(None).cast("array<long>")))
    rows = rows.repartition(parts, "x", "y").sortWithinPartitions("x", "y", F.col("b").asc_nulls_first())
    return rows.mapInArrow(released(run), "a long, b long").distinct()


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, **forest: int) -> DataFrame:
    """docs with n_shingles, component_id and kept. Texts are read twice: for the signatures, and for the sets of
    candidates."""
    keep = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    found = near_components(docs, words, percent, **forest)
    if keep == ["doc_id"]:
        return found
    one = found.groupBy(F.col("doc_id").alias("_i")).agg(F.first("component_id").alias("component_id"))
    sized = docs.select(*keep).join(one, F.col("doc_id").cast("long") == F.col("_i"), "left").drop("_i")
    return sized.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 32, ahead: int = 1, least_prefix: int = 3, crowd: int = 8, wide: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    small_batches(docs.sparkSession)
    rows = written(signatures(docs, words), "near-signatures")
    solid = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = written(solid.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "near-copies")
    n = copies.count()
    in_class = rows.join(broadcast_if_small(copies, n), ["s1", "s2"], "left").withColumn("rep", F.when(F.expr("n_shingles > 0 AND doc_id IS NOT NULL"), F.coalesce("rep", "doc_id")))
    reps = in_class.filter("doc_id = rep").select("doc_id", "sig")
    pairs = written(forest_candidates(reps.withColumn("component", F.col("doc_id")), trees, range(min(FIRST, trees)), ahead, least_prefix), "near-pairs")
    links = written(verified(docs, pairs, words, percent), "near-links")
    so_far = components(links)
    found = so_far.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
    now = reps.join(broadcast_if_small(found, found.count()), F.col("doc_id") == F.col("_i"), "left").select("doc_id", "sig", F.coalesce("_c", "doc_id").alias("component"))
    places = written(crowded_places(now, trees, crowd, least_prefix), "near-places")
    more = written(region_links(docs, places, words, percent, wide), "near-links")
    pairs = places.filter(F.col("kind") == PAIR).select("a", "b").distinct()
    pairs = written(likely(pairs, reps, percent), "near-pairs")
    links = links.unionByName(more).unionByName(written(verified(docs, pairs, words, percent), "near-links"))
    twins = in_class.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # A repeated id with different texts sits in several classes: its class links join them.
    several = twins.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).filter("low < high").select(F.col("a"), F.col("low").alias("b"))
    links = written(links.unionByName(several), "near-links")
    whole = components(links)
    m = whole.count()
    whole = whole.select(F.col("id").alias("rep"), "component")
    return (
        in_class.select("doc_id", "n_shingles", "rep")
        .join(broadcast_if_small(whole, m), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)
