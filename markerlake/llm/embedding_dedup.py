"""Embedding near-dedup by a pivot-permutation index.

Reference points (pivots) are drawn from the vectors by hash of their id and kept apart from each other so that one
dense group cannot claim many of them. There are as many as one for each `per_pivot` vectors, and no more than `root`
times the square root of the vectors' number: comparing with pivots and searching lists then both grow with the power
1.5, and a billion vectors of 64 components have 253,000 pivots of 130 MB. Every vector is described by its `near` nearest
pivots in order. Inverted lists hold, for each (label, pivot), the vectors that name the pivot; two vectors of a
list are candidates if they share at least `shared` pivots. A pair meets in several lists and counts in that of
the smallest pivot they share. Candidates are verified by cosine in double precision. Lists longer than `block`
are dealt into blocks and every pair of blocks is its own group, so a long list is searched whole but never sits
in one task. Equal vectors of one label are one class with a weight; links are counted by weight and never
expanded; only one link for each vector and group, to the smallest vector it reaches there, leaves a group.

Cases: a vector that is null, zero, empty or holds a null or non-finite component, a null label and a null id link
with nothing; vectors of unlike length link with nothing; rows that repeat an id are vectors of their own in the
counts and one node in components; components of any finite size are scaled first, so that no norm overflows or vanishes; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import broadcast_if_small, table, written


#: Vectors compared with the pivots chosen so far at a time; cosines held at a time.
PART, COSINES = 1024, 1 << 22


def _usable(v: str) -> Column:
    return F.expr(f"coalesce(size({v}) > 0 AND NOT exists({v}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists({v}, x -> x <> 0), false)")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. A power of two brings the largest component near one first, which changes no digit."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots(vectors: DataFrame, wanted: int, apart: float = 0.9, seed: int = 11) -> dict[int, np.ndarray]:
    """Unit pivots for each vector length: the `wanted` vectors with the smallest hashes come to the driver, and
    one that is nearer than `apart` in cosine to an earlier one is left out."""
    rows = vectors.select("v").orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id", "v").limit(wanted).toArrow().column("v").combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    chosen = {}
    for dim in np.unique(sizes):
        x = _unit(np.asarray(rows.filter(pa.array(sizes == dim)).flatten(), float).reshape(-1, dim))
        own, n = np.empty_like(x), 0
        for k in range(0, len(x), PART):
            some = x[k : k + PART]
            some = some[(some @ own[:n].T < apart).all(1)]
            near, kept = some @ some.T >= apart, []
            for i in range(len(some)):
                if not near[i, kept].any():
                    kept.append(i)
            own[n : n + len(kept)] = some[kept]
            n += len(kept)
        chosen[int(dim)] = own[:n]
    return chosen


def _nearest(unit: np.ndarray, p: np.ndarray, m: int) -> np.ndarray:
    """The m nearest of p for each row, in order, a bounded number of cosines at a time."""
    step, out = max(1, COSINES // len(p)), np.empty((len(unit), m), np.int32)
    for k in range(0, len(unit), step):
        far = -(unit[k : k + step] @ p.T)
        some = np.argpartition(far, m - 1, axis=1)[:, :m]
        some.sort(axis=1)  # ties go to the first pivot
        order = np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable")
        out[k : k + step] = np.take_along_axis(some, order, 1)
    return out


def describe(vectors: DataFrame, points: dict[int, np.ndarray], near: int) -> DataFrame:
    """(label, dim, pivot, vec_id, weight, near, v): a row for each of a vector's nearest pivots; near holds them
    all in order, v the components as 64-bit floats."""

    def run(batches):
        for b in batches:
            ids, labels, weights = (b.column(c).to_pylist() for c in ("vec_id", "label", "weight"))
            out: dict[str, list] = {k: [] for k in ("label", "dim", "pivot", "vec_id", "weight", "near", "v")}
            values = b.column("v").to_pylist()
            by: dict[int, list[int]] = {}
            for k, v in enumerate(values):
                by.setdefault(len(v), []).append(k)
            for dim, at in by.items():
                x = np.array([values[k] for k in at], float)
                p = points.get(dim, np.zeros((1, dim)))  # a length that the sample missed has a single list
                for k, row, own in zip(at, x, _nearest(_unit(x), p, min(near, len(p)))):
                    raw, names = row.tobytes(), own.tolist()
                    for q in names:
                        for c, value in zip(out, (labels[k], dim, q, ids[k], weights[k], names, raw)):
                            out[c].append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds)], names=list(out))

    return vectors.mapInArrow(run, "label long, dim int, pivot int, vec_id long, weight long, near array<int>, v binary")


def _search(shared: int, least: float):
    """For a group (label, dim, pivot, i, j): (vec_id, n, low) of each vector with links."""

    def run(key, group):
        pivot, i, j = (key[k].as_py() for k in (2, 3, 4))
        dim = key[1].as_py()
        ids, weight, block = (group.column(c).to_numpy() for c in ("vec_id", "weight", "block"))
        x = np.frombuffer(b"".join(group.column("v").to_pylist()), np.float64).reshape(-1, dim)
        names = group.column("near").combine_chunks()
        near = np.asarray(names.flatten()).reshape(len(ids), -1)
        used, place = np.unique(near, return_inverse=True)
        hot = np.zeros((len(ids), len(used)), np.float32)
        np.put_along_axis(hot, place.reshape(near.shape), 1, 1)
        lower = hot[:, used < pivot]
        need = min(shared, near.shape[1])
        count = hot @ hot.T
        pair = (count >= need) & (lower @ lower.T == 0) if lower.shape[1] else count >= need
        if i != j:
            pair &= block[:, None] != block[None, :]
        np.fill_diagonal(pair, False)
        unit = _unit(x)
        pair &= unit @ unit.T >= least
        n = pair @ weight
        at = np.flatnonzero(n)
        if not len(at):
            return _EMPTY
        pair, low = pair[np.ix_(at, at)], ids[at]
        while True:  # the smallest id that the group's links reach
            new = np.minimum(low, np.where(pair, low[None, :], np.iinfo(np.int64).max).min(1))
            if (new == low).all():
                break
            low = new
        return pa.table({"vec_id": ids[at], "n": n[at].astype(np.int64), "low": low})

    return run


_EMPTY = pa.table({"vec_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "low": pa.array([], pa.int64())})


def embedding_dedup(vectors: DataFrame, least: float = 0.98, near: int = 8, shared: int = 2, per_pivot: int = 64, root: float = 8, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, label, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    usable = _usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    h1, h2 = (F.when(usable, F.xxhash64(F.lit(k), "v")) for k in (1, 2))
    marked = rows.select("vec_id", "label", h1.alias("h1"), h2.alias("h2"))
    copies = marked.filter("h1 IS NOT NULL").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    copies = written(copies.filter("weight > 1"), "vec-copies")
    hint = broadcast_if_small(copies, copies.count())
    classes = marked.join(hint, ["label", "h1", "h2"], "left").select(
        "vec_id", F.when(F.col("h1").isNotNull(), F.coalesce("rep", "vec_id")).alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight")
    )
    reps = rows.filter(usable).withColumns({"h1": F.xxhash64(F.lit(1), "v"), "h2": F.xxhash64(F.lit(2), "v")}).join(hint, ["label", "h1", "h2"], "left")
    reps = reps.filter("rep IS NULL OR rep = vec_id").select("vec_id", "label", "v", F.coalesce("weight", F.lit(1)).alias("weight")).dropDuplicates(["vec_id", "label", "v"])
    reps = written(reps, "vec-reps")
    total = reps.count()
    points = pivots(reps, max(32, min(total // per_pivot, int(root * total**0.5))))
    lists = written(describe(reps, points, near), "vec-lists")
    sizes = lists.groupBy("label", "dim", "pivot").agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
    long = written(sizes.select("label", "dim", "pivot", F.ceil(F.col("_n") / block).cast("int").alias("blocks")), "vec-long")
    dealt = lists.join(broadcast_if_small(long, long.count()), ["label", "dim", "pivot"], "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "weight", "near", "v")
    found = dealt.groupBy("label", "dim", "pivot", "i", "j").applyInArrow(_search(shared, least), "vec_id long, n long, low long")
    found = written(found, "vec-found")
    whole = components(found.filter("low <> vec_id").select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    linked = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("n"))
    linked = linked.join(whole.select(F.col("id").alias("rep"), "component"), "rep", "left")
    linked = written(linked, "vec-linked")
    return (
        classes.join(broadcast_if_small(linked, linked.count()), "rep", "left")
        .select(
            "vec_id",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
