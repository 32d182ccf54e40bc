"""Running moments, range line fits, circular smoothing, maxima and corner choice over ordered boundaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MOMENTS = ("mw", "mx", "my", "mxx", "mxy", "myy")


def running_moments(seq: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Prefix sums of w, wx, wy, wxx, wxy and wyy, with the place i (from 0) and the length n."""
    w = W.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    x, y, m = F.col("x"), F.col("y"), F.col("w")
    sums = dict(zip(MOMENTS, (m, m * x, m * y, m * x * x, m * x * y, m * y * y)))
    return seq.withColumns({**{k: F.sum(e).over(run) for k, e in sums.items()}, "i": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy(*keys))})


def line_of(m: dict[str, Column], count: Column) -> dict[str, Column]:
    """Weighted line through moments: centre, the smaller eigenvalue (mse), err = count * mse, and unit normal."""
    ex, ey = m["mx"] / m["mw"], m["my"] / m["mw"]
    cxx, cxy, cyy = m["mxx"] / m["mw"] - ex * ex, m["mxy"] / m["mw"] - ex * ey, m["myy"] / m["mw"] - ey * ey
    root = F.sqrt((cxx - cyy) * (cxx - cyy) + 4 * cxy * cxy)
    small, large = 0.5 * (cxx + cyy - root), 0.5 * (cxx + cyy + root)
    first = (cxx - large) * (cxx - large) + cxy * cxy > cxy * cxy + (cyy - large) * (cyy - large)
    nx, ny = F.when(first, cxx - large).otherwise(cxy), F.when(first, cxy).otherwise(cyy - large)
    length = F.sqrt(nx * nx + ny * ny)
    unit = lambda v: F.when(length < 1e-12, 0.0).otherwise(v / length)
    return {"ex": ex, "ey": ey, "mse": small, "err": count * small, "nx": unit(nx), "ny": unit(ny)}


def range_fit(moments: DataFrame, keys: list[str], ranges: DataFrame) -> DataFrame:
    """Line of each range (keys, i0, i1) of a boundary; i1 < i0 wraps round. ranges must fit the boundary."""
    at = moments.select(*keys, "i", "n", F.struct(*MOMENTS).alias("m"))
    hi = at.select(*keys, F.col("i").alias("i1"), "n", F.col("m").alias("m1"))
    lo = at.select(*keys, (F.col("i") + 1).alias("i0"), F.col("m").alias("m0"))
    last = at.filter("i = n - 1").select(*keys, F.col("m").alias("ml"))
    r = ranges.join(hi, [*keys, "i1"]).join(lo, [*keys, "i0"], "left").join(last, keys)
    zero = lambda c, k: F.coalesce(F.col(c)[k], F.lit(0.0))
    wraps = F.col("i1") < F.col("i0")
    m = {k: F.col("m1")[k] - zero("m0", k) + F.when(wraps, F.col("ml")[k]).otherwise(0.0) for k in MOMENTS}
    count = F.when(wraps, F.col("n") - F.col("i0") + F.col("i1") + 1).otherwise(F.col("i1") - F.col("i0") + 1)
    return r.select(*keys, "i0", "i1", *(v.alias(k) for k, v in line_of(m, count).items()))


def circular(seq: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows (keys, i, n, err) with the last k repeated before the first and the first k after the last."""
    shift = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    near = seq.withColumn("turn", shift).withColumn("j", F.col("i") + F.col("turn") * F.col("n"))
    return near.filter((F.col("j") >= -k) & (F.col("j") < F.col("n") + k))


def circular_smooth(seq: DataFrame, keys: list[str], kernel: list[float]) -> DataFrame:
    """Weighted sum of err over the circular neighbours of each place."""
    half = len(kernel) // 2
    w = W.partitionBy(*keys).orderBy("j")
    taps = ((F.lag if d < 0 else F.lead)("err", abs(d)).over(w) for d in range(-half, half + 1))
    total = reduce(lambda a, b: a + b, (t * k for t, k in zip(taps, kernel)))
    return circular(seq, keys, half).withColumn("s", total).filter("turn = 0").select(*keys, "i", "n", F.col("s").alias("err"))


def local_maxima(seq: DataFrame, keys: list[str]) -> DataFrame:
    """Places whose err exceeds that of both circular neighbours."""
    w = W.partitionBy(*keys).orderBy("j")
    both = (F.col("err") > F.lag("err").over(w)) & (F.col("err") > F.lead("err").over(w))
    return circular(seq, keys, 1).withColumn("top", both).filter("turn = 0 AND top").select(*keys, "i", "n", "err")


def top_maxima(maxima: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The maxima above the (k+1)-th largest, so ties with it go as well; all where there are no more than k."""
    w = W.partitionBy(*keys).orderBy(F.desc("err"), "i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    bar = F.nth_value("err", k + 1).over(w)
    return maxima.withColumn("bar", bar).filter("bar IS NULL OR err > bar").drop("bar")


def best_four(maxima: DataFrame, keys: list[str], cost) -> DataFrame:
    """(keys, m0..m3, cost): of all m0 < m1 < m2 < m3 the cheapest, the first on a tie. maxima hold at most the k of
    top_maxima for each key, so the four-way join stays within C(10, 4) rows a key. cost(c, d): of the side c to d."""
    t = [maxima.select(*keys, F.col("i").alias(f"m{k}"), F.col("err").alias(f"e{k}")) for k in range(4)]
    four = t[0]
    for k in (1, 2, 3):
        four = four.join(t[k], keys).filter(F.col(f"m{k}") > F.col(f"m{k - 1}"))
    total = reduce(lambda a, b: a + b, (cost(k, (k + 1) % 4) for k in range(4)))
    best = F.min(F.struct(total.alias("cost"), *(F.col(f"m{k}").alias(f"m{k}") for k in range(4)))).alias("b")
    return four.groupBy(*keys).agg(best).select(*keys, "b.*")
