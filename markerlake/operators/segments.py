"""Connected components and boundary clusters of a ternary image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_image(v: np.ndarray, mixed: bool = True) -> np.ndarray:
    """Component of each pixel of a ternary image as its smallest pixel number (y * width + x); 127 stands alone.
    Only columns 1..w-2 look at neighbours: west and north, and for white (mixed) also north-west and north-east."""
    h, w = v.shape
    ids = np.arange(h * w).reshape(h, w)
    a, b = [], []
    for dy, dx, white in ((0, -1, False), (-1, 0, False), (-1, -1, True), (-1, 1, True)):
        if white and not mixed or w < 3 or h + dy < 1:
            continue
        here, there = v[-dy:, 1 : w - 1], v[: h + dy, 1 + dx : w - 1 + dx]
        same = (here == there) & (here != 127) & ((here == 255) | (not white))
        a.append(ids[-dy:, 1 : w - 1][same])
        b.append(ids[: h + dy, 1 + dx : w - 1 + dx][same])
    label = ids.ravel().copy()
    if a:
        x, y = np.concatenate(a), np.concatenate(b)
        while len(x):
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            np.minimum.at(label, high, low)
            while True:  # shorten the pointers
                new = label[label]
                if (new == label).all():
                    break
                label = new
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
    return label.reshape(h, w)


def components(px: DataFrame, mixed: bool = True) -> DataFrame:
    """(image_id, y, x, v, comp): one image is one task, as an image is bounded (32,767 pixels a side)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        v = np.full((h, w), 127, np.int64)
        v[pdf.y, pdf.x] = pdf.v
        return pdf.assign(comp=label_image(v, mixed)[pdf.y, pdf.x])[["image_id", "y", "x", "v", "comp"]]

    return px.select("image_id", F.col("y").cast("int"), F.col("x").cast("int"), F.col("v").cast("int")).groupBy("image_id").applyInPandas(run, f"image_id {dict(px.dtypes)['image_id']}, y int, x int, v int, comp long")


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("image_id", "comp").agg(F.count("*").alias("n"))


def boundary_points(labelled: DataFrame, min_pixels: int = 24) -> DataFrame:
    """(image_id, rep_hi, rep_lo, x2, y2, gx, gy): midpoints, in half pixels, between a pixel and its east, south,
    south-west and south-east neighbour of the other colour, if both components have min_pixels. South-west is left
    out where the pixel to the left met its own south-east neighbour, which is the same midpoint's other diagonal."""
    n = component_sizes(labelled).filter(F.col("n") >= min_pixels).select("image_id", "comp")
    big = labelled.filter("v <> 127").join(n, ["image_id", "comp"])
    edge = labelled.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    # Each pixel goes to those that look at it, and one grouping gathers what a pixel sees.
    looks = {"me": (0, 0), "e": (1, 0), "w": (-1, 0), "s": (0, 1), "sw": (-1, 1), "se": (1, 1)}
    sent = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), "v", "comp") for k, (dx, dy) in looks.items()))
    seen = big.select("image_id", F.explode(sent).alias("p")).select("image_id", "p.*")
    p = seen.groupBy("image_id", "y", "x").agg(*(F.max(F.when(F.col("k") == k, F.struct("v", "comp"))).alias(k) for k in looks)).filter("me IS NOT NULL")
    inside = (F.col("x") >= 1) & (F.col("x") < F.col("mx")) & (F.col("y") >= 1) & (F.col("y") < F.col("my"))
    p = p.join(edge, "image_id").filter(inside)
    apart = lambda a, b: F.coalesce(F.col(a)["v"] + F.col(b)["v"] == 255, F.lit(False))
    left_met = (F.col("x") >= 2) & apart("w", "s")  # the left pixel's south-east is this one's south

    def point(dx: int, dy: int, c: str, also=None):
        ok = apart("me", c) if also is None else apart("me", c) & also
        d, mine, other = F.col(c)["v"] - F.col("me")["v"], F.col("me")["comp"], F.col(c)["comp"]
        return F.when(ok, F.struct(F.greatest(mine, other).alias("rep_hi"), F.least(mine, other).alias("rep_lo"), (2 * F.col("x") + dx).alias("x2"), (2 * F.col("y") + dy).alias("y2"), (dx * d).alias("gx"), (dy * d).alias("gy")))

    points = F.array(point(1, 0, "e"), point(0, 1, "s"), point(-1, 1, "sw", ~left_met), point(1, 1, "se"))
    return p.select("image_id", F.explode(F.array_compact(points)).alias("p")).select("image_id", "p.*")


def cluster_stats(points: DataFrame) -> DataFrame:
    """Size, bounding box and polarity sum of each cluster, from one aggregation and one join back for the centre."""
    keys = ["image_id", "rep_hi", "rep_lo"]
    box = points.groupBy(*keys).agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{s}") for c in ("x2", "y2") for f, s in ((F.min, "min"), (F.max, "max"))), *(F.sum(F.col(c) * F.col(g)).alias(f"{c}{g}") for c, g in (("x2", "gx"), ("y2", "gy"))), F.sum("gx").alias("sgx"), F.sum("gy").alias("sgy"))
    cx, cy = (F.col("x2min") + F.col("x2max")) * 0.5 + 0.05118, (F.col("y2min") + F.col("y2max")) * 0.5 - 0.028581
    dot = F.col("x2gx") + F.col("y2gy") - cx * F.col("sgx") - cy * F.col("sgy")
    return box.select(*keys, "n", "x2min", "x2max", "y2min", "y2max", cx.alias("cx"), cy.alias("cy"), dot.alias("dot"))


def sized_clusters(stats: DataFrame, width: int, height: int, min_pixels: int = 24) -> DataFrame:
    """Clusters of at least min_pixels points and no more than twice the image's border."""
    return stats.filter(F.col("n").between(min_pixels, 4 * (width + height)))


def outward(stats: DataFrame, normal: bool = True, reversed_border: bool = False) -> DataFrame:
    """Clusters with reversed (light inside dark); those of a border that no family has are left out."""
    marked = stats.withColumn("reversed", F.col("dot") < 0)
    return marked.filter((F.col("reversed") & F.lit(reversed_border)) | (~F.col("reversed") & F.lit(normal)))


def slope(dx, dy):
    """A number that grows with the angle of (dx, dy) around the centre, without trigonometry."""
    quadrant = F.when(dy > 0, F.when(dx > 0, 65536).otherwise(131072)).otherwise(F.when(dx > 0, 0).otherwise(-65536))
    x, y = F.when(dy < 0, -dx).otherwise(dx), F.when(dy < 0, -dy).otherwise(dy)
    return quadrant + F.when(x < 0, -x / y).otherwise(y / x)
