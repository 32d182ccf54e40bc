"""Raster operators over pixels(image_id, y, x, v): resampling, convolution, tiles, adaptive threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TILE, BAYER_TILE = 4, 32
#: Weights of the nine pixels of a 3x3 block (row by row) for its four outputs, divided by 9.
THREE_TO_TWO = {(0, 0): (4, 2, 0, 2, 1, 0, 0, 0, 0), (0, 1): (0, 2, 4, 0, 1, 2, 0, 0, 0), (1, 0): (0, 0, 0, 2, 1, 0, 4, 2, 0), (1, 1): (0, 0, 0, 0, 1, 2, 0, 2, 4)}


def div(a: Column, n: int) -> Column:
    """Whole quotient of a non-negative number."""
    return F.floor(a / n).cast("int")


def sizes(px: DataFrame) -> DataFrame:
    """(image_id, w, h)."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def decimate(px: DataFrame, factor: float) -> DataFrame:
    """Every factor-th pixel; 1.5 averages each whole 3x3 block into 2x2. Other fractions are refused, as corners
    could not be scaled back consistently."""
    if factor == 1.5:
        place = (F.col("y") % 3) * 3 + F.col("x") % 3
        at = F.element_at
        sums = [
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), div(F.sum(at(F.array(*map(F.lit, w)), place + 1) * F.col("v")), 9).alias("v"))
            for (dy, dx), w in THREE_TO_TWO.items()
        ]
        blocks = px.groupBy("image_id", div(F.col("y"), 3).alias("by"), div(F.col("x"), 3).alias("bx")).agg(F.count("*").alias("n"), F.array(*sums).alias("out")).filter("n = 9")
        out = blocks.select("image_id", "by", "bx", F.explode("out").alias("o"))
        return out.select("image_id", (F.col("by") * 2 + F.col("o.dy")).alias("y"), (F.col("bx") * 2 + F.col("o.dx")).alias("x"), F.col("o.v").alias("v"))
    if factor != int(factor) or factor < 1:
        raise ValueError("the factor must be 1.5 or a whole number")
    f = int(factor)
    return px.filter((F.col("x") % f == 0) & (F.col("y") % f == 0)).select("image_id", div(F.col("y"), f).alias("y"), div(F.col("x"), f).alias("x"), "v")


def darken(px: DataFrame) -> DataFrame:
    return px.withColumn("v", div(F.col("v"), 2))


def gray_from_rgb(px: DataFrame) -> DataFrame:
    """pixels(image_id, y, x, r, g, b) to gray (r + 2g + b) / 4."""
    return px.select("image_id", "y", "x", div(F.col("r") + F.col("g") + F.col("g") + F.col("b"), 4).alias("v"))


def gray_from_float(px: DataFrame) -> DataFrame:
    """Values from 0 to 1 as whole numbers up to 255, cut off."""
    return px.withColumn("v", (F.col("v") * 255).cast("int"))


def by_channel(px: DataFrame, channels: list[str], f) -> DataFrame:
    """f over each channel column of pixels(image_id, y, x, ...) as v: one pass over all channels, as images of their
    own."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("int").alias("v")) for c in channels)))
    flat = px.select(F.col("image_id").alias("_image"), "y", "x", each.alias("p")).select(F.struct("_image", "p.c").alias("image_id"), "y", "x", "p.v")
    done = f(flat).select("image_id.*", "y", "x", "v")
    return done.groupBy(F.col("_image").alias("image_id"), "y", "x").agg(*(F.max(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in channels))


def blur_colours(px: DataFrame, kernel: list[int]) -> DataFrame:
    """pixels(image_id, y, x, r, g, b), blurred channel by channel."""
    return by_channel(px, ["r", "g", "b"], lambda p: blur(p, kernel))


def with_alpha(px: DataFrame, alpha: int = 255) -> DataFrame:
    """pixels(image_id, y, x, r, g, b) with a constant a."""
    return px.withColumn("a", F.lit(alpha))


def gaussian_kernel(sigma: float, size: int) -> list[int]:
    """Kernel of whole numbers, 255 times the normalised Gaussian, cut off."""
    import math

    raw = [math.exp(-0.5 * ((k - size // 2) / sigma) ** 2) for k in range(size)]
    return [int(v / sum(raw) * 255) for v in raw]


def _convolved(px: DataFrame, kernel: list[int], line: str, along: str) -> DataFrame:
    """One pass along an axis; the first and last pixels within half a kernel stay."""
    w, half = W.partitionBy("image_id", line).orderBy(along), len(kernel) // 2
    taps = [(F.lag if d < 0 else F.lead)("v", abs(d)).over(w) for d in range(-half, half + 1)]
    total = reduce(lambda a, b: a + b, (F.lit(k) * t for k, t in zip(kernel, taps)))
    return px.withColumn("v", F.coalesce(F.shiftright(total.cast("int"), 8), F.col("v")))


def blur(px: DataFrame, kernel: list[int]) -> DataFrame:
    """Rows, then columns."""
    return _convolved(_convolved(px, kernel, "y", "x"), kernel, "x", "y")


def unsharp(px: DataFrame, kernel: list[int]) -> DataFrame:
    """Twice the pixel less its blurred value, within 0..255. Both values travel through the same two windows."""
    low = _convolved(_convolved(px.withColumn("orig", F.col("v")), kernel, "y", "x"), kernel, "x", "y")
    v = F.least(F.lit(255), F.greatest(F.lit(0), 2 * F.col("orig") - F.col("v")))
    return low.select("image_id", "y", "x", v.cast("int").alias("v"))


def tile_minmax(px: DataFrame, tile: int = TILE) -> DataFrame:
    """(image_id, ty, tx, vmin, vmax) of whole tiles."""
    t = px.groupBy("image_id", div(F.col("y"), tile).alias("ty"), div(F.col("x"), tile).alias("tx"))
    return t.agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.count("*").alias("n")).filter(F.col("n") == tile * tile).drop("n")


def tile_dilate(tiles: DataFrame) -> DataFrame:
    """Least minimum and largest maximum of the 3x3 tiles around each, in two separable passes."""
    for line, along in (("ty", "tx"), ("tx", "ty")):
        w = W.partitionBy("image_id", line).orderBy(along).rangeBetween(-1, 1)
        tiles = tiles.withColumns({"vmin": F.min("vmin").over(w), "vmax": F.max("vmax").over(w)})
    return tiles


def threshold(px: DataFrame, min_diff: int = 5) -> DataFrame:
    """255 above the middle of the surrounding tiles' range, 0 else; 127 where the range is below min_diff. Pixels
    beyond the whole tiles take the nearest tile and are never 127."""
    s = sizes(px)
    sized = px.join(s, "image_id")  # Spark broadcasts the sizes where they are small
    last = lambda c, n: F.least(div(F.col(c), TILE), div(F.col(n), TILE) - 1)
    near = sized.select("image_id", "y", "x", "v", last("y", "h").alias("ty"), last("x", "w").alias("tx"), ((div(F.col("y"), TILE) < div(F.col("h"), TILE)) & (div(F.col("x"), TILE) < div(F.col("w"), TILE))).alias("inside"))
    both = near.join(tile_dilate(tile_minmax(px)), ["image_id", "ty", "tx"])
    span = F.col("vmax") - F.col("vmin")
    v = F.when(F.col("inside") & (span < min_diff), 127).when(F.col("v") > F.col("vmin") + div(span, 2), 255).otherwise(0)
    return both.select("image_id", "y", "x", v.alias("v"))


def threshold_bayer(px: DataFrame, tile: int = BAYER_TILE) -> DataFrame:
    """The same with statistics for each of the four places of a 2x2 colour mosaic, and output 0/1. Partial tiles
    count as tiles of their own."""
    place = (F.col("y") % 2) * 2 + F.col("x") % 2
    marked = px.withColumns({"ty": div(F.col("y"), tile), "tx": div(F.col("x"), tile), "p": place})
    tiles = marked.groupBy("image_id", "p", "ty", "tx").agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    for line, along in (("ty", "tx"), ("tx", "ty")):
        w = W.partitionBy("image_id", "p", line).orderBy(along).rangeBetween(-1, 1)
        tiles = tiles.withColumns({"vmin": F.min("vmin").over(w), "vmax": F.max("vmax").over(w)})
    both = marked.join(tiles, ["image_id", "p", "ty", "tx"])
    v = F.when(F.col("v") > F.col("vmin") + div(F.col("vmax") - F.col("vmin"), 2), 1).otherwise(0)
    return both.select("image_id", "y", "x", v.alias("v"))


def _box(px: DataFrame, pick) -> DataFrame:
    """pick (min or max) of the 3x3 pixels around each, in two passes."""
    for line, along in (("y", "x"), ("x", "y")):
        px = px.withColumn("v", pick("v").over(W.partitionBy("image_id", line).orderBy(along).rangeBetween(-1, 1)))
    return px


def deglitch(binary: DataFrame) -> DataFrame:
    """3x3 maximum, then 3x3 minimum, of inner pixels; the outermost ring stays, and counts as 0 for the minimum."""
    s = sizes(binary)
    inner = (F.col("x") >= 1) & (F.col("y") >= 1) & (F.col("x") + 1 < F.col("w")) & (F.col("y") + 1 < F.col("h"))
    sized = binary.join(s, "image_id").withColumn("inner", inner).withColumn("orig", F.col("v"))
    high = _box(sized, F.max).withColumn("v", F.when(F.col("inner"), F.col("v")).otherwise(0))
    low = _box(high, F.min)
    return low.select("image_id", "y", "x", F.when(F.col("inner"), F.col("v")).otherwise(F.col("orig")).alias("v"))


def rotate(px: DataFrame, radians: float, pad: int = 0) -> DataFrame:
    """Rotation about the centre by nearest neighbour, with pad outside."""
    import math

    c, s = math.cos(radians), math.sin(radians)
    grid = px.join(sizes(px), "image_id").select("image_id", "y", "x", "w", "h")
    ox, oy = F.col("x") - F.col("w") / 2 + 0.5, F.col("y") - F.col("h") / 2 + 0.5
    sx = F.floor(ox * c - oy * s + F.col("w") / 2).cast("int")
    sy = F.floor(ox * s + oy * c + F.col("h") / 2).cast("int")
    source = px.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("v").alias("sv"))
    return grid.withColumns({"sx": sx, "sy": sy}).join(source, ["image_id", "sy", "sx"], "left").select("image_id", "y", "x", F.coalesce("sv", F.lit(pad)).alias("v"))


def draw_disc(px: DataFrame, x0: float, y0: float, r0: float, r1: float, value: int) -> DataFrame:
    """Pixels between r0 and r1 of a centre take the value; r0 = 0 draws a full circle. Distances are doubles, as the
    square of a coordinate from 46,341 on is no int."""
    dx, dy = F.col("x").cast("double") - x0, F.col("y").cast("double") - y0
    d = dx * dx + dy * dy
    return px.withColumn("v", F.when(d.between(r0 * r0, r1 * r1), value).otherwise(F.col("v")))


def draw_line(px: DataFrame, x0: float, y0: float, x1: float, y1: float, value: int, width: int = 1) -> DataFrame:
    """Pixels met by half-pixel steps along a segment take the value; a width over 1 covers 2x2 pixels at each step.
    The steps of one segment are a bounded table of at most two for each pixel of its length."""
    import math

    spark = px.sparkSession
    length = math.hypot(x1 - x0, y1 - y0)
    if length == 0:
        return px
    share = F.col("id") * 0.5 / length
    at = spark.range(int(length * 2) + 1).select(F.floor(x1 + share * (x0 - x1)).cast("int").alias("x"), F.floor(y1 + share * (y0 - y1)).cast("int").alias("y"))
    if width > 1:
        at = at.select(F.explode(F.array(*(F.struct((F.col("y") + b).alias("y"), (F.col("x") + a).alias("x")) for a in (0, 1) for b in (0, 1)))).alias("p")).select("p.*")
    hit = at.distinct().withColumn("hit", F.lit(True))
    return px.join(F.broadcast(hit), ["y", "x"], "left").select("image_id", "y", "x", F.when(F.col("hit"), value).otherwise(F.col("v")).alias("v"))


def fill_line_max(px: DataFrame, x0: float, y0: float, x1: float, y1: float, table: list[int], scale: float) -> DataFrame:
    """Each pixel becomes at least table[squared distance of its centre to the segment * scale], where that exists."""
    ux, uy = x1 - x0, y1 - y0
    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * ux + (y - y0) * uy) / max(ux * ux + uy * uy, 1e-12)))
    dx, dy = x - (x0 + t * ux), y - (y0 + t * uy)
    light = F.get(F.array(*map(F.lit, table)), F.floor((dx * dx + dy * dy) * scale).cast("int"))
    return px.withColumn("v", F.greatest("v", F.coalesce(light, F.lit(0))))


def plane_fit(px: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares of v = a x + b y + c for each key, from nine sums and Cramer's rule; null where singular."""
    x, y, v = (F.col(c).cast("double") for c in ("x", "y", "v"))
    g = px.groupBy(*keys).agg(
        *(F.sum(e).alias(n) for n, e in {"sxx": x * x, "sxy": x * y, "sx": x, "syy": y * y, "sy": y, "sxv": x * v, "syv": y * v, "sv": v}.items()),
        F.count("*").cast("double").alias("n"),
    )
    c = {k: F.col(k) for k in g.columns}

    def det(a, b, d, e, f, g_, h, i, j):
        return a * (f * j - g_ * i) - b * (e * j - g_ * h) + d * (e * i - f * h)

    base = det(c["sxx"], c["sxy"], c["sx"], c["sxy"], c["syy"], c["sy"], c["sx"], c["sy"], c["n"])
    a = det(c["sxv"], c["sxy"], c["sx"], c["syv"], c["syy"], c["sy"], c["sv"], c["sy"], c["n"])
    b = det(c["sxx"], c["sxv"], c["sx"], c["sxy"], c["syv"], c["sy"], c["sx"], c["sv"], c["n"])
    k = det(c["sxx"], c["sxy"], c["sxv"], c["sxy"], c["syy"], c["syv"], c["sx"], c["sy"], c["sv"])
    ok = F.abs(base) > 1e-9
    return g.select(*keys, *(F.when(ok, e / base).alias(n) for n, e in {"a": a, "b": b, "c": k}.items()))
