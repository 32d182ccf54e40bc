"""Codewords: rotation, Hamming distance, and error-tolerant lookup through an index of code chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CHUNKS, MOST = 4, 3


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def rotate90(code: Column, nbits: int) -> Column:
    """A quarter turn: the bits move round by a quarter of their number; an odd last bit is the centre and stays."""
    keep, centre = (code, None) if nbits % 4 == 0 else (F.shiftright(code, 1), code.bitwiseAND(F.lit(1)))
    n = nbits - nbits % 4
    p = n // 4
    turned = F.shiftright(keep, n - p).bitwiseOR(F.shiftleft(keep, p)).bitwiseAND(F.lit((1 << n) - 1))
    return turned if centre is None else F.shiftleft(turned, 1).bitwiseOR(centre)


def rotations(codes: DataFrame, nbits: int, code: str = "rcode") -> DataFrame:
    """A row for each quarter turn 0..3 of every code."""
    turned = [F.col(code)]
    for _ in range(3):
        turned.append(rotate90(turned[-1], nbits))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rotation"), c.alias("turned")) for k, c in enumerate(turned))))
    return codes.withColumn("_t", each).select(*codes.columns, "_t.rotation", "_t.turned")


def chunk_size(nbits: int) -> int:
    return -(-nbits // CHUNKS)


def _chunks(nbits: int, code: str) -> Column:
    size = chunk_size(nbits)
    parts = (F.struct(F.lit(k).alias("chunk_no"), F.shiftrightunsigned(F.col(code), k * size).bitwiseAND(F.lit((1 << size) - 1)).alias("chunk_val")) for k in range(CHUNKS))
    return F.explode(F.array(*parts))


def code_chunks(family: DataFrame, nbits: int) -> DataFrame:
    """The index: (chunk_no, chunk_val, id, code). At most 3 errors leave one of four chunks whole."""
    return family.select("id", "code", _chunks(nbits, "code").alias("c")).select("c.chunk_no", "c.chunk_val", "id", "code")


def decode(codes: DataFrame, family: DataFrame, nbits: int, max_hamming: int = 2, turns: bool = True) -> DataFrame:
    """codes (rcode, ...) with id, hamming and rotation of the first match by (rotation, chunk, id) within
    max_hamming; codes without one are left out. The family has fewer than 65,536 codes and so is broadcast."""
    if max_hamming > MOST:
        raise ValueError(f"the chunk index finds at most {MOST} errors")
    keys = codes.columns
    once = codes.groupBy(*keys).agg(F.count("*").alias("_n"))  # repeated rows are looked up once and given back as often
    probe = rotations(once, nbits) if turns else once.withColumns({"rotation": F.lit(0), "turned": F.col("rcode")})
    probe = probe.withColumn("c", _chunks(nbits, "turned")).select(*keys, "_n", "rotation", "turned", "c.chunk_no", "c.chunk_val")
    d = hamming(F.col("code"), F.col("turned"))
    hits = probe.join(F.broadcast(code_chunks(family, nbits)), ["chunk_no", "chunk_val"]).withColumn("hamming", d).filter(F.col("hamming") <= max_hamming)
    best = hits.groupBy(*keys).agg(F.min(F.struct("rotation", "chunk_no", "id", "hamming")).alias("b"), F.first("_n").alias("_n"))
    return best.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*keys, "b.id", "b.hamming", "b.rotation")


def min_distance(family: DataFrame, nbits: int, turns: bool = True) -> DataFrame:
    """Least distance of two codes of a family, over quarter turns. A family is bounded at 65,535 codes.
    Pairs with a common chunk come first: a least distance of at most MOST among them is the least of all, and only
    without one are all pairs tried."""
    a = rotations(family.select("id", F.col("code").alias("rcode")), nbits) if turns else family.select("id", F.col("code").alias("rcode"), F.col("code").alias("turned"))
    b = family.select(F.col("id").alias("id2"), "code")
    d = F.min(hamming(F.col("turned"), F.col("code"))).alias("min_distance")
    left, right = a.withColumn("c", _chunks(nbits, "turned")), b.withColumn("c", _chunks(nbits, "code"))
    near = left.join(right, "c").filter("id < id2").agg(d)
    least = near.first()[0]
    if least is not None and least <= MOST:
        return near
    return a.join(F.broadcast(b), F.col("id") < F.col("id2")).agg(d)


def pack_bits(bits: Column) -> Column:
    """A number from an array of booleans, the first the highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(F.when(b, 1).otherwise(0).cast("long")))


def render(family_bits: DataFrame, families: DataFrame, codes: DataFrame) -> DataFrame:
    """(family, id, y, x, v): each code as an image of total_width squared, with its white ring and its bits.
    families: (family, nbits, width_at_border, total_width, reversed_border); family_bits: (family, i, x, y)."""
    f = codes.join(F.broadcast(families), "family")
    ring = F.col("width_at_border") + F.when(F.col("reversed_border"), 0).otherwise(2)
    f = f.withColumn("s", F.floor((F.col("total_width") - ring) / 2).cast("int")).withColumn("b", F.floor((F.col("total_width") - F.col("width_at_border")) / 2).cast("int"))
    line = F.sequence(F.lit(0), F.col("total_width") - 1)
    grid = f.withColumn("y", F.explode(line)).withColumn("x", F.explode(line))
    bits = family_bits.select("family", "i", F.col("x").alias("bx"), F.col("y").alias("by"))
    lit = f.join(F.broadcast(bits), "family").filter(F.getbit("code", F.col("nbits") - 1 - F.col("i")) == 1)
    lit = lit.select("family", "id", (F.col("by") + F.col("b")).alias("y"), (F.col("bx") + F.col("b")).alias("x"), F.lit(255).alias("on"))
    last = F.col("total_width") - 1 - F.col("s")
    inside = F.col("x").between(F.col("s"), last) & F.col("y").between(F.col("s"), last)
    on_ring = inside & ((F.col("x") == F.col("s")) | (F.col("x") == last) | (F.col("y") == F.col("s")) | (F.col("y") == last))
    return grid.join(lit, ["family", "id", "y", "x"], "left").select("family", "id", "y", "x", F.when(F.col("on").isNotNull() | on_ring, 255).otherwise(0).alias("v"))


def hamming_histogram(detections: DataFrame, bins: int = 10) -> DataFrame:
    """A row for each image and one for all (null image_id): counts h0.. of each distance, and the total."""
    counts = [F.sum(F.when(F.col("hamming") == k, 1).otherwise(0)).alias(f"h{k}") for k in range(bins)]
    return detections.rollup("image_id").agg(*counts, F.count("*").alias("total"))


def cells(boxes: DataFrame, x: str, y: str, side: float, around: bool = False) -> DataFrame:
    """boxes with the grid cell (cx, cy) of their corner; around: a row for each of the nine cells at it. Boxes that are
    no larger than side and touch meet in one cell, so an equi-join finds them."""
    at = [F.floor(F.col(c) / side).cast("long") for c in (x, y)]
    if not around:
        return boxes.withColumns({"cx": at[0], "cy": at[1]})
    near = F.explode(F.array(*(F.struct((at[0] + i).alias("cx"), (at[1] + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    return boxes.withColumn("_cell", near).select(*boxes.columns, "_cell.cx", "_cell.cy")


def _best(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The best box of each by: fewest errors, then largest margin (NaN is the largest), then smallest id; nulls last."""
    m, i = F.col("margin"), F.col("box_id")
    order = F.struct("hamming", F.struct(m.isNull(), ~F.isnan(m), -m), F.struct(i.isNull(), i), m.alias("margin"), i.alias("box_id"))
    best = boxes.filter(F.col("hamming").isNotNull()).groupBy(*by).agg(F.min(order).alias("_b"))
    return best.select(*by, "_b.hamming", "_b.margin", "_b.box_id")


def dominated(boxes: DataFrame, keys: list[str], overlaps: Column, grid: tuple[str, str, float] | None = None, place: list[str] | None = None) -> DataFrame:
    """boxes without those that a better one of equal keys overlaps: fewer errors, then larger margin, then smaller
    id; a comparison with null is not true, as in SQL. overlaps is a predicate over columns of a. and b.; grid (x, y,
    side) keeps boxes that are no larger than side from meeting all others of equal keys. place: the columns that
    overlaps reads, x and y of the grid among them; then only the best box of each place meets the others, as any box
    that another of its place beats is also beaten by that best one. Both sides are shuffled, so none is held by the driver."""
    best = _best(boxes, [*keys, *place]) if place else boxes
    a, b = (cells(boxes, *grid), cells(best, *grid, around=True)) if grid else (boxes, best)
    a, b, on = a.alias("a"), b.alias("b"), [*keys, "cx", "cy"] if grid else keys
    (ah, am, ai), (bh, bm, bi) = ([F.col(f"{t}.{n}") for n in ("hamming", "margin", "box_id")] for t in "ab")
    better = (bh < ah) | ((bh == ah) & ((bm > am) | ((bm == am) & (bi < ai))))
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in on))
    return a.join(b.hint("merge"), same & better & overlaps, "left_anti").select(*boxes.columns)


def first_rows(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")
