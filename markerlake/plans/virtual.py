"""Virtual inputs: rasters, codes, boxes and boundaries derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, NBITS = 100, 36


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit(0).alias("image_id"), F.expr(f"CAST(event_id DIV {WIDTH} AS INT)").alias("y"), (F.col("event_id") % WIDTH).cast("int").alias("x"), F.floor(F.col("value") * 0.5).cast("int").alias("v")
    )


PX = f"px AS (SELECT CAST(event_id // {WIDTH} AS INT) AS y, CAST(event_id % {WIDTH} AS INT) AS x, CAST(floor(value * 0.5) AS INT) AS v FROM events)"


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White where v >= 25, black else."""
    return pixels(spark, sf_dir).withColumn("v", F.when(F.col("v") >= 25, 255).otherwise(0))


BIN = PX + ", bin AS (SELECT y, x, CASE WHEN v >= 25 THEN 255 ELSE 0 END AS v FROM px)"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, code): the signs of a vector's first components, the first the highest bit."""
    e = table(spark, sf_dir, "embeddings")
    bits = F.aggregate(F.slice("embedding", 1, NBITS), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0))
    return e.select(F.col("vec_id").alias("id"), bits.alias("code"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(probe_id, rcode): codes with one to three bits flipped."""
    flip = lambda k: F.expr(f"shiftleft(1L, CAST((id * 7 + {k} * 11) % {NBITS} AS INT))")
    n = F.col("id") % 3
    r = F.col("code").bitwiseXOR(flip(0)).bitwiseXOR(F.when(n >= 1, flip(1)).otherwise(F.lit(0).cast("long"))).bitwiseXOR(F.when(n >= 2, flip(2)).otherwise(F.lit(0).cast("long")))
    return codes(spark, sf_dir).select(F.col("id").alias("probe_id"), r.alias("rcode"))


def near_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes, and each with one to three bits flipped under the id -1 - id: a table with close pairs."""
    flipped = probes(spark, sf_dir).select((-1 - F.col("probe_id")).alias("id"), F.col("rcode").alias("code"))
    return codes(spark, sf_dir).unionByName(flipped)


CODES = f"codes AS (SELECT vec_id AS id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(embedding[1:{NBITS}], lambda x: CAST(x > 0 AS BIGINT))), lambda a, b: a * 2 + b) AS code FROM embeddings)"
PROBES = CODES + f""", probes AS (SELECT id AS probe_id, xor(xor(xor(code, CAST(1 AS BIGINT) << CAST((id * 7) % {NBITS} AS INT)),
  CASE WHEN id % 3 >= 1 THEN CAST(1 AS BIGINT) << CAST((id * 7 + 11) % {NBITS} AS INT) ELSE 0 END),
  CASE WHEN id % 3 >= 2 THEN CAST(1 AS BIGINT) << CAST((id * 7 + 22) % {NBITS} AS INT) ELSE 0 END) AS rcode FROM codes)"""


NEAR_CODES = PROBES + ", near_codes AS (SELECT id, code FROM codes UNION ALL SELECT -1 - probe_id, rcode FROM probes)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(box_id, fam, hamming, margin, x0, y0): squares of side 5 on a 40 x 40 field."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("box_id"), F.col("p_brand").alias("fam"), F.col("p_size").alias("hamming"), F.col("p_retailprice").alias("margin"),
        (F.col("p_partkey") % 40).cast("int").alias("x0"), (F.col("p_partkey") * 7 % 40).cast("int").alias("y0"),
    )


BOXES = "boxes AS (SELECT p_partkey AS box_id, p_brand AS fam, p_size AS hamming, p_retailprice AS margin, CAST(p_partkey % 40 AS INT) AS x0, CAST(p_partkey * 7 % 40 AS INT) AS y0 FROM part)"

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered points by supplier and weight, whole numbers as doubles."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_suppkey").alias("k"), *ORDER, (F.col("l_orderkey") % 50).cast("double").alias("x"), (F.col("l_partkey") % 40).cast("double").alias("y"), (F.floor("l_quantity") + 1).cast("double").alias("w"), F.floor("l_quantity").cast("double").alias("q")
    )


SEQ = f"""seq AS (SELECT l_suppkey AS k, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n,
  CAST(l_orderkey % 50 AS DOUBLE) AS x, CAST(l_partkey % 40 AS DOUBLE) AS y, CAST(floor(l_quantity) + 1 AS DOUBLE) AS w, CAST(floor(l_quantity) AS DOUBLE) AS q
  FROM lineitem WINDOW o AS (PARTITION BY l_suppkey ORDER BY {', '.join(ORDER)}))"""


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(quad_id, q): four corners by keys of part, many of them no proper quadrilaterals."""
    k = F.col("p_partkey")
    corner = lambda ax, ay, mx, my, nx, ny: F.struct((F.lit(ax) + k * mx % nx).cast("double").alias("x"), (F.lit(ay) + k * my % ny).cast("double").alias("y"))
    return table(spark, sf_dir, "part").select(k.alias("quad_id"), F.array(*(corner(*c) for c in CORNERS)).alias("q"))


#: Corner k of a quad: (ax + key * mx % nx, ay + key * my % ny).
CORNERS = [(0, 0, 1, 3, 7, 5), (10, 0, 5, 1, 11, 6), (9, 9, 7, 2, 13, 8), (0, 8, 1, 4, 5, 9)]
QUADS = "quads AS (SELECT p_partkey AS quad_id, " + ", ".join(f"({ax} + p_partkey * {mx} % {nx})::DOUBLE AS x{k}, ({ay} + p_partkey * {my} % {ny})::DOUBLE AS y{k}" for k, (ax, ay, mx, my, nx, ny) in enumerate(CORNERS)) + " FROM part)"
