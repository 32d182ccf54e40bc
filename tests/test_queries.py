"""Every driver query that has SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from markerlake.plans.registry import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, name):
    df = queries()[name](spark, sf)
    if name not in oracle_sql():
        assert df.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(oracle_sql()[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(df.toPandas()) == rows(want)


def test_whole_family(spark, sf):
    from markerlake.operators.codes import min_distance
    from markerlake.plans import virtual as v

    family = v.codes(spark, sf)
    codes = [r.code for r in family.collect()]
    want = min((a ^ b).bit_count() for i, a in enumerate(codes) for b in codes[:i])
    assert [r.min_distance for r in queries()["family_min_distance"](spark, sf).collect()] == [want]
    one_off = family.unionByName(family.filter("id = 300").selectExpr("100000L AS id", "code ^ 1L AS code"))
    assert min_distance(one_off, v.NBITS, turns=False).first()[0] == 1


def test_dominance_of_copies_and_nulls(spark, tmp_path):
    """Many boxes on each place: SQL's rows, also for nulls and NaN, and no table of boxes at the driver."""
    con = duckdb.connect()
    con.execute("""CREATE VIEW part AS SELECT CASE WHEN i % 501 <> 0 THEN i END AS p_partkey, CASE WHEN i % 211 <> 0 THEN 'Brand#' || i // 7 % 3 END AS p_brand,
      CASE WHEN i % 13 <> 0 THEN (i * 31 % 17 // 5)::INT END AS p_size, CASE WHEN i % 19 = 0 THEN NULL WHEN i % 97 = 0 THEN 'NaN'::DOUBLE ELSE i * 37 % 11 * -0.5 END AS p_retailprice FROM range(3000) t(i)""")
    con.execute(f"COPY part TO '{tmp_path}/part.parquet'")
    df = queries()["reconcile_dominance"](spark, str(tmp_path))
    got = sorted(map(repr, (r.box_id for r in df.collect())))
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert got == sorted(repr(i) for (i,) in con.execute(oracle_sql()["reconcile_dominance"]).fetchall()) and len(got) > 6


def test_disc_far_from_its_centre(spark):
    from markerlake.operators.raster import draw_disc

    far = 2**31 - 1
    px = spark.createDataFrame([(0, y, x, 7) for y, x in ((5, 50), (8, 50), (5, 56), (5, 57), (46346, 50), (far, far), (-far, -far))], "image_id int, y int, x int, v int")
    got = {(r.y, r.x): r.v for r in draw_disc(px, 50, 5, 3, 6, 200).collect()}
    assert got == {(5, 50): 7, (8, 50): 200, (5, 56): 200, (5, 57): 7, (46346, 50): 7, (far, far): 7, (-far, -far): 7}
    assert [r.v for r in draw_disc(px, far, far, 0, 1, 200).orderBy("y").collect()].count(200) == 1
