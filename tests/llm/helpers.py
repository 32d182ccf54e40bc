"""Comparison with DuckDB over the given tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_as_sql(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql).fetchdf()
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    a = sorted(map(repr, want[columns].astype(object).where(want[columns].notna(), None).itertuples(index=False, name=None)))
    got = df.select(*columns).toPandas()
    b = sorted(map(repr, got.astype(object).where(got.notna(), None).itertuples(index=False, name=None)))
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]
