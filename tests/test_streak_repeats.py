"""A user with several rows in the table of users has every streak once for each of them, as in the SQL's join."""

import duckdb

from tapeloom.plans import oracle, queries

SF = "/root/testdata/sf0.001"


def test_repeated_customers_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE customer AS SELECT * FROM '{SF}/customer.parquet' UNION ALL SELECT * FROM '{SF}/customer.parquet' WHERE c_custkey < 9")
    con.execute(f"CREATE TABLE events AS SELECT * FROM '{SF}/events.parquet'")
    for t in ("customer", "events"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = queries.QUERIES["streak_seeded"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle.ORACLE['streak_seeded']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    assert {r.relapse_count for r in df.where("user_id < 9 AND user_id % 3 <> 1").collect()} == {15}
