import os

import pytest

SF = "/root/testdata/sf0.001"


def _norm(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)


def _names():
    from ledgerloom.plans.registry import QUERIES

    return sorted(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", _names())
def test_against_sql(spark, name):
    import duckdb

    from ledgerloom.plans.registry import ORACLE_SQL, QUERIES

    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    if name not in ORACLE_SQL:
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert _norm(got) == _norm(con.sql(f"SELECT {quoted} FROM ({ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["address", "balance"] and set(e.oracle_sql()) <= set(e.queries())


def test_dealt_leaves_large_tables(spark, tmp_path):
    from ledgerloom.sources.facts import dealt

    path = str(tmp_path / "t")
    spark.range(1000).coalesce(1).write.parquet(path)
    small = dealt(spark.read.parquet(path), "id")
    assert small.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and small.count() == 1000
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        assert "Exchange" not in dealt(spark.read.parquet(path), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
