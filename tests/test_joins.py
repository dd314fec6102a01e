from pyspark.sql import functions as F

from ledgerloom.operators import joins


def test_a_hot_bucket_is_many_tasks(spark, monkeypatch):
    """Nearly all points and ranges in one bucket, some twice: each pair once, and no task with most of them."""
    monkeypatch.setattr(joins, "TILE", 8, raising=False)
    monkeypatch.setattr(joins, "TASK_TILES", 4, raising=False)
    points = [(i // 2, i % 7) for i in range(200)] + [(900, 55), (901, None), (902, 10)]
    ranges = [(i // 2, i % 5, i % 5 + 2) for i in range(60)] + [(800, 50, 60), (801, 8, 22), (802, None, 3), (803, 4, 1)]
    p, r = spark.createDataFrame(points, "p long, at int"), spark.createDataFrame(ranges, "r long, low int, high int")
    # One task a table, as a small file is.
    got = joins.interval(p.coalesce(1), r.coalesce(1), "at", "low", "high", 10)
    assert got.columns == ["p", "at", "r", "low", "high"]
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    want = [(a, at, b, low, high) for a, at in points for b, low, high in ranges if None not in (at, low) and low <= at <= high]
    assert sorted(tuple(x)[:5] for x in rows) == sorted(want) and len(want) > 4000
    tasks = [x["task"] for x in rows]
    assert max(map(tasks.count, set(tasks))) < len(rows) / 3
