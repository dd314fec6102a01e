import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.columns import BIG, sequence_key
from ledgerloom.operators import folds
from ledgerloom.sources.store import FinalityFault, HotScanTooLarge, Store, rows_hash, seal_cuts
from ledgerloom.streaming import deltas, ingest

NAMES = ["_seq", "block_number", "from", "log_index", "to", "value"]
T = {"t": NAMES}


def rows(spark, blocks, value="5"):
    df = spark.createDataFrame([(b, 0, f"a{b % 3}", f"a{(b + 1) % 3}", value) for b in blocks], "block_number long, log_index long, `from` string, `to` string, value string")
    return df.withColumn("_seq", sequence_key(F.col("block_number"), F.col("log_index")))


def blocks_of(df):
    return sorted(r["block_number"] for r in df.collect())


def test_union_is_disjoint(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.commit_window({"t": rows(spark, range(0, 6))}, {5: "a"}, 5, 0)
    assert blocks_of(s.view("t", NAMES)) == list(range(6))  # genesis is served before anything is sealed
    s.commit_window({"t": rows(spark, range(6, 10))}, {9: "b"}, 9, 1)
    s.commit_window({"t": rows(spark, range(6, 10))}, {9: "b"}, 9, 1)  # the batch runs again
    assert blocks_of(s.view("t", NAMES)) == list(range(10))
    s.seal_and_prune(6, T)
    assert s.state().sealed_through == 6 and blocks_of(s.view("t", NAMES)) == list(range(10))
    assert blocks_of(s.hot("t", NAMES)) == [7, 8, 9]
    before = s.state().tables
    s.rollback(7, T)
    assert blocks_of(s.view("t", NAMES)) == list(range(8)) and s.state().tables == before
    with pytest.raises(FinalityFault):
        s.rollback(5, T)
    with pytest.raises(HotScanTooLarge):
        s.hot("t", NAMES, most=0)


def test_only_the_surface_refuses_a_large_tip(spark, tmp_path):
    from ledgerloom.plans.catalog import dataset_views
    from ledgerloom.sources.store import MOST_HOT_ROWS

    s = Store(spark, str(tmp_path))
    s.commit_window({"t": spark.range(MOST_HOT_ROWS + 1).select(F.col("id").alias("block_number"), F.lit(0).cast("long").alias("log_index"))}, {}, MOST_HOT_ROWS, 0)
    assert s.view("t", ["block_number", "log_index"]).count() == MOST_HOT_ROWS + 1
    with pytest.raises(HotScanTooLarge):
        dataset_views(s, {})


def test_segments_depend_on_rows_only(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "a"), str(tmp_path / "shared")), Store(spark, str(tmp_path / "b"), str(tmp_path / "shared"))
    a.seal(spark, {"t": rows(spark, range(5))}, 0, 4, advance=True)
    a.seal(spark, {"t": rows(spark, range(5))}, 0, 4)
    b.seal(spark, {"t": rows(spark, range(5)).repartition(3)}, 0, 4, advance=True)
    assert [s.hash for s in a.segments("t")] == [s.hash for s in b.segments("t")] and len(a.segments("t")) == 1
    assert rows_hash(rows(spark, [1, 1])) != rows_hash(rows(spark, [1]))
    assert a.segments("t", first=9) == []


def test_drift_and_damage(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.seal(spark, {"t": rows(spark, [1, 2])}, 1, 2, advance=True)
    s.seal(spark, {"t": rows(spark, [3]).withColumn("memo", F.lit("m"))}, 3, 3, advance=True)
    got = {r["block_number"]: r["memo"] for r in s.view("t", [*NAMES, "memo"]).collect()}
    assert got == {1: None, 2: None, 3: "m"}
    bad = s.segments("t")[0]
    rows(spark, [1]).write.mode("overwrite").parquet(f"{tmp_path}/{bad.file}")
    assert [(x.hash, why) for _, x, why in s.damaged(["t"])] == [(bad.hash, "other rows")]
    assert [x.hash for x in s.quarantine()] == [bad.hash] and blocks_of(s.view("t", [*NAMES, "memo"])) == [3]


def test_seal_cuts(spark):
    got = sorted(map(tuple, seal_cuts(rows(spark, [1, 1, 1, 2, 2, 3, 4]), 2).collect()))
    # Blocks start after 0, 3, 5 and 6 rows, so they fall into the parts 0, 1, 2 and 3 of two rows each.
    assert got == [(1, 1, 3), (2, 2, 2), (3, 3, 1), (4, 4, 1)]


def test_late_rows_stop_the_stream(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    told = []
    d = ingest.Dataset(s, lambda logs: {"t": logs}, T, on_change=[lambda tables, w: told.append((w, tables["t"].count()))])
    ingest.apply_window(d, rows(spark, range(1, 5)), {4: "h4"}, 4, 0)
    ingest.revert_to(d, 3)
    s.seal_and_prune(2, T)
    assert told == [(1, 4), (-1, 1)]
    run = ingest.for_each_batch([d], lambda batch: {})
    with pytest.raises(FinalityFault):
        run(rows(spark, [2]), 1)
    assert isinstance(d.fault, FinalityFault)


def test_a_failing_dataset_is_set_aside(spark, tmp_path):
    good = ingest.Dataset(Store(spark, str(tmp_path / "a")), lambda logs: {"t": logs}, T)
    bad = ingest.Dataset(Store(spark, str(tmp_path / "b")), lambda logs: {"t": logs.select("missing")}, T)
    run = ingest.for_each_batch([bad, good], lambda batch: {})
    run(rows(spark, [1]), 0)
    run(rows(spark, [2]), 1)
    assert bad.fault is not None and good.fault is None and blocks_of(good.store.view("t", NAMES)) == [1, 2]


def test_a_batch_follows_a_reorganisation(spark, tmp_path):
    told = []
    d = ingest.Dataset(Store(spark, str(tmp_path)), lambda logs: {"t": logs}, T, on_change=[lambda tables, w: told.append((w, sorted(r["block_number"] for r in tables["t"].collect())))])
    now = {2: "h2", 4: "h4"}
    chain = ingest.Chain(lambda blocks: {b: now[b] for b in blocks if b in now}, lambda a, b: rows(spark, [x for x in (3, 4) if a <= x <= b]))
    top = lambda batch: (lambda m: {m: now.get(m, f"h{m}")})(batch.agg(F.max("block_number")).first()[0])
    run = ingest.for_each_batch([d], top, chain)
    run(rows(spark, [1, 2]), 0)
    run(rows(spark, [3, 3, 4]), 1)
    now[4] = "other"
    run(rows(spark, [5]), 2)
    assert told == [(1, [1, 2]), (1, [3, 3, 4]), (-1, [3, 3, 4]), (1, [3, 4, 5])] and blocks_of(d.store.view("t", NAMES)) == [1, 2, 3, 4, 5]
    d.store.seal_and_prune(4, T)
    now[2] = now[4] = "gone"
    with pytest.raises(FinalityFault):
        run(rows(spark, [6]), 3)


def test_segments_dont_depend_on_when_sealing_ran(spark, tmp_path):
    blocks = [b for b in range(1, 30) for _ in range(b % 4 + 1)]
    cuts = []
    for name, steps in (("a", [29]), ("b", [7, 8, 19, 29])):
        s = Store(spark, str(tmp_path / name))
        s.commit_window({"t": rows(spark, blocks)}, {}, 29, 0)
        for ceiling in steps:
            s.seal_and_prune(ceiling, T, size=10)
        cuts.append([(x.from_block, x.to_block, x.rows, x.hash) for x in s.segments("t")])
        assert s.view("t", NAMES).count() == len(blocks)
    assert len(cuts[0]) > 3 and cuts[0] == cuts[1]


def test_many_ranges_are_sealed_in_as_many_jobs_as_few(spark, tmp_path):
    blocks, jobs = list(range(1, 61)), {}
    for size in (30, 2):
        s = Store(spark, str(tmp_path / str(size)))
        s.commit_window({"t": rows(spark, blocks)}, {}, 60, 0)
        spark.sparkContext.setJobGroup(f"seal by {size}", "")
        try:
            s.seal_and_prune(60, T, size=size)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[size] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"seal by {size}"))
        assert [(x.to_block, x.rows) for x in s.segments("t")] == [(b, size) for b in range(size, 61, size)]
        assert s.damaged() == [] and blocks_of(s.view("t", NAMES)) == blocks and s.hot("t", NAMES).count() == 0
    assert 0 < jobs[2] <= jobs[30]
    assert s.segments("t")[0].hash == rows_hash(rows(spark, [1, 2]).select(*NAMES))


def test_a_large_table_goes_through_the_store(spark, tmp_path, monkeypatch):
    from ledgerloom.sources import store

    monkeypatch.setattr(store, "TASK_ROWS", 25_000, raising=False)
    names, last = ["block_number", "log_index", "value"], 100_000 + store.MOST_HOT_ROWS
    table = spark.range(1, last + 1).select(F.col("id").alias("block_number"), (F.col("id") % 3).alias("log_index"), F.col("id").cast("string").alias("value"))
    s = Store(spark, str(tmp_path))
    s.commit_window({"t": table}, {last: "a"}, last, 0)
    s.rollback(last - 10, {"t": names})
    s.commit_window({"t": table.where(F.col("block_number") > last - 10)}, {last: "b"}, last, 1)
    s.seal_and_prune(99_999, {"t": names})
    view = s.view("t", names, ["value"])
    # More rows stay hot than callers may read; a job reads them all.
    assert s.hot("t", names).count() == store.MOST_HOT_ROWS + 1
    assert tuple(view.agg(F.count("*"), F.sum("value_dec"), F.countDistinct("block_number")).first()) == (last, last * (last + 1) // 2, last)
    (sealed,) = s.segments("t")
    files = spark.read.parquet(f"{tmp_path}/{sealed.file}").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()
    assert len(files) == 3 and sum(f["n"] for f in files) == sealed.rows == 99_999 and s.damaged() == []


def test_stream_end_to_end(spark, tmp_path):
    import json

    from ledgerloom.sources import replay

    replay.register(spark)
    logs = [["0xaa", ["0x1"], "0x", b, f"h{b}", b, "t", 0] for b in range(10)]
    stream = spark.readStream.format("ledger_replay").option("logs", json.dumps(logs)).option("last", 9).option("window", 4).load()
    s = Store(spark, str(tmp_path / "store"))
    d = ingest.Dataset(s, lambda df: {"t": df.select("block_number", "log_index", F.lit("a").alias("from"), F.lit("b").alias("to"), F.lit("1").alias("value"))}, T)
    q = stream.writeStream.foreachBatch(ingest.for_each_batch([d], ingest.block_hashes)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    ingest.ensure_running(q)
    got = s.view("t", NAMES)
    assert set(blocks_of(got)) <= set(range(10)) and got.count() == len(set(blocks_of(got)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(1, 9)), max_size=12), st.integers(0, 12))
def test_retraction_converges(spark, moves, keep):
    """Apply all, take back a tail, apply it again: the same as applying once."""
    data = [(i, 0, f"a{f}", f"a{t}", str(v)) for i, (f, t, v) in enumerate(moves)]
    df = spark.createDataFrame(data, "block_number long, log_index long, `from` string, `to` string, value string")
    tail = df.where(F.col("block_number") >= keep)
    state = folds.net_balances(df)
    for w in (-1, 1):
        state = deltas.merge(deltas.BALANCE, state, deltas.balance_delta(deltas.with_weight(tail, w)))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, folds.net_balances(df).collect()))


def test_ingest_pieces(spark, tmp_path):
    assert ingest.watermark(100, 12) == 88 and ingest.watermark(100, 12, 120) == 100 and ingest.watermark(5, 12) == -1
    assert ingest.start_block(100, backfill=30) == 70 and ingest.start_block(100, starts=[50, 20]) == 20 and ingest.start_block(6000) == 1000
    w = ingest.WindowSize(size=100)
    assert w.grew(100, 10) == 400 and w.refused() == 200

    class No(Exception):
        pass

    def fetch(a, b):
        if b - a > 1:
            raise No
        return (a, b)

    assert [(a, b) for a, b, _ in ingest.fetch_split(fetch, 0, 6, No)] == [(0, 1), (2, 3), (4, 5), (6, 6)]
    chunks = []
    df = rows(spark, range(1, 8))
    assert ingest.deliver_sealed(df, 1, 7, lambda b: chunks.append(b) or True, size=2) == 7 and len(chunks) == 3
    assert ingest.deliver_sealed(df, 1, 7, lambda b: False, size=2) == 1
    assert ingest.webhook_start("genesis", 9) == -1 and ingest.webhook_start("registration", 9) == 9 and ingest.webhook_start(4, 9) == 3
    box = ingest.Outbox(spark, str(tmp_path / "box"), most=2)
    flags = df.limit(1).select("block_number", "log_index")
    key = ["block_number", "log_index"]
    box.put(flags, 1, key, 1)
    box.put(flags, -1, key, 2)
    with pytest.raises(OverflowError):
        box.put(df.where("block_number > 3").limit(1), 1, key, 2)
    sent = []
    assert box.deliver(lambda kind, body: sent.append(kind) or True) == 2 and sorted(sent) == ["flag", "flag_retracted"]
    assert box.deliver(lambda *a: True) == 0
    # The flag comes back on the new branch: a third alert; the same batch again adds none.
    box.put(flags, 1, key, 2)
    box.put(flags, 1, key, 2)
    assert box.deliver(lambda kind, body: sent.append(kind) or True) == 1 and sorted(sent) == ["flag", "flag", "flag_retracted"]
    seen = spark.createDataFrame([(1, "a"), (2, "b")], "block_number long, block_hash string")
    assert ingest.reorg_point(seen, seen) is None
    assert ingest.reorg_point(seen, spark.createDataFrame([(1, "a"), (2, "x")], seen.schema)) == 1
    assert ingest.reorg_point(seen, spark.createDataFrame([], seen.schema)) == 0


def test_folds_on_exact_numbers(spark):
    df = spark.createDataFrame([(1, 0, "a", "b", "1" + "0" * 20), (2, 0, "b", "c", "30"), (3, 0, "c", "c", "9" * 39)], "block_number long, log_index long, `from` string, `to` string, value string")
    got = {r["address"]: int(r["balance"]) for r in folds.net_balances(df).collect()}
    assert got == {"a": -(10**20), "b": 10**20 - 30, "c": 30}
    assert folds.velocity(df, 7200).agg(F.sum("n").cast(BIG)).first()[0] == 2
    labels = spark.createDataFrame([("A", "x"), ("a", "x")], "address string, label string")
    assert [(r["address"], r["direction"], r["n"]) for r in folds.exposure(df, labels).collect()] == [("b", "in", 1)]
    with pytest.raises(ValueError):
        folds.bucket(F.col("block_number"), 0)
