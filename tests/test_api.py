import glob
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.api import Dataset
from ledgerloom.functions.columns import sequence_key
from ledgerloom.plans.guard import Refused
from ledgerloom.sources.store import Store

SCHEMA = {"usd__transfer": {"from": "address", "to": "address", "value": "word32"}, "usd__approval": {"owner": "address"}}


def rows(spark, blocks):
    df = spark.createDataFrame([(b, 0, "0xA", f"0x{b}", str(10 * b), "0xb", "0xt", "0xc", b) for b in blocks], "block_number long, log_index long, `from` string, `to` string, value string, block_hash string, tx_hash string, address string, block_timestamp long")
    return df.withColumn("_seq", sequence_key(F.col("block_number"), F.col("log_index")))


@pytest.fixture
def dataset(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.seal(spark, {"usd__transfer": rows(spark, [1, 2])}, 1, 2, advance=True)
    s.seal(spark, {"usd__transfer": rows(spark, [3, 4])}, 3, 4, advance=True)
    s.commit_window({"usd__transfer": rows(spark, [4, 5])}, {5: "h"}, 5, 0)
    labels = spark.createDataFrame([("0x5", "shop")], "address string, label string")
    return Dataset(s, SCHEMA, labels, {"1.sql": "CREATE VIEW big AS SELECT * FROM usd__transfer WHERE value_dec >= 40"})


def test_surface_of_a_dataset(spark, dataset):
    assert dataset.tables() == ["big", "labels", "usd__approval", "usd__transfer"]
    got = dataset.sql("SELECT count(*), sum(value_dec) FROM usd__transfer")
    assert tuple(got.rows[0]) == (5, 150) and (got.as_of, got.sealed_through, got.degraded_tables) == (5, 4, [])
    assert dataset.sql("SELECT count(*) FROM big").rows[0][0] == 2 and dataset.sql("SELECT count(*) FROM usd__approval").rows[0][0] == 0
    assert [r["block_number"] for r in dataset.table("usd__transfer", 2).collect()] == [5, 4]
    assert dataset.entity("000000000005-000000").count() == 2  # the table and the view over it
    assert dataset.balance("usd__transfer", "0X5").first()["balance"] == "50" and dataset.top_balances("usd__transfer", 1).first()["address"] == "0x5"
    assert [(r["label"], r["direction"]) for r in dataset.exposure("usd__transfer", "0xa").collect()] == [("shop", "out")]
    assert dataset.flags("usd__transfer", "threshold", 50).count() == 1 and dataset.flags("usd__transfer", "velocity", 150).first()["n"] == 5
    assert dataset.screen("usd__transfer", spark.createDataFrame([("0X3",)], "address string")).count() == 1
    assert dataset.entities(3).count() == 3 and not dataset.explain("SELECT nope FROM big")["valid"] and dataset.schema()["usd__transfer"]["footguns"]
    for bad in (lambda: dataset.table("nosuch"), lambda: dataset.flags("usd__transfer", "odd", 1)):
        with pytest.raises(Refused):
            bad()
    dataset.store.commit_window({"usd__transfer": rows(spark, [6])}, {6: "i"}, 6, 1)
    assert dataset.sql("SELECT count(*) FROM usd__transfer").rows[0][0] == 6


def test_damaged_segment_is_left_out(spark, dataset):
    bad = dataset.store.segments("usd__transfer")[0]
    for f in glob.glob(f"{dataset.store.root}/{bad.file}/part-*.parquet"):
        raw = bytearray(open(f, "rb").read())
        footer = int.from_bytes(raw[-8:-4], "little")
        for k in range(4, len(raw) - 8 - footer):
            raw[k] ^= 0xFF
        open(f, "wb").write(raw)
    for f in glob.glob(f"{dataset.store.root}/{bad.file}/.part-*.crc"):
        import os

        os.remove(f)
    got = dataset.sql("SELECT sum(value_dec) FROM usd__transfer")
    assert got.degraded_tables == ["usd__transfer"] and got.rows[0][0] == 120
