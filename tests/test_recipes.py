import pyarrow as pa
import pytest

from ledgerloom.functions.columns import ZERO_ADDRESS
from ledgerloom.operators import folds, stages
from ledgerloom.plans.catalog import authored_views
from ledgerloom.plans.recipes import RECIPES, view_sql


def test_recipes_agree_with_folds(spark):
    t = spark.createDataFrame([(1, 0, ZERO_ADDRESS, "0xA", "100"), (2, 0, "0xa", "0xb", "30"), (3, 0, "0xb", ZERO_ADDRESS, "5"), (4, 0, "0xb", "0xc", "9" * 39)], "block_number long, log_index long, `from` string, `to` string, value string")
    s = spark.createDataFrame([("p", 1, 0, "5", "6"), ("p", 2, 0, "7", "8"), ("p", 1, 9, "1", "1")], "address string, block_number long, log_index long, reserve0 string, reserve1 string")
    views, report = authored_views(spark, {"usd__transfer": t, "usd__sync": s}, {f"{n}.sql": view_sql(n, "usd") for n in RECIPES})
    assert not report.failed
    assert sorted(map(tuple, views["usd_balances"].collect())) == sorted(map(tuple, folds.balances(t).collect())) == [("0xa", 70), ("0xb", 25)]
    assert views["usd_total_supply"].first()[0] == folds.total_supply(t).first()[0] == 95
    assert views["usd_holder_count"].first()[0] == folds.holder_count(t).first()[0] == 2
    assert [tuple(r) for r in views["usd_reserves"].collect()] == [tuple(r) for r in folds.latest_reserves(s).collect()] == [("p", 7, 8)]
    for bad in (("nosuch", "usd"), ("balances", "usd; DROP")):
        with pytest.raises(ValueError):
            view_sql(*bad)


def test_stages(spark):
    t = spark.createDataFrame([("5",), ("1000000000",), (None,)], "value string")
    assert stages.large_only(t).count() == 1
    got = stages.transform(t, lambda b: pa.RecordBatch.from_arrays([pa.array([len(v or "") for v in b.column(0).to_pylist()])], names=["n"]), "n long")
    assert sorted(r["n"] for r in got.collect()) == [0, 1, 10]
