import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import columns as K
from ledgerloom.functions.cid import parse_cid, verify
from ledgerloom.functions.keccak import keccak256


def test_keccak_vectors():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"Transfer(address,address,uint256)").hex() == "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert keccak256(b"Sync(uint112,uint112)").hex() == "1c411e9a96e071241c2f21f7726b17ae89e3cab4c78be50e062b03a9fffbbad1"
    assert keccak256(b"a" * 500) != keccak256(b"a" * 501)


@pytest.mark.parametrize(
    "sol,indexed,kind",
    [("address", False, "address"), ("uint8", False, "u64"), ("uint64", True, "u64"), ("int64", False, "i64"), ("uint65", False, "word16"), ("int128", False, "word16"), ("uint", False, "word32"), ("uint256", True, "word32"),
     ("bool", False, "bool"), ("bytes4", True, "fixed_bytes"), ("bytes", False, "bytes"), ("bytes", True, "hash32"), ("string", True, "hash32"), ("uint8[]", False, "json"), ("uint8[2]", True, "hash32"), ("(uint8,bool)", False, "json")],
)
def test_storage_kinds(sol, indexed, kind):
    assert K.storage_kind(sol, indexed) == kind


def test_names():
    assert [K.snake_case(x) for x in ("Transfer", "TransferBatch", "URI", "already_snake")] == ["transfer", "transfer_batch", "u_r_i", "already_snake"]
    assert K.parse_entity_id("000000000012-000345") == (12, 345)
    with pytest.raises(ValueError):
        K.parse_entity_id("12-345")


def test_order_keys(spark):
    row = spark.createDataFrame([(5, 3), (5, 1_048_577)], "b long, i long").select(K.sequence_key(F.col("b"), F.col("i")).alias("s"), K.entity_id(F.col("b"), F.col("i")).alias("id")).collect()
    assert row[0].s == 5 << 20 | 3 and row[1].s == 5 << 20 | 1 and row[0].id == "000000000005-000003"


def test_big_columns(spark):
    rows = [("1" + "0" * 37,), ("9" * 39,), ("x",), (None,), ("-7",)]
    got = K.with_big_columns(spark.createDataFrame(rows, "v string"), ["v"]).collect()
    assert [(r.v_dec is None, r.v_overflow) for r in got] == [(False, False), (True, True), (True, True), (True, False), (False, False)]


def test_conform_and_empty(spark):
    df = spark.createDataFrame([(1, "a")], "block_number int, x string")
    got = K.conform(df, ["_seq", "block_number", "x", "y"]).collect()[0]
    assert (got._seq, got.block_number, got.x, got.y) == (0, 1, "a", None)
    assert K.empty_table(spark, ["block_number", "v"], ["v"]).columns == ["block_number", "v", "v_dec", "v_overflow"]


def test_cids():
    content = b"hello\n"
    v0 = "QmZULkCELmmk5XNfCgTnCyFgAVxBRBXyDHGGMVoLFLiXEN"
    assert verify(parse_cid(v0), content) and not verify(parse_cid(v0), b"other")
    assert parse_cid("ipfs://" + v0 + "/x").digest == parse_cid(v0).digest
    for bad in ("", "Qm123", "b!!", "zzz"):
        with pytest.raises(ValueError):
            parse_cid(bad)
