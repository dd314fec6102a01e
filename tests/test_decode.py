import pytest

from ledgerloom.functions.keccak import keccak256
from ledgerloom.operators import decode as D
from ledgerloom.operators import factory as Fa
from ledgerloom.sources.abi import Registry, schema_tables

TOKEN, MAKER = "0x" + "ab" * 20, "0x" + "cd" * 20


def word(x):
    return f"{x:064x}"


def topic(sig):
    return "0x" + keccak256(sig.encode()).hex()


ABI = [
    {"type": "event", "name": "Transfer", "inputs": [{"name": "from", "type": "address", "indexed": True}, {"name": "to", "type": "address", "indexed": True}, {"name": "value", "type": "uint256"}]},
    {"type": "event", "name": "Note", "inputs": [{"name": "id", "type": "uint64", "indexed": True}, {"name": "text", "type": "string"}, {"name": "tags", "type": "uint16[]"}, {"name": "key", "type": "string", "indexed": True}]},
    {"type": "event", "name": "Flag", "inputs": [{"name": "", "type": "bool"}, {"name": "code", "type": "bytes4"}]},
    {"type": "event", "name": "Hidden", "anonymous": True, "inputs": []},
    {"type": "function", "name": "transfer", "inputs": [{"name": "to", "type": "address"}, {"name": "value", "type": "uint256"}]},
]


def registry():
    r = Registry()
    r.add("token", ABI, TOKEN, functions=["transfer"])
    return r


def log(address, topics, data, block=1, index=0):
    return (address, topics, data, block, "0xb", 1_700_000_000 + block, "0xt", index)


def test_registry():
    r = registry()
    assert sorted(r.tables()) == ["token__call_transfer", "token__flag", "token__note", "token__transfer"]
    assert r.anonymous == 1 and r.tables()["token__transfer"].is_transfer and not r.tables()["token__note"].is_transfer
    assert r.tables()["token__note"].columns == ["id", "text", "tags", "key_hash"] and r.tables()["token__flag"].columns == ["arg0", "code"]
    with pytest.raises(ValueError):
        Registry().add("x", ABI, TOKEN, events=["Trasnfer"])
    other = Registry()
    other.add("token", ABI[::-1], TOKEN, functions=["transfer"])
    assert other.content_hash() == r.content_hash() != Registry().content_hash()
    import json

    assert schema_tables(json.dumps(r.schema()))["token__transfer"] == {"from": "address", "to": "address", "value": "word32"}


def test_overloads():
    r = Registry()
    r.add("t", [{"type": "event", "name": "E", "inputs": [{"type": "uint8"}]}, {"type": "event", "name": "E", "inputs": [{"type": "bool"}]}], TOKEN)
    assert sorted(r.tables()) == sorted("t__e_" + keccak256(s).hex()[:4] for s in (b"E(uint8)", b"E(bool)"))


def test_decode_events(spark):
    big = 2**255 + 12345
    logs = [
        log(TOKEN.upper().replace("0X", "0x"), [topic("Transfer(address,address,uint256)"), "0x" + word(1), "0x" + word(2)], "0x" + word(big)),
        log(TOKEN, [topic("Note(uint64,string,uint16[],string)"), "0x" + word(7), "0x" + "ee" * 32], "0x" + word(64) + word(128) + word(3) + "616263".ljust(64, "0") + word(2) + word(5) + word(6), 2),
        log(TOKEN, [topic("Flag(bool,bytes4)")], "0x" + word(1) + "deadbeef".ljust(64, "0"), 3),
        log(TOKEN, [topic("Transfer(address,address,uint256)"), "0x" + word(1)], "0x" + word(1), 4),  # a topic is missing
        log(TOKEN, [topic("Note(uint64,string,uint16[],string)"), "0x" + word(7), "0x" + "ee" * 32], "0x" + word(64) + word(128) + word(2**200), 5),  # a damaged length
        log("0x" + "11" * 20, [topic("Flag(bool,bytes4)")], "0x" + word(1) + word(0), 6),  # nobody's
        log(TOKEN, [topic("Nobody()")], "0x", 7),
        log(TOKEN, [], "0x", 8),  # what an anonymous event leaves
        log(TOKEN, None, "0x", 9),
    ]
    assert [r["block_number"] for r in D.log_filter(spark.createDataFrame(logs, D.LOG_SCHEMA), [], [topic("Nobody()")]).collect()] == [7]
    alone = Registry()
    alone.add("token", ABI[:1], TOKEN)
    assert [r["value"] for r in D.decode_events(alone, spark.createDataFrame(logs, D.LOG_SCHEMA))["token__transfer"].collect()] == [str(big)]
    tables = D.decode_events(registry(), spark.createDataFrame(logs, D.LOG_SCHEMA))
    t = tables["token__transfer"].collect()
    assert len(t) == 1 and t[0]["value"] == str(big) and t[0]["from"] == f"0x{1:040x}" and t[0]["address"] == TOKEN and t[0]["_seq"] == 1 << 20
    n = tables["token__note"].collect()
    assert len(n) == 1 and (n[0]["id"], n[0]["text"], n[0]["tags"], n[0]["key_hash"]) == ("7", "abc", '["5", "6"]', "0x" + "ee" * 32)
    f = tables["token__flag"].collect()
    assert [(r["arg0"], r["code"]) for r in f] == [("true", "0xdeadbeef")]


def test_numbers_of_any_size(spark):
    """Built-in decoding of 256-bit words against Python's integers, at the edges of every path."""
    import random

    rng = random.Random(1)
    values = [0, 1, 2**63 - 1, 2**63, 2**64 - 1, 2**64, 2**123, 2**124 - 1, 2**124, 10**38 - 1, 10**38, 10**45, 2**255 - 1, 2**255, 2**256 - 1, 2**256 - 2**63, 2**256 - 2**63 - 1, 2**256 - 10**40]
    values += [rng.getrandbits(rng.randint(1, 256)) for _ in range(60)]
    event = [{"type": "event", "name": "N", "inputs": [{"name": "u", "type": "uint256"}, {"name": "s", "type": "int256"}, {"name": "i", "type": "int64"}, {"name": "w", "type": "uint64"}, {"name": "x", "type": "int128", "indexed": True}]}]
    r = Registry()
    r.add("n", event, TOKEN)
    logs = [log(TOKEN, [topic("N(uint256,int256,int64,uint64,int128)"), "0x" + word(v)], "0x" + word(v).upper() + word(v) * 3, k) for k, v in enumerate(values)]
    logs += [log(TOKEN, [topic("N(uint256,int256,int64,uint64,int128)"), "0x" + word(1)], "0x" + "zz" * 128, 999), log(TOKEN, [topic("N(uint256,int256,int64,uint64,int128)"), "0x" + word(1)], "0x" + word(1) * 3, 999)]
    assert D._fixed_only(r.decoders[0])
    got = {x["block_number"]: x for x in D.decode_events(r, spark.createDataFrame(logs, D.LOG_SCHEMA))["n__n"].collect()}
    assert sorted(got) == list(range(len(values)))
    for k, v in enumerate(values):
        want = D.decode_log(r.decoders[0], logs[k][1], logs[k][2])
        assert {c: got[k][c] for c in want} == want, v


def test_one_scan_for_all_events(spark):
    r = registry()
    logs = spark.createDataFrame([log(TOKEN, [topic("Flag(bool,bytes4)")], "0x" + word(1) + word(0)), log(TOKEN, [topic("Nobody()")], "0x"), log(MAKER, [topic("Flag(bool,bytes4)")], "0x")], D.LOG_SCHEMA)
    assert [x["_table"] for x in D.route(r, logs).collect()] == ["token__flag"]
    tables = D.decode_events(r, logs)
    assert len(tables) == 3 and all("InMemory" in t._jdf.queryExecution().executedPlan().toString() for t in tables.values())


def test_decode_calls(spark):
    rows = [
        (TOKEN, "0xa9059cbb" + word(2) + word(9), 1, "0xb", 1, "0xt", 750_000),
        (TOKEN, "0xa9059cbb" + word(2), 1, "0xb", 1, "0xt", 750_001),
        (TOKEN, "0x12345678", 1, "0xb", 1, "0xt", 750_002),
        (TOKEN, "0x12", 1, "0xb", 1, "0xt", 750_003),
        ("0x" + "11" * 20, "0x12345678", 1, "0xb", 1, "0xt", 750_004),
    ]
    got = D.decode_calls(registry(), spark.createDataFrame(rows, "address string, input string, block_number long, block_hash string, block_timestamp long, tx_hash string, log_index long"))
    assert [(r["to"], r["value"]) for r in got["token__call_transfer"].collect()] == [(f"0x{2:040x}", "9")]
    assert sorted(r["log_index"] for r in got["calls_raw"].collect()) == [750_001, 750_002]


def test_values():
    assert D.decode_values(["(uint8,string)[]"], bytes.fromhex(word(32) + word(1) + word(32) + word(5) + word(64) + word(2) + "6869".ljust(64, "0"))) == [[[5, "hi"]]]
    assert D.decode_values(["int8"], bytes.fromhex("ff" * 32)) == [-1]
    assert D.as_text("u64", 2**70) == str(2**64 - 1) and D.as_text("json", [1, True, "x"]) == '["1", true, "x"]'
    for bad in (["string"], ["uint8[]"]):
        with pytest.raises(ValueError):
            D.decode_values(bad, bytes.fromhex(word(32) + word(2**255)))


def test_filter_must_not_be_empty(spark):
    with pytest.raises(ValueError):
        D.log_filter(spark.createDataFrame([], D.LOG_SCHEMA), [], [])


FACTORY = [{"type": "event", "name": "Made", "inputs": [{"name": "child", "type": "address"}]}]
RULE = Fa.Rule("maker", "maker__made", "child", "pool")


def test_factory_order(spark):
    r = Registry()
    r.add("maker", FACTORY, MAKER)
    r.add("pool", [ABI[2]], None)
    child = "0x" + "77" * 20
    made, flag = topic("Made(address)"), topic("Flag(bool,bytes4)")
    body = "0x" + word(1) + word(0)
    logs = [log(child, [flag], body, 1, 0), log(MAKER, [made], "0x" + "0" * 24 + "77" * 20, 1, 1), log(child, [flag], body, 1, 2), log(MAKER, [made], "0x" + "0" * 24 + "77" * 20, 2, 0), log(child, [flag], body, 3, 0), log("0x" + "88" * 20, [flag], body, 3, 1)]
    tables, children = Fa.decode_window(r, spark.createDataFrame(logs, D.LOG_SCHEMA), [RULE], {"pool"})
    assert sorted((x["block_number"], x["log_index"]) for x in tables["pool__flag"].collect()) == [(1, 2), (3, 0)]
    kids = children.collect()
    assert len(kids) == 1 and (kids[0]["discovered_block"], kids[0]["discovered_log_index"]) == (1, 1)
    assert Fa.content_hash(children) == Fa.content_hash(children.repartition(3)) and Fa.rollback(children, 0).count() == 0


def test_factory_rules():
    ok = Fa.validate([RULE, Fa.Rule("pool", "pool__flag", "x", "leaf")], {"maker"}, {"pool", "leaf"})
    assert [len(x) for x in ok] == [1, 1]
    for rules, contracts, templates in [
        ([RULE], {"maker", "pool"}, {"pool"}),
        ([RULE, RULE], {"maker"}, {"pool"}),
        ([RULE], set(), {"pool"}),
        ([RULE], {"maker"}, set()),
        ([Fa.Rule("a", "t", "c", "b"), Fa.Rule("b", "t", "c", "c"), Fa.Rule("c", "t", "c", "d"), Fa.Rule("d", "t", "c", "e")], {"a"}, set("bcde")),
        ([Fa.Rule("b", "t", "c", "b")], {"a"}, {"b"}),
    ]:
        with pytest.raises(ValueError):
            Fa.validate(rules, contracts, templates)
