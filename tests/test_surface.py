import time

import pytest

from ledgerloom.functions.columns import with_big_columns
from ledgerloom.plans import catalog, checks, identity, semantic
from ledgerloom.plans.guard import Refused, Surface, scrub, split_statements
from ledgerloom.plans.named import NamedQuery, Queries


@pytest.fixture(scope="module")
def surface(spark):
    t = spark.createDataFrame([(i, 0, f"a{i % 2}", "b", str(100 * i), "true") for i in range(1, 11)], "block_number long, log_index long, `from` string, `to` string, value string, ok string")
    return Surface(spark, {"usdc__transfer": with_big_columns(t, ["value"])}, most_rows=5)


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE usdc__transfer", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc/passwd`", "SELECT java_method('java.lang.System', 'exit', '0')", "SELECT reflect('a', 'b')",
        "SELECT input_file_name() FROM usdc__transfer", "SELECT * FROM nosuch", "INSERT INTO usdc__transfer SELECT * FROM usdc__transfer", "SELECT (SELECT max(1) FROM csv.`/x`)", "SET spark.x=1",
        "WITH a AS (SELECT * FROM json.`/x`) SELECT * FROM a", "SELECT * FROM usdc__transfer t ASOF JOIN usdc__transfer u ON t.block_number >= u.block_number", "SELECT 1 WHERE EXISTS (SELECT * FROM orc.`/x`)",
        "SELECT sum(value) FROM usdc__transfer", "SELECT * FROM read_files('/x')", "", "SELECT '" + "x" * 20000 + "'", "SELECT 1 WHERE 1 IN (SELECT * FROM text.`/x`)", "SHOW TABLES", "EXPLAIN SELECT 1",
    ],
)
def test_refusals(surface, sql):
    assert not surface.explain(sql)["valid"]


@pytest.mark.parametrize(
    "sql,want",
    [
        ("SELECT count(*) AS n FROM usdc__transfer;", 10),
        ("-- note; with a semicolon\nSELECT sum(value_dec) FROM usdc__transfer", 5500),
        ("/* a /* nested */ comment */ WITH x AS (SELECT * FROM usdc__transfer WHERE \"from\" = 'a1') SELECT count(*) FROM x", 5),
        ("SELECT count(*) FROM range(3)", 3),
        ("SELECT length('a;b')", 3),
        ("SELECT max(x) FROM (SELECT explode(sequence(1, 4)) AS x)", 4),
        ("SELECT count(*) FROM usdc__transfer a JOIN usdc__transfer b USING (block_number)", 10),
        ("SELECT max(v) FROM VALUES (1), (2) AS t(v)", 2),
    ],
)
def test_answers(surface, sql, want):
    assert surface.run(sql).rows[0][0] == want


def test_caps_and_hints(surface):
    got = surface.run("SELECT block_number FROM usdc__transfer ORDER BY 1")
    assert got.truncated and len(got.rows) == 5
    assert "usdc__transfer" in surface.explain("SELECT * FROM usdc__transfr")["error"]
    assert "value" in surface.explain("SELECT valeu FROM usdc__transfer")["error"]
    assert "value_dec" in surface.explain("SELECT avg(value) FROM usdc__transfer")["error"]
    assert scrub("cannot read file:/root/a/b.parquet now") == "cannot read <path> now"
    assert split_statements("a; b -- c;\n; 'd;e'") == ["a", "b", "'d;e'"]


SLOW = "SELECT count(*) FROM range(100000000000) WHERE sha2(cast(id AS string), 256) LIKE '0000000000%'"


def test_deadline(spark):
    slow = Surface(spark, {}, deadline_s=0.5)
    for _ in range(3):
        began = time.monotonic()
        with pytest.raises(TimeoutError):
            slow.run(SLOW)
        # The cores are free at once: neither the query nor a slot lingers.
        assert Surface(spark, {}).run("SELECT count(*) FROM range(1000000)").rows[0][0] == 1000000
        assert time.monotonic() - began < 10
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_deadline_during_planning(spark, monkeypatch):
    slow = Surface(spark, {}, deadline_s=0.2)
    whole = Surface.frame

    def late(self, sql, args=None):
        time.sleep(0.6)
        return whole(self, sql, args)

    monkeypatch.setattr(Surface, "frame", late)
    with pytest.raises(TimeoutError):
        slow.run(SLOW)
    monkeypatch.undo()
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert Surface(spark, {}).run("SELECT 1").rows[0][0] == 1


def test_named(surface):
    q = NamedQuery("q-1", 'SELECT count(*) FROM usdc__transfer WHERE "from" = :who AND block_number >= :least', {"who": "address", "least": "int"})
    named = Queries(surface, "allowlist", [q])
    assert named.listing() == [{"name": "q-1", "params": {"who": "address", "least": "int"}}]
    assert named.named("q-1", {"who": "0x" + "0" * 40, "least": "3"}).collect()[0][0] == 0
    for bad in ({"who": "a1", "least": "3"}, {"who": "0x" + "0" * 40, "least": "3 OR 1=1"}, {"who": "0x" + "0" * 40}, {"who": "0x" + "0" * 40, "least": "1", "x": "1"}):
        with pytest.raises(ValueError):
            named.named("q-1", bad)
    with pytest.raises(Refused):
        named.free("SELECT 1")
    for mode, queries in (("open", [q]), ("allowlist", []), ("odd", [])):
        with pytest.raises(ValueError):
            Queries(surface, mode, queries)
    for wrong in (NamedQuery("a b", "SELECT 1"), NamedQuery("a", "SELECT :x"), NamedQuery("a", "SELECT 1", {"x": "int"}), NamedQuery("a", "SELECT :x", {"x": "text"})):
        with pytest.raises(ValueError):
            wrong.validate()


def test_authored_views(spark, surface):
    files = {"1.sql": "CREATE VIEW va AS SELECT block_number FROM usdc__transfer; CREATE VIEW vbad AS SELECT * FROM missing__t;", "2.sql": "CREATE VIEW vc AS SELECT * FROM vbad; CREATE VIEW vd AS SELECT count(*) AS n FROM va; DROP VIEW va"}
    views, report = catalog.authored_views(spark, surface.tables, files)
    assert report.built == ["va", "vd"] and report.missing["vbad"] == ["missing__t"] and report.root_of["vc"] == "vbad" and len(report.failed) == 3
    assert catalog.base_tables(spark, "SELECT * FROM x2", {"x2": "SELECT * FROM x1", "x1": "SELECT * FROM usdc__transfer"}) == {"usdc__transfer"}


def test_identity(spark, surface):
    key = lambda sql, **k: identity.reuse_key(surface.frame(sql), {"usdc__transfer": "s1", **k})
    a = key("SELECT block_number AS b FROM usdc__transfer t WHERE t.block_number > 1")
    assert a == key("select  block_number as b /* x */ from usdc__transfer u where u.block_number > 1")
    assert len({a, key("SELECT block_number AS c FROM usdc__transfer WHERE block_number > 1"), key("SELECT block_number AS b FROM usdc__transfer WHERE block_number > 2"), key("SELECT DISTINCT block_number AS b FROM usdc__transfer WHERE block_number > 1"), key("SELECT block_number AS b FROM usdc__transfer t WHERE t.block_number > 1", usdc__transfer="s2")}) == 5
    assert identity.refusals(spark, "SELECT now(), rand() FROM usdc__transfer LIMIT 3") == ["now is volatile", "rand is volatile", "LIMIT without ORDER BY"]
    assert identity.refusals(spark, "SELECT block_number FROM usdc__transfer ORDER BY 1 LIMIT 3") == []
    assert identity.is_deterministic(lambda: surface.frame("SELECT block_number FROM usdc__transfer ORDER BY 1"))
    graph = {"a": {"t"}, "b": {"a"}, "c": {"b", "a"}}
    assert identity.build_order(graph) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="a -> b -> a"):
        identity.build_order({"a": {"b"}, "b": {"a"}})
    k1, k2 = identity.merkle_keys(graph, dict.fromkeys("abc", "x"), {"t": "1"}), identity.merkle_keys(graph, {"a": "y", "b": "x", "c": "x"}, {"t": "1"})
    assert all(k1[v] != k2[v] for v in "abc")
    assert identity.dataset_identity({"a": "1", "_title": "x"}) == identity.dataset_identity({"a": "1", "_title": "y"})
    old = {"t": {"a": "u64", "b": "bool"}}
    assert identity.classify_schema_change(old, {"t": {"a": "u64", "b": "bool", "c": "bool"}, "u": {}}) == ("compatible", ["table u added", "column t.c added"])
    assert identity.classify_schema_change(old, {"t": {"a": "word32"}})[0] == "breaking"
    with pytest.raises(ValueError):
        identity.policy_guard({"registry": "1"}, {"registry": "2"})


def test_semantic_and_checks(spark, surface):
    described, warnings = semantic.describe({"t": {"from": "address", "value": "word32", "ok": "bool"}}, {"t": {"description": "moves", "columns": {"gone": "x", "value": "amount"}}, "u": {}})
    assert len(described["t"]["footguns"]) == 3 and warnings == ["t.gone is described but isn't there", "u is described but isn't there"]
    assert semantic.merge({"t": {"description": "a", "columns": {"x": "1"}}}, {"t": {"description": "", "columns": {"x": "2"}}}) == {"t": {"description": "a", "columns": {"x": "2"}}}
    sql = "SELECT block_number FROM usdc__transfer WHERE block_number < 3 ORDER BY 1"
    then = checks.record(surface.frame(sql))
    assert checks.run_checks(surface, {"c": sql, "d": sql}, {"c": then}) == {"c": "same", "d": "new"}
    assert checks.run_checks(surface, {"c": sql.replace("ORDER BY 1", "ORDER BY 1 DESC")}, {"c": then}) == {"c": "row 0 differs"}


def test_labels_and_children(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"address": "0xAB", "label": "x"}]')
    (tmp_path / "b.json").write_text('[{"address": "0xab", "label": "x"}, {"address": "0xcd", "label": "y"}]')
    assert sorted(map(tuple, catalog.labels_view(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).collect())) == [("0xab", "x"), ("0xcd", "y")]
    df = spark.createDataFrame([(2, 0, "0xAA", "0xF"), (1, 5, "0xaa", "0xG")], "block_number long, log_index long, made string, address string")
    got = catalog.children_view({"m": (df, "made")}, timestamps=False).collect()
    assert [tuple(r) for r in got] == [("0xaa", 1, 5, "0xg")]
