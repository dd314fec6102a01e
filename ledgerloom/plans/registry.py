"""Registered queries of the ledger operators over the test tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as K
from ledgerloom.operators import decode, folds, joins, reads, screening
from ledgerloom.sources import facts, replay, store
from ledgerloom.sources.abi import Registry
from ledgerloom.sources.facts import EVENTS, LABELS, TRANSFERS
from ledgerloom.streaming import deltas, ingest

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(sql: str | None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _text(df: DataFrame, *names: str) -> DataFrame:
    """Exact numbers as text, so that both engines show them alike."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


_MOVES = 'm AS (SELECT "to" AS address, value::HUGEINT AS d FROM t UNION ALL SELECT "from", -value::HUGEINT FROM t)'
_ZERO = f"'{K.ZERO_ADDRESS}'"
_OUT_IN = """p AS (SELECT "from" AS address, lower("to") AS c, 'out' AS direction, value::HUGEINT AS v FROM t UNION ALL SELECT "to", lower("from"), 'in', value::HUGEINT FROM t)"""


# -- folds


@register(f"WITH {TRANSFERS}, {_MOVES} SELECT address, sum(d)::VARCHAR AS balance FROM m GROUP BY address HAVING sum(d) <> 0")
def net_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(folds.net_balances(facts.transfers(spark, sf_dir)), "balance")


@register(f"WITH {TRANSFERS}, {_MOVES} SELECT lower(address) AS addr, sum(d)::VARCHAR AS balance FROM m WHERE lower(address) <> {_ZERO} GROUP BY 1 HAVING sum(d) <> 0")
def balances(spark, sf_dir):
    return _text(folds.balances(facts.transfers(spark, sf_dir)), "balance")


@register(f"WITH {TRANSFERS}, {_MOVES} SELECT count(*) AS holders FROM (SELECT lower(address) AS a FROM m WHERE lower(address) <> {_ZERO} GROUP BY 1 HAVING sum(d) <> 0)")
def holder_count(spark, sf_dir):
    return folds.holder_count(facts.transfers(spark, sf_dir))


@register(f'WITH {TRANSFERS} SELECT (coalesce(sum(CASE WHEN "from" = {_ZERO} THEN value::HUGEINT END), 0) - coalesce(sum(CASE WHEN "to" = {_ZERO} THEN value::HUGEINT END), 0))::VARCHAR AS total_supply FROM t')
def total_supply(spark, sf_dir):
    return _text(folds.total_supply(facts.transfers(spark, sf_dir)), "total_supply")


@register(f"WITH {TRANSFERS}, {_MOVES} SELECT address, sum(d)::VARCHAR AS balance FROM m GROUP BY address HAVING sum(d) <> 0 ORDER BY sum(d) DESC, address LIMIT 20")
def top_balances(spark, sf_dir):
    return _text(folds.top_balances(folds.net_balances(facts.transfers(spark, sf_dir)), 20), "balance")


@register(f"WITH {TRANSFERS}, {_MOVES} SELECT address, sum(d)::VARCHAR AS balance FROM m WHERE lower(address) = printf('0x%040x', 7) GROUP BY address HAVING sum(d) <> 0")
def balance_of(spark, sf_dir):
    return folds.balance_of(folds.net_balances(facts.transfers(spark, sf_dir)), "0x" + f"{7:040X}")


@register(f"WITH {TRANSFERS}, {LABELS}, {_OUT_IN} SELECT p.address, label, direction, sum(v)::VARCHAR AS amount, count(*) AS n FROM p JOIN l ON p.c = l.address GROUP BY ALL")
def exposure(spark, sf_dir):
    return _text(folds.exposure(facts.transfers(spark, sf_dir), facts.supplier_labels(spark, sf_dir)), "amount")


@register(f"WITH {TRANSFERS}, {LABELS}, {_OUT_IN} SELECT p.address, label, direction, sum(v)::VARCHAR AS amount, count(*) AS n FROM p JOIN l ON p.c = l.address WHERE p.address = printf('0x%040x', 3) GROUP BY ALL")
def exposure_of(spark, sf_dir):
    return _text(folds.exposure_of(folds.exposure(facts.transfers(spark, sf_dir), facts.supplier_labels(spark, sf_dir)), f"0x{3:040x}"), "amount")


_VELOCITY = f'WITH {EVENTS}, v AS (SELECT "from" AS address, block_number // 7200 * 7200 AS window_start, sum(value::HUGEINT) AS volume, count(*) AS n FROM e GROUP BY ALL) '


@register(_VELOCITY + "SELECT address, window_start, volume::VARCHAR AS volume, n FROM v")
def velocity(spark, sf_dir):
    return _text(folds.velocity(facts.event_transfers(spark, sf_dir)), "volume")


@register(_VELOCITY + "SELECT address, window_start, volume::VARCHAR AS volume, n FROM v WHERE volume >= 50000")
def velocity_flags(spark, sf_dir):
    return _text(folds.velocity_flags(folds.velocity(facts.event_transfers(spark, sf_dir)), 50_000), "volume")


@register(f"""WITH {TRANSFERS} SELECT 'threshold' AS kind, 'large' AS rule, "from", "to", value, '9000000' AS threshold, block_number, log_index FROM t WHERE value::HUGEINT >= 9000000""")
def threshold_flags(spark, sf_dir):
    return folds.threshold_flags(facts.transfers(spark, sf_dir), 9_000_000, "large")


@register(f"WITH {TRANSFERS} SELECT value::HUGEINT >= 5000000 AS large, count(*) AS n FROM t GROUP BY 1")
def large_transfers(spark, sf_dir):
    return facts.transfers(spark, sf_dir).groupBy(folds.is_large(F.col("value"), 5_000_000).alias("large")).agg(F.count("*").alias("n"))


@register("""WITH s AS (SELECT printf('0x%040x', o_custkey) AS address, o_orderkey AS b, length(o_orderpriority) AS i, round(o_totalprice * 100)::BIGINT AS r0 FROM orders)
SELECT address, r0::VARCHAR AS reserve0, b::VARCHAR AS reserve1 FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY b DESC, i DESC) AS rn FROM s) WHERE rn = 1""")
def reserves_latest(spark, sf_dir):
    return _text(folds.latest_reserves(facts.syncs(spark, sf_dir)), "reserve0", "reserve1")


@register(f"""WITH {EVENTS} SELECT "from" AS address, block_number AS discovered_block, log_index AS discovered_log_index, "to" AS parent_address
FROM e QUALIFY row_number() OVER (PARTITION BY "from" ORDER BY block_number, log_index) = 1""")
def children_earliest(spark, sf_dir):
    e = facts.event_transfers(spark, sf_dir).select(F.col("from").alias("child"), "block_number", "log_index", F.col("to").alias("address"))
    return folds.earliest_children(e, timestamps=False)


@register("SELECT count(*) AS hits, count(DISTINCT event_type) AS lists, min(event_id) AS first_block, max(event_id) AS last_block FROM events")
def range_audit(spark, sf_dir):
    return folds.range_audit(facts.table(spark, sf_dir, "events").select(F.col("event_type").alias("list_snapshot"), F.col("event_id").alias("block_number")))


@register("SELECT quantile_cont(l_quantity, 0.5) AS median, quantile_disc(l_quantity, 0.99) AS p99 FROM lineitem")
def bench_stats(spark, sf_dir):
    return folds.bench_stats(facts.table(spark, sf_dir, "lineitem"), "l_quantity")


# -- screening

_LIST = "b AS (SELECT printf('0x%040x', s_suppkey) AS address FROM supplier WHERE s_suppkey % 17 = 3)"
_HITS = """h AS (SELECT block_number, log_index, lower("from") AS address, 'from' AS side, lower("to") AS counterparty, value FROM t WHERE lower("from") IN (FROM b)
  UNION ALL SELECT block_number, log_index, lower("to"), 'to', lower("from"), value FROM t WHERE lower("to") IN (FROM b))"""


def _listed(spark, sf_dir):
    return facts.table(spark, sf_dir, "supplier").where("s_suppkey % 17 = 3").select(facts.address(F.col("s_suppkey")).alias("address"))


@register(f"WITH {TRANSFERS}, {_LIST}, {_HITS} SELECT * FROM h")
def sanction_hits(spark, sf_dir):
    return screening.screen(facts.transfers(spark, sf_dir), _listed(spark, sf_dir))


@register(f"""WITH {TRANSFERS}, {_LIST}, {_HITS}, stored AS (SELECT * FROM h WHERE block_number % 11 <> 0 UNION ALL SELECT block_number, log_index, address, 'both', counterparty, value FROM h WHERE block_number % 13 = 0)
SELECT *, 'missing' AS fault FROM (FROM h EXCEPT ALL FROM stored) UNION ALL SELECT *, 'extra' FROM (FROM stored EXCEPT ALL FROM h)""")
def audit_diff(spark, sf_dir):
    hits = screening.screen(facts.transfers(spark, sf_dir), _listed(spark, sf_dir))
    stored = hits.where("block_number % 11 <> 0").unionByName(hits.where("block_number % 13 = 0").withColumn("side", F.lit("both")))
    return screening.audit_diff(stored, hits)


@register(f"""WITH {TRANSFERS}, x AS (SELECT 'seen ' || upper("from") || ', then ' || "to" || 'ff and 0x12' AS text FROM t)
SELECT DISTINCT lower(a) AS address FROM (SELECT unnest(regexp_extract_all(text, '0[xX][0-9a-fA-F]*')) AS a FROM x) WHERE length(a) = 42""")
def address_scrape(spark, sf_dir):
    t = facts.transfers(spark, sf_dir).select(F.concat(F.lit("seen "), F.upper("from"), F.lit(", then "), F.col("to"), F.lit("ff and 0x12")).alias("text"))
    return screening.scrape_addresses(t)


# -- hot and sealed

_PARTS = "SELECT event_id AS block_number, user_id AS log_index, event_type FROM events"


def _events(spark, sf_dir):
    return facts.table(spark, sf_dir, "events").select(F.col("event_id").alias("block_number"), F.col("user_id").alias("log_index"), "event_type")


@register(f"SELECT * FROM ({_PARTS}) WHERE block_number <= 500 UNION ALL SELECT * FROM ({_PARTS}) WHERE block_number > 500")
def hot_cold_union(spark, sf_dir):
    e = _events(spark, sf_dir)
    # Some hot rows were sealed already: they count once.
    return store.union_view(e.where("block_number <= 500"), e.where("block_number > 400"), 500)


@register(_PARTS)
def genesis_union(spark, sf_dir):
    return store.union_view(None, _events(spark, sf_dir), None)


@register(f"""WITH {EVENTS}, h AS (SELECT block_number, log_index, event_type, 0 AS s FROM e WHERE log_index > 600 UNION ALL SELECT block_number, log_index, lower(event_type) || '!', 1 FROM e WHERE log_index < 900)
SELECT block_number, log_index, event_type FROM (SELECT *, row_number() OVER (PARTITION BY block_number, log_index ORDER BY s) AS r FROM h) WHERE r = 1 ORDER BY block_number DESC, log_index DESC LIMIT 100""")
def recent_rows(spark, sf_dir):
    e = facts.event_transfers(spark, sf_dir).select("block_number", "log_index", "event_type")
    return reads.recent_rows(e.where("log_index < 900").withColumn("event_type", F.concat(F.lower("event_type"), F.lit("!"))), e.where("log_index > 600"), 100)


@register(f"""WITH {EVENTS} SELECT 'event' AS "table", printf('%012d-%06d', block_number, log_index) AS id FROM e ORDER BY id DESC LIMIT 25""")
def recent_entities(spark, sf_dir):
    return reads.recent_entities({"event": facts.event_transfers(spark, sf_dir)}, 25).select("table", "id")


@register(f"""WITH {EVENTS} SELECT 'event' AS "table", count(*) AS n FROM e WHERE (block_number, log_index) = (SELECT (block_number, log_index) FROM e WHERE log_index = 17)""")
def entity_point_read(spark, sf_dir):
    e = facts.event_transfers(spark, sf_dir)
    at = e.where("log_index = 17").select(K.entity_id(F.col("block_number"), F.col("log_index")).alias("id")).first()["id"]
    return reads.entity({"event": e}, at).groupBy("table").agg(F.count("*").alias("n"))


@register(f"""WITH {TRANSFERS} SELECT block_number, log_index, lower("from") AS "from", lower("to") AS "to", value FROM t WHERE block_number BETWEEN 100 AND 200""")
def sealed_range_read(spark, sf_dir):
    return reads.block_range(facts.transfers(spark, sf_dir), 100, 200)


@register(f"WITH {EVENTS} SELECT (block_number << 20) | (log_index & 1048575) AS _seq, printf('%012d-%06d', block_number, log_index) AS id FROM e")
def order_keys(spark, sf_dir):
    b, i = F.col("block_number"), F.col("log_index")
    return facts.event_transfers(spark, sf_dir).select(K.sequence_key(b, i).alias("_seq"), K.entity_id(b, i).alias("id"))


_BIG = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN repeat('9', 38) WHEN p_partkey % 3 = 1 THEN '1' || repeat('0', 38) WHEN p_partkey % 7 = 2 THEN NULL ELSE p_partkey::VARCHAR END AS v FROM part"


@register(f"SELECT p_partkey, v, (CASE WHEN length(v) <= 38 THEN v END) AS v_dec, coalesce(length(v) > 38, false) AS v_overflow FROM ({_BIG})")
def bigint_dec_overflow(spark, sf_dir):
    k = F.col("p_partkey")
    v = F.when(k % 3 == 0, F.lit("9" * 38)).when(k % 3 == 1, F.lit("1" + "0" * 38)).when(k % 7 == 2, F.lit(None)).otherwise(k.cast("string"))
    return _text(K.with_big_columns(facts.table(spark, sf_dir, "part").select("p_partkey", v.alias("v")), ["v"]), "v_dec")


@register("SELECT c_custkey::VARCHAR AS c_custkey, c_name, NULL::VARCHAR AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey::VARCHAR, NULL, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def schema_drift_union(spark, sf_dir):
    c = facts.table(spark, sf_dir, "customer")
    names = ["c_custkey", "c_mktsegment", "c_name"]
    old, new = c.where("c_custkey % 2 = 0").select("c_custkey", "c_name"), c.where("c_custkey % 2 = 1").select("c_custkey", "c_mktsegment")
    return store.union_view(K.conform(old, names), K.conform(new, names), None)


@register(f"""WITH {TRANSFERS}, c AS (SELECT block_number, count(*) AS n FROM t GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY block_number) - n AS before FROM c)
SELECT min(block_number) AS first_block, max(block_number) AS last_block, sum(n)::BIGINT AS rows FROM r GROUP BY before // 5000""")
def seal_cuts(spark, sf_dir):
    return store.seal_cuts(facts.transfers(spark, sf_dir), 5000)


# -- joins


@register(f"""WITH {TRANSFERS}, w AS (SELECT DISTINCT "to" AS account FROM t WHERE block_number BETWEEN 10 AND 60 UNION SELECT "from" FROM t WHERE block_number BETWEEN 10 AND 60),
led AS (SELECT "to" AS account, value::HUGEINT AS d FROM t UNION ALL SELECT "from", -value::HUGEINT FROM t)
SELECT account, sum(d)::VARCHAR AS balance FROM led JOIN w USING (account) GROUP BY account""")
def case2_accounts(spark, sf_dir):
    t = facts.transfers(spark, sf_dir)
    window = t.where("block_number BETWEEN 10 AND 60")
    accounts = window.select(F.col("to").alias("account")).union(window.select("from"))
    moves = folds.signed_moves(t).withColumnRenamed("address", "account")
    return joins.within(moves, accounts, "account").groupBy("account").agg(F.sum("delta").cast(K.BIG).cast("string").alias("balance"))


@register("SELECT l_orderkey AS block_number, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def join_using(spark, sf_dir):
    line = facts.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_number"), F.lit("l").alias("table"))
    order = facts.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("block_number"), F.lit("o").alias("table"))
    return joins.using(line, order, "block_number").groupBy("block_number").agg(F.count("*").alias("n"))


@register("SELECT c_custkey, o.n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON c_custkey = o_custkey")
def pending_left_join(spark, sf_dir):
    done = facts.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return joins.pending(facts.table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@register("SELECT r_name, n FROM region LEFT JOIN (SELECT count(*) AS n FROM nation HAVING count(*) < 0) ON true")
def left_join_on_true(spark, sf_dir):
    one = facts.table(spark, sf_dir, "nation").agg(F.count("*").alias("n")).where("n < 0")
    return joins.beside(facts.table(spark, sf_dir, "region").select("r_name"), one)


@register(f"""WITH {EVENTS}, c AS (SELECT "from" AS child, min((block_number, log_index)) AS at FROM e GROUP BY 1)
SELECT e.block_number, e.log_index, e."from" AS address FROM e JOIN c ON e."from" = c.child AND (e.block_number, e.log_index) > c.at""")
def after_discovery(spark, sf_dir):
    e = facts.event_transfers(spark, sf_dir).select("block_number", "log_index", F.col("from").alias("address"))
    kids = e.groupBy("address").agg(F.min(F.struct("block_number", "log_index")).alias("f")).select("address", F.col("f.block_number").alias("discovered_block"), F.col("f.log_index").alias("discovered_log_index"), F.lit("t").alias("template"))
    return joins.after_discovery(e, kids).drop("template")


_PRICES = "SELECT user_id, ts, max(value) AS price FROM events WHERE event_type = 'purchase' GROUP BY ALL"


@register(f"SELECT e.event_id, e.user_id, p.price FROM events e ASOF LEFT JOIN ({_PRICES}) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'view'")
def as_of_join(spark, sf_dir):
    e = facts.table(spark, sf_dir, "events")
    prices = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("price"))
    return joins.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), prices, ["user_id"], "ts", ["price"]).drop("ts")


@register("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size BETWEEN s_nationkey AND s_nationkey + 2")
def interval_join(spark, sf_dir):
    p = facts.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    s = facts.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("low"), (F.col("s_nationkey") + 2).alias("high"))
    return joins.interval(p, s, "p_size", "low", "high", 5).select("p_partkey", "s_suppkey")


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, sf_dir):
    return facts.table(spark, sf_dir, "customer").select("c_custkey").join(facts.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


# -- decoding and reads


@register(f"""WITH {TRANSFERS} SELECT block_number, log_index, (block_number << 20) | log_index AS _seq, '{facts.TOKEN}' AS address, "from", "to", value FROM t""")
def decode_transfers(spark, sf_dir):
    registry = Registry()
    registry.add("token", facts.TRANSFER_ABI, facts.TOKEN)
    rows = decode.decode_events(registry, facts.transfer_logs(spark, sf_dir))["token__transfer"]
    return rows.select("block_number", "log_index", "_seq", "address", "from", "to", "value")


@register(f"WITH {TRANSFERS} SELECT block_number, log_index FROM t WHERE block_number % 3 = 1 AND log_index % 2 = 0")
def log_filter(spark, sf_dir):
    """Logs of one contract and one event among three contracts and two events."""
    logs = facts.transfer_logs(spark, sf_dir)
    emitter = F.concat(F.lit("0x"), F.lpad((F.col("block_number") % 3).cast("string"), 40, "c"))
    topic = F.when(F.col("log_index") % 2 == 0, F.get("topics", F.lit(0))).otherwise("0x" + "1" * 64)
    logs = logs.withColumns({"address": emitter, "topics": F.concat(F.array(topic), F.slice("topics", 2, 2))})
    return decode.log_filter(logs, ["0x" + "C" * 39 + "1"], [facts.transfer_topic().upper().replace("0X", "0x")]).select("block_number", "log_index")


@register("SELECT o_orderkey AS block_number, 999999::BIGINT AS log_index, (o_orderkey << 20) | 999999 AS _seq, 'blocks' AS \"table\", o_custkey::VARCHAR AS gas_used FROM orders")
def block_rows(spark, sf_dir):
    own = {c: F.lit(None).cast("string") for c in ("parent_hash", "miner", "gas_limit", "base_fee_per_gas", "size", "transaction_count", "block_hash")}
    headers = facts.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_number"), F.col("o_orderkey").alias("block_timestamp"), F.col("o_custkey").alias("gas_used")).withColumns(own)
    return decode.block_rows(headers).select("block_number", "log_index", "_seq", "table", "gas_used")


@register("WITH b AS (SELECT min(o_orderkey) AS f, max(o_orderkey) AS l FROM orders) SELECT 100 * unnest(range((f + 99) // 100, l // 100 + 1)) AS block_number FROM b")
def sampled_blocks(spark, sf_dir):
    first, last = facts.table(spark, sf_dir, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return replay.sampled_blocks(spark, first, last, 100)


@register("""SELECT DISTINCT o_orderkey AS block_number, printf('0x%040x', o_custkey) AS contract, ['get', o_orderstatus] AS args FROM orders""")
def row_driven_reads(spark, sf_dir):
    o = facts.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_number"), facts.address(F.col("o_custkey")).alias("pair"), "o_orderstatus")
    return replay.row_driven_reads(o.union(o), "{pair}", ["get", "{o_orderstatus}"])


@register("SELECT n_nationkey, sha256(unhex('0000000000000001') || unhex('1F') || unhex(printf('%016x', n_nationkey)) || unhex('1F') || encode(n_name) || unhex('1F') || encode('0xab')) AS address FROM nation")
def call_content_address(spark, sf_dir):
    return facts.table(spark, sf_dir, "nation").select("n_nationkey", replay.call_address(1, F.col("n_nationkey"), F.col("n_name"), F.lit("0xab")).alias("address"))


@register("SELECT DISTINCT name, lower(name[1:1]) || lower(regexp_replace(name[2:], '([A-Z])', '_\\1', 'g')) AS snake FROM (SELECT upper(event_type[1:1]) || event_type[2:] || c_mktsegment[1:2] || 'Batch' AS name FROM events, (SELECT DISTINCT c_mktsegment FROM customer))")
def snake_case(spark, sf_dir):
    """Names of capitals in rows and at the front."""
    kinds = facts.table(spark, sf_dir, "events").select("event_type").distinct()
    segments = facts.table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    name = F.concat(F.upper(F.substring("event_type", 1, 1)), F.expr("substring(event_type, 2)"), F.substring("c_mktsegment", 1, 2), F.lit("Batch"))
    return kinds.join(segments).select(name.alias("name"), K.snake_case_column(name).alias("snake")).distinct()


# -- streams as batches


@register(f"WITH {EVENTS}, t AS (FROM e), {_MOVES} SELECT address, sum(d)::VARCHAR AS balance FROM m GROUP BY address HAVING sum(d) <> 0")
def reorg_converged(spark, sf_dir):
    """Apply, take back above a block, apply again: as if there had been no reorganisation."""
    e = facts.event_transfers(spark, sf_dir)
    top = e.where("log_index % 3 = 0")
    log = deltas.with_weight(e, 1).unionByName(deltas.with_weight(top, -1)).unionByName(deltas.with_weight(top, 1))
    return _text(folds.net_balances(log), "balance")


@register(f"WITH {EVENTS}, t AS (FROM e WHERE log_index < 700), {_MOVES} SELECT address, sum(d)::VARCHAR AS balance FROM m GROUP BY address HAVING sum(d) <> 0")
def retracted_balances(spark, sf_dir):
    e = facts.event_transfers(spark, sf_dir)
    state = deltas.merge(deltas.BALANCE, folds.net_balances(e), deltas.balance_delta(deltas.with_weight(e.where("log_index >= 700"), -1)))
    return _text(state, "balance")


@register(f"""WITH {EVENTS} SELECT "from" AS address, block_number // 7200 * 7200 AS window_start, sum(value::HUGEINT)::VARCHAR AS volume, count(*) AS n FROM e WHERE log_index < 700 GROUP BY 1, 2""")
def retracted_velocity(spark, sf_dir):
    e = facts.event_transfers(spark, sf_dir)
    state = deltas.merge(deltas.VELOCITY, folds.velocity(e), deltas.velocity_delta(deltas.with_weight(e.where("log_index >= 700"), -1), folds.BUCKET_BLOCKS))
    return _text(state, "volume")


@register(f"""WITH {EVENTS}, t AS (SELECT * FROM e), {LABELS}, {_OUT_IN} SELECT p.address, label, direction, sum(v)::VARCHAR AS amount, count(*) AS n FROM p JOIN l ON p.c = l.address GROUP BY ALL""")
def retracted_exposure(spark, sf_dir):
    e, labels = facts.event_transfers(spark, sf_dir), facts.supplier_labels(spark, sf_dir)
    twice = folds.exposure(e.unionByName(e.where("log_index % 2 = 0")), labels)
    state = deltas.merge(deltas.EXPOSURE, twice, deltas.exposure_delta(deltas.with_weight(e.where("log_index % 2 = 0"), -1), labels))
    return _text(state, "amount")


@register(f"WITH {TRANSFERS}, {_MOVES} SELECT address, sum(d)::VARCHAR AS balance FROM m GROUP BY address HAVING sum(d) <> 0")
def warm_restart(spark, sf_dir):
    """Sealed rows that are still hot count once."""
    t = facts.transfers(spark, sf_dir)
    return _text(deltas.warm_balances(t.where("block_number <= 900"), t.where("block_number > 500"), 900), "balance")


@register("WITH m AS (SELECT max(o_orderkey) * 3 // 4 AS m FROM orders) SELECT max(o_orderkey) AS point FROM orders, m WHERE o_orderkey <= m")
def reorg_point(spark, sf_dir):
    """Orders as checkpoints whose last quarter the chain replaced."""
    seen = facts.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_number"), F.concat_ws("-", "o_custkey", "o_orderstatus").alias("block_hash"))
    fork = seen.agg(F.max("block_number").alias("m")).first()["m"] * 3 // 4
    now = seen.withColumn("block_hash", F.when(F.col("block_number") > fork, F.concat("block_hash", F.lit("'"))).otherwise(F.col("block_hash")))
    return spark.createDataFrame([(ingest.reorg_point(seen, now),)], "point long")


@register(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (ORDER BY block_number, log_index) - 1 AS seq FROM e WHERE block_number > 142000000 AND block_number <= 142100000 AND event_type = 'purchase')
SELECT seq // 50 AS chunk, seq, log_index FROM r""")
def webhook_chunks(spark, sf_dir):
    e = facts.event_transfers(spark, sf_dir)
    out = ingest.sealed_chunks(e, 142_000_000, 142_100_000, "event_type = 'purchase'")
    return out.select("chunk", "seq", F.get_json_object("row", "$.log_index").cast("long").alias("log_index"))


@register(f'WITH {EVENTS} SELECT log_index, "from" AS address, row_number() OVER (PARTITION BY "from" ORDER BY block_number, log_index) AS occurrence FROM e')
def recurrence(spark, sf_dir):
    e = facts.event_transfers(spark, sf_dir).withColumnRenamed("from", "address")
    return ingest.recurrence(e).select("log_index", "address", F.col("occurrence").cast("long").alias("occurrence"))


# -- free SQL, as users write it


@register(f"""WITH {TRANSFERS}, v AS (SELECT *, value::HUGEINT AS x FROM t), top AS (SELECT "to", sum(x) AS s FROM v GROUP BY 1)
SELECT count(*) AS n, sum(x)::VARCHAR AS total, max(x)::VARCHAR AS largest, min(x)::VARCHAR AS least, count(DISTINCT "from") AS senders, count(DISTINCT "to") AS receivers,
  (SELECT max(s)::VARCHAR FROM top) AS most_received FROM v""")
def golden_questions(spark, sf_dir):
    """The questions that users ask of a transfer table, over a view half sealed and half hot that overlap."""
    t = facts.transfers(spark, sf_dir)
    first, last = t.agg(F.min("block_number"), F.max("block_number")).first()
    sealed, hot = (first + last) // 2, (2 * first + last) // 3
    view = K.with_big_columns(store.union_view(t.where(F.col("block_number") <= sealed), t.where(F.col("block_number") > hot), sealed), ["value"])
    v = F.col("value_dec")
    top = view.groupBy("to").agg(F.sum(v).alias("s")).agg(F.max("s").cast("string").alias("most_received"))
    return view.agg(F.count("*").alias("n"), F.sum(v).cast("string").alias("total"), F.max(v).cast("string").alias("largest"), F.min(v).cast("string").alias("least"), F.countDistinct("from").alias("senders"), F.countDistinct("to").alias("receivers")).join(top)


@register("SELECT user_id, count(*) AS n FROM events WHERE user_id >= 3 GROUP BY user_id HAVING count(*) > 1")
def named_query(spark, sf_dir):
    from ledgerloom.plans.guard import Surface
    from ledgerloom.plans.named import NamedQuery, Queries

    surface = Surface(spark, {"events_view": facts.table(spark, sf_dir, "events")})
    q = NamedQuery("by_user", "SELECT user_id, count(*) AS n FROM events_view WHERE user_id >= :least GROUP BY user_id HAVING count(*) > 1", {"least": "int"})
    return Queries(surface, "allowlist", [q]).named("by_user", {"least": "3"})


@register("""WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT n, count(*) AS customers FROM a GROUP BY 1) SELECT n, customers FROM b""")
def guarded_cte(spark, sf_dir):
    from ledgerloom.plans.guard import Surface

    surface = Surface(spark, {"orders_view": facts.table(spark, sf_dir, "orders")})
    return surface.frame("WITH a AS (SELECT o_custkey, count(*) AS n FROM orders_view GROUP BY 1), b AS (SELECT n, count(*) AS customers FROM a GROUP BY 1) SELECT n, customers FROM b;")


@register("""WITH a AS (SELECT user_id, event_type, round(value * 100)::BIGINT AS c FROM events) SELECT user_id, event_type, count(*) AS n, sum(c)::BIGINT AS cents FROM a GROUP BY ROLLUP (user_id, event_type)""")
def authored_view_chain(spark, sf_dir):
    from ledgerloom.plans.catalog import authored_views

    files = {"01_a.sql": "CREATE VIEW v_cents AS SELECT user_id, event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events_view;", "02_b.sql": "-- sums\nCREATE VIEW v_sums AS SELECT user_id, event_type, count(*) AS n, sum(c) AS cents FROM v_cents GROUP BY ROLLUP (user_id, event_type);"}
    views, report = authored_views(spark, {"events_view": facts.table(spark, sf_dir, "events")}, files)
    if report.failed:
        raise ValueError(str(report.failed))
    return views["v_sums"]


@register("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return facts.table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@register("SELECT event_id, rank() OVER w AS place, lag(event_id) OVER w AS before, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_functions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return facts.table(spark, sf_dir, "events").select("event_id", F.rank().over(w).cast("long").alias("place"), F.lag("event_id").over(w).alias("before"), F.ntile(4).over(w).cast("long").alias("quarter"))


@register("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10 EXCEPT SELECT s_suppkey FROM supplier")
def set_operations(spark, sf_dir):
    o = facts.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    c = facts.table(spark, sf_dir, "customer").where("c_nationkey < 10").select("c_custkey")
    return o.intersect(c).subtract(facts.table(spark, sf_dir, "supplier").select("s_suppkey"))


@register("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def hourly_counts(spark, sf_dir):
    return facts.table(spark, sf_dir, "events").groupBy(F.expr("CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ)").alias("hour")).agg(F.count("*").alias("n"), F.expr("count(*) FILTER (WHERE event_type = 'error')").alias("errors"))


@register("""WITH t AS (SELECT n_name, n_name[1:1] || n_name[3:] || 'x' AS typo FROM nation),
d AS (SELECT typo, o.n_name AS near, levenshtein(lower(typo), lower(o.n_name)) AS edits FROM t, nation o)
SELECT typo, CASE WHEN min(edits) <= greatest(2, length(typo) // 3) THEN arg_min(near, (edits, near)) END AS near FROM d GROUP BY typo""")
def nearest_name(spark, sf_dir):
    """What a hint proposes for each misspelt name."""
    from ledgerloom.plans.errors import closest

    names = [r["n_name"] for r in facts.table(spark, sf_dir, "nation").select("n_name").collect()]  # as few as a catalog's tables
    typos = [n[:1] + n[2:] + "x" for n in names]
    return spark.createDataFrame(sorted({(t, closest(t, names)) for t in typos}), "typo string, near string")


@register("SELECT n_regionkey, range AS k FROM nation, range(3) WHERE n_nationkey < 4")
def series_and_explode(spark, sf_dir):
    return facts.table(spark, sf_dir, "nation").where("n_nationkey < 4").select("n_regionkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("k"))


@register("SELECT NULL::VARCHAR AS a, NULL::VARCHAR AS b FROM region WHERE false")
def empty_view(spark, sf_dir):
    return K.empty_table(spark, ["a", "b"])


@register(f"""WITH {TRANSFERS}, c AS (SELECT printf('0x%040x', s_suppkey) AS child, min((block_number, log_index)) AS at FROM supplier JOIN t ON "from" = printf('0x%040x', s_suppkey) WHERE s_suppkey % 2 = 0 GROUP BY 1)
SELECT block_number, log_index, child AS address, "to", value FROM t JOIN c ON "from" = child AND (block_number, log_index) > c.at""")
def decode_children(spark, sf_dir):
    """Logs of contracts that a factory made, from each one's discovery on: suppliers of even number, found with their first shipment."""
    t = facts.transfers(spark, sf_dir)
    even = facts.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(facts.address(F.col("s_suppkey")).alias("from"))
    kids = t.join(even, "from").groupBy(F.col("from").alias("address")).agg(F.min(F.struct("block_number", "log_index")).alias("f")).select("address", F.lit("pool").alias("template"), F.col("f.block_number").alias("discovered_block"), F.col("f.log_index").alias("discovered_log_index"))
    registry = Registry()
    registry.add("pool", facts.TRANSFER_ABI, None)
    logs = facts.transfer_logs(spark, sf_dir).withColumn("address", F.concat(F.lit("0x"), F.substring(F.get("topics", F.lit(1)), 27, 40)))
    return decode.decode_children(registry, logs, kids, "pool")["pool__transfer"].select("block_number", "log_index", "address", "to", "value")


@register(f"""WITH {TRANSFERS} SELECT block_number, log_index, CASE WHEN block_number % 5 = 0 THEN 'calls_raw' ELSE 'token__call_transfer' END AS "table", CASE WHEN block_number % 5 <> 0 THEN "to" END AS "to", CASE WHEN block_number % 5 <> 0 THEN value END AS value FROM t""")
def decode_calls(spark, sf_dir):
    """Calls to a contract; those whose arguments are cut short keep their raw input."""
    call = [{"type": "function", "name": "transfer", "inputs": [{"name": "to", "type": "address"}, {"name": "value", "type": "uint256"}]}]
    registry = Registry()
    registry.add("token", facts.TRANSFER_ABI + call, facts.TOKEN, functions=["transfer"])
    logs = facts.transfer_logs(spark, sf_dir)
    whole = F.concat(F.lit("0xa9059cbb"), F.substring(F.get("topics", F.lit(2)), 3, 64), F.substring("data", 3, 64))
    calls = logs.withColumn("input", F.when(F.col("block_number") % 5 == 0, F.substring(whole, 1, 40)).otherwise(whole)).drop("topics", "data")
    tables = decode.decode_calls(registry, calls)
    names = ["block_number", "log_index", "table", "to", "value"]
    raw = tables["calls_raw"].withColumns({"to": F.lit(None).cast("string"), "value": F.lit(None).cast("string")})
    return tables["token__call_transfer"].select(*names).unionByName(raw.select(*names))


# -- runs of the store and the stream


@register(f"WITH {TRANSFERS} SELECT block_number, count(*) AS n, sum(value::HUGEINT)::VARCHAR AS total FROM t GROUP BY 1")
def store_lifecycle(spark, sf_dir):
    """Commit two windows, take one back, commit again, seal, and read the view: every row once. Windows, rollback and seal are at shares of the table's block range."""
    s = _store(spark)
    rows = facts.transfers(spark, sf_dir).withColumns({"address": F.lit(facts.TOKEN), "block_hash": F.lit("0xb"), "tx_hash": F.lit("0xt"), "block_timestamp": F.col("block_number"), "_seq": K.sequence_key(F.col("block_number"), F.col("log_index"))})
    names = {"token__transfer": sorted(rows.columns)}
    first, last = rows.agg(F.min("block_number"), F.max("block_number")).first()
    middle, seal, back = (first + (last - first) * k // 8 for k in (4, 5, 6))
    low, high = rows.where(F.col("block_number") <= middle), rows.where(F.col("block_number") > middle)
    s.commit_window({"token__transfer": low}, {middle: "a"}, middle, 0)
    s.commit_window({"token__transfer": high}, {last: "b"}, last, 1)
    s.rollback(back, names)
    s.commit_window({"token__transfer": high.where(F.col("block_number") > back)}, {last: "c"}, last, 2)
    s.seal_and_prune(seal, names)
    view = s.view("token__transfer", names["token__transfer"], ["value"])
    return view.groupBy("block_number").agg(F.count("*").alias("n"), F.sum("value_dec").cast("string").alias("total"))


@register("""WITH c AS (SELECT epoch_us(ts) // 12000000 AS block_number, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY block_number) - n AS before FROM c),
p AS (SELECT before // 2500 AS part, min(block_number) AS f, max(block_number) AS to_block, sum(n)::BIGINT AS rows, max(before + n) AS after FROM r GROUP BY 1)
SELECT to_block, rows FROM p WHERE after >= (part + 1) * 2500""")
def sealed_ranges(spark, sf_dir):
    """Segments that two sealing runs leave: the same as one run's, since they follow the rows."""
    s = _store(spark)
    rows = facts.event_transfers(spark, sf_dir).drop("event_type")
    names = {"t": sorted(rows.columns)}
    first, last = rows.agg(F.min("block_number"), F.max("block_number")).first()
    s.commit_window({"t": rows}, {last: "a"}, last, 0)
    s.seal_and_prune((first + last) // 2, names, size=2500)
    s.seal_and_prune(last, names, size=2500)
    return spark.createDataFrame([(x.to_block, x.rows) for x in s.segments("t")], "to_block long, rows long")


@register(f"WITH {EVENTS} SELECT block_number, log_index, value FROM e")
def stream_reorg(spark, sf_dir):
    """Two batches of which the second finds that the first is no longer the chain's: taken back, applied anew, each row once."""
    logs = facts.event_transfers(spark, sf_dir).select("block_number", "log_index", "value")
    first, last = logs.agg(F.min("block_number"), F.max("block_number")).first()
    middle, quarter = (first + last) // 2, (3 * first + last) // 4
    held = {quarter: "q", middle: "old"}
    d = ingest.Dataset(_store(spark), lambda x: {"t": x}, {"t": logs.columns})
    chain = ingest.Chain(lambda blocks: {b: held[b] for b in blocks if b in held}, lambda a, b: logs.where(F.col("block_number").between(a, b)))
    run = ingest.for_each_batch([d], lambda batch: (lambda top: {top: held.get(top, "h")})(batch.agg(F.max("block_number")).first()[0]), chain)
    ingest.apply_window(d, logs.where(F.col("block_number") <= quarter), {quarter: "q"}, quarter, 0)
    wrong = logs.where((F.col("block_number") > quarter) & (F.col("block_number") <= middle)).withColumn("value", F.lit("wrong"))
    ingest.apply_window(d, wrong, {middle: "old"}, middle, 1)
    held[middle] = "new"
    run(logs.where(F.col("block_number") > middle), 2)
    return d.store.view("t", logs.columns).select("block_number", "log_index", "value")


@register(f"""WITH {EVENTS} SELECT block_number, log_index, kind FROM e, (VALUES ('flag', 1), ('flag_retracted', 2), ('flag', 3)) AS k(kind, i) WHERE value::HUGEINT > 5000""")
def alerts_after_reorg(spark, sf_dir):
    """A flag, its retraction, and the same flag on the new branch: three alerts for each."""
    flags = facts.event_transfers(spark, sf_dir).where("CAST(value AS DECIMAL(38,0)) > 5000").select("block_number", "log_index")
    box = ingest.Outbox(spark, f"{_shared(spark)}/box-{_name()}", most=1 << 40)
    for weight, batch in ((1, 1), (-1, 2), (1, 3), (1, 3)):
        box.put(flags, weight, ["block_number", "log_index"], batch)
    row = lambda c: F.get_json_object("body", f"$.{c}").cast("long").alias(c)
    return box.pending().select(row("block_number"), row("log_index"), "kind")


def _name() -> str:
    import uuid

    return uuid.uuid4().hex


def _shared(spark) -> str:
    """The folder that all executors share; one of this machine's where Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="ledgerloom-store-")


def _store(spark) -> store.Store:
    return store.Store(spark, f"{_shared(spark)}/store-{_name()}")
