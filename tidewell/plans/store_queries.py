"""The queries over the reference entry tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import datum as D
from tidewell.functions.keys import between, literal_key, sub_key
from tidewell.operators import entries as E
from tidewell.operators.intervals import interval_semi_join, merge_intervals
from tidewell.plans import dsl
from tidewell.plans.stores import cents, customer_store, event_log, mixed_store, orders_store
from tidewell.session import shared_dir, table
from tidewell.sources.kv import KvDataSource
from tidewell.spec import SubValueSpec
from tidewell.store import Store
from tidewell.streaming.feed import StateTable, current, follow

CUSTKEY, STATUS, PRICE, PRIORITY, PAIR = SubValueSpec((0,), D.I64), SubValueSpec((1,), D.STR), SubValueSpec((2, 0), D.I64), SubValueSpec((2, 1), D.STR), SubValueSpec((2,), D.TUPLE)
ORDER_INDEXES = {CUSTKEY, STATUS, PRICE, PRIORITY, PAIR}
TYPE, CENTS = SubValueSpec((0,), D.STR), SubValueSpec((1,), D.I64)
FLAT_ORDER = ["pk", "pv._0 AS custkey", "pv._1 AS status", "pv._2._0 AS cents", "pv._2._1 AS priority", "pv._3 AS at"]
FLAT_EVENT = ["pk", "pv._0 AS event_type", "pv._1 AS cents", "pv._2 AS props"]
ORDER_COLS = "o_orderkey AS pk, o_custkey AS custkey, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority AS priority, epoch_us(o_orderdate) AS at"
EVENT_COLS = "user_id AS pk, event_type, CAST(round(value * 100) AS BIGINT) AS cents, props"


def run_statement(store: DataFrame, indexes: set[SubValueSpec], text: str) -> DataFrame:
    """A get of the query language over a typed store."""
    s = dsl.parse(text)
    if isinstance(s, dsl.GetPK):
        return E.pk_range(store, s.lo, s.hi)
    if isinstance(s, dsl.GetSV):
        return E.sv_range(store, s.spec, s.lo, s.hi, indexes)
    raise dsl.ParseError("not a read")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return run_statement(
        orders_store(spark, d),
        ORDER_INDEXES,
        "get where svspec(2 0 int) between int(10000000) int(20000000)",
    ).selectExpr(*FLAT_ORDER)


def _pk(lo, hi):
    return lambda spark, d: E.pk_range(orders_store(spark, d), lo, hi).selectExpr(*FLAT_ORDER)


def _price_bounds(spec, lo, hi) -> tuple[int | None, int | None]:
    """What bounds on a sub-value say about the cents alone."""
    if spec == PAIR:
        lo, hi = lo and lo[0], hi and hi[0]
    return tuple(x if spec in (PRICE, PAIR) and isinstance(x, int) else None for x in (lo, hi))


def _sv(spec, lo=None, hi=None):
    return lambda spark, d: E.sv_range(orders_store(spark, d, *_price_bounds(spec, lo, hi)), spec, lo, hi, ORDER_INDEXES).selectExpr(*FLAT_ORDER)


def _dsl(text):
    s = dsl.parse(text)
    bounds = _price_bounds(s.spec, s.lo, s.hi) if isinstance(s, dsl.GetSV) else (None, None)
    return lambda spark, d: run_statement(orders_store(spark, d, *bounds), ORDER_INDEXES, text).selectExpr(*FLAT_ORDER)


def sv_tuple_at_bounds(spark: SparkSession, d: str) -> DataFrame:
    """A tuple range whose bounds are values that occur, with other second members beside them: the pairs of two orders, lowered and raised there."""
    pairs = sorted((int(r[0]), r[1]) for r in orders_store(spark, d).filter("pk IN (100, 200)").select("pv._2._0", "pv._2._1").collect())  # two rows
    (a, p), (b, q) = pairs
    inside, outside = _sv(PAIR, (a, p), (b, q))(spark, d), _sv(PAIR, (a, p + "0"), (b, q[:-1]))(spark, d)
    return inside.withColumn("bounds", F.lit("on")).unionByName(outside.withColumn("bounds", F.lit("within")))


def key_only_scan(spark: SparkSession, d: str) -> DataFrame:
    return orders_store(spark, d).select("pk")


def pk_range_cross_type(spark: SparkSession, d: str) -> DataFrame:
    return E.key_range(mixed_store(spark, d), 3, "NATION_15").select("tag", "ki", "ks", "kt")


def datum_order_rank(spark: SparkSession, d: str) -> DataFrame:
    """Each key's place in the order of all keys, by its binary key."""
    return E.place(mixed_store(spark, d), "pk_key", "place").select("tag", "ki", "ks", "kt", "place")


def _mixed_whole(tag: int, lo=None, hi=None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = mixed_store(spark, d).withColumn("sv_key", sub_key(F.col("pv_key"), (), tag))
        return s.filter(F.col("sv_key").isNotNull() & between(F.col("sv_key"), lo, hi)).orderBy("sv_key", "pk_key").select("tag", "ki", "ks", "kt")

    return run


def mixed_member_eq(spark: SparkSession, d: str) -> DataFrame:
    """A member of values without a common schema: the encoded value is sliced by path."""
    s = mixed_store(spark, d).withColumn("sv_key", sub_key(F.col("pv_key"), (0,), D.STR))
    return s.filter(F.col("sv_key") == literal_key("purchase")).select("tag", "ki", "ks", "kt")


def sv_customer_segment(spark: SparkSession, d: str) -> DataFrame:
    segment = SubValueSpec((3,), D.STR)
    rows = E.sv_range(customer_store(spark, d), segment, "BUILDING", "FURNITURE", {segment})
    return rows.select("sv", "pk", F.col("pv._0").alias("name"))


def lww_current(spark: SparkSession, d: str) -> DataFrame:
    return E.current(event_log(spark, d), ["pk"], ["commit_ver"]).selectExpr(*FLAT_EVENT)


def snapshot_at(spark: SparkSession, d: str) -> DataFrame:
    return E.current(E.snapshot(event_log(spark, d), 5000), ["pk"], ["commit_ver"]).selectExpr(*FLAT_EVENT)


def lww_point(spark: SparkSession, d: str) -> DataFrame:
    return E.current(event_log(spark, d).filter(F.col("pk") == 42), ["pk"], ["commit_ver"]).selectExpr(*FLAT_EVENT)


def read_your_writes(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot at 5000 under the staged changes 5001 to 6000."""
    log = event_log(spark, d)
    staged = log.filter("commit_ver > 5000 AND commit_ver <= 6000").withColumn("seq", F.col("commit_ver")).drop("commit_ver")
    view = E.staged_over(E.snapshot(log, 5000).withColumn("seq", F.lit(0).cast("bigint")), staged, ["commit_ver"])
    return E.current(view, ["pk"], ["commit_ver", "seq"]).selectExpr(*FLAT_EVENT)


def index_build(spark: SparkSession, d: str) -> DataFrame:
    live = E.current(event_log(spark, d), ["pk"], ["commit_ver"])
    return E.index_rows(live, TYPE).select("sv", "pk", F.col("pv._1").alias("cents"), F.col("pv._2").alias("props"))


def _delta(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d).withColumn("sv", F.col("pv._0"))
    return E.index_delta(log, ["pk"], ["commit_ver"])


def index_delta(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d).select("sv", "pk", "commit_ver", F.col("pv._1").alias("cents"), F.col("pv._2").alias("props"))


def index_after_delta(spark: SparkSession, d: str) -> DataFrame:
    """The folded delta: the same rows as an index built anew."""
    return E.current(_delta(spark, d), ["sv", "pk"], ["commit_ver"]).select("sv", "pk", F.col("pv._1").alias("cents"), F.col("pv._2").alias("props"))


WINDOW = 200


def conflict_check(spark: SparkSession, d: str) -> DataFrame:
    """Transactions that must be retried: each click reads the users up to 3 above its own as of its version; did any of the next 200 write one?

    Version windows are the join key (each window touches two), users the interval; a pair never meets outside its window.
    """
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    reads = events.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("txn"),
        F.col("user_id").alias("lo"),
        (F.col("user_id") + 3).alias("hi"),
        F.explode(F.sequence(F.expr(f"(event_id + 1) div {WINDOW}"), F.expr(f"(event_id + {WINDOW}) div {WINDOW}"))).alias("win"),
    )
    writes = events.select("event_id", F.col("user_id").alias("lo"), F.col("user_id").alias("hi"), F.expr(f"event_id div {WINDOW}").alias("win"))
    hit = interval_semi_join(
        reads,
        writes,
        ["win"],
        ["txn"],
        condition=lambda r,
        w: (w("event_id") > r("txn")) & (w("event_id") <= r("txn") + WINDOW),
    )
    return hit.distinct()


def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    """The unions of overlapping read intervals, [cents, cents + 5,000,000] of each customer's orders."""
    rows = orders_store(spark, d).select(F.col("pv._0").alias("custkey"), F.col("pv._2._0").alias("lo")).withColumn("hi", F.col("lo") + 5_000_000)
    return merge_intervals(rows, ["custkey"], block_bits=22).select("custkey", "lo", "hi")


def compact_full(spark: SparkSession, d: str) -> DataFrame:
    return E.compact(event_log(spark, d), ["pk"], ["commit_ver"], True).select("pk", "commit_ver", F.col("pv._0").alias("event_type"))


def compact_partial(spark: SparkSession, d: str) -> DataFrame:
    """Of versions 5001 to 8000: older units lie below, so tombstones stay."""
    part = event_log(spark, d).filter("commit_ver > 5000 AND commit_ver <= 8000")
    return E.compact(part, ["pk"], ["commit_ver"], False).select("pk", "commit_ver", F.col("pv._0").alias("event_type"))


def txn_sum_guard(spark: SparkSession, d: str) -> DataFrame:
    """Sums over an index scan, as a transaction would take them before it adds to them."""
    rows = E.sv_range(orders_store(spark, d), PRICE, 0, 20_000_000, ORDER_INDEXES)
    return rows.groupBy(F.col("pv._0").alias("custkey")).agg(F.sum("sv").alias("total")).withColumn("may_add", F.col("total") <= 80_000_000)


def txn_count_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = E.sv_range(orders_store(spark, d), STATUS, "O", "O", ORDER_INDEXES)
    return rows.groupBy(F.col("pv._0").alias("custkey")).agg(F.count(F.lit(1)).alias("open_orders")).filter("open_orders >= 5")


PARTS = ["tag", "ki", "ks", "kt"]


def _filled(spark: SparkSession, d: str) -> tuple[Store, DataFrame]:
    """A store of the mixed entries, with an index on whole integers made in between, suppliers deleted and nations rewritten as texts."""
    store, mixed = Store(spark, shared_dir(spark, "store")), mixed_store(spark, d)
    store.put_many(mixed.filter("tag <> 4").select("pk_key", "pv_key"))
    store.create_index(SubValueSpec.whole(D.I64))
    store.put_many(mixed.filter("tag = 4").select("pk_key", "pv_key"))
    changed = mixed.filter("tag IN (2, 3)").withColumn(
        "pv_key",
        F.when((F.col("tag") == 3) & (F.length("ks") > 8), literal_key("renamed")).when(F.col("tag") == 3, F.col("pv_key")),
    )
    store.put_many(changed.select("pk_key", "pv_key"))
    return store, mixed


def store_current(spark: SparkSession, d: str) -> DataFrame:
    store, mixed = _filled(spark, d)
    return mixed.join(store.entries().select("pk_key"), "pk_key").select(*PARTS)


def store_compacted(spark: SparkSession, d: str) -> DataFrame:
    store, mixed = _filled(spark, d)
    store.compact()
    store.vacuum()
    return mixed.join(store.entries(None, "NATION_1", None).select("pk_key"), "pk_key").select(*PARTS)


def store_index_scan(spark: SparkSession, d: str) -> DataFrame:
    store, mixed = _filled(spark, d)
    return mixed.join(store.sv_entries(SubValueSpec.whole(D.I64), 1, 3).select("pk_key"), "pk_key").select(*PARTS)


def store_statements(spark: SparkSession, d: str) -> DataFrame:
    """Writes, index statements and reads as query texts."""
    store = Store(spark, shared_dir(spark, "store"))
    for text in (
        "put int(100) int(1000)",
        "put int(101) int(1010)",
        "put int(102) str(1020)",
        "del int(102)",
        "create index svspec(int)",
        "put int(7150) tup( str(t7150) tup( int(64) str(t64) ) int(64) )",
        "put int(100) int(900)",
    ):
        store.query(text)
    text = F.udf(lambda k: D.render(D.decode_key(bytes(k))), "string")  # a handful of rows, for show
    reads = [
        store.query(q).select(F.lit(q).alias("query"), text("pk_key").alias("pk"), text("pv_key").alias("pv")) for q in (
            "get int(102)",
            "get between int(101) str(quayz)",
            "get where svspec(int) between int(500) int(1500)",
        )
    ]
    return reads[0].unionByName(reads[1]).unionByName(reads[2])


def kv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The mixed entries through entry files and back."""
    spark.dataSource.register(KvDataSource)
    path, mixed = shared_dir(spark, "kv"), mixed_store(spark, d)
    mixed.select("pk_key", "pv_key").write.format("kv").mode("append").save(path)
    back = spark.read.format("kv").load(path).select("pk_key", F.col("pv_key").alias("again"))
    return mixed.join(back, "pk_key").filter(F.col("again") == F.col("pv_key")).select(*PARTS)


def stream_current(spark: SparkSession, d: str) -> DataFrame:
    """The current state, kept up by a stream over the files of an event feed, in any order of arrival."""
    feed = shared_dir(spark, "feed")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")
    events.repartition(6, "event_id").write.parquet(feed)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(feed)
    state = StateTable(spark, shared_dir(spark, "state"), ["user_id"], ["event_id"], ["event_type", "value", "props"])
    follow(spark, stream, state, shared_dir(spark, "offsets"))
    return current(state, F.col("event_type") == "error").select(F.col("user_id").alias("pk"), "event_type", cents("value").alias("cents"), "props")


def queries() -> dict:
    low, high = (10_000_000, "normal"), (20_000_000, "")
    plain = (
        key_only_scan, sv_tuple_at_bounds, pk_range_cross_type, datum_order_rank, mixed_member_eq, sv_customer_segment, lww_current, lww_point, snapshot_at, read_your_writes, index_build, index_delta, index_after_delta,
        store_current, store_compacted, store_index_scan, store_statements, kv_round_trip, stream_current, conflict_check, interval_merge, compact_full, compact_partial, txn_sum_guard, txn_count_guard,
    )
    return {
        "pk_get_one": _pk(100, 100), "pk_get_missing": _pk(-5, -5), "pk_range_closed": _pk(100, 250), "pk_range_lo": _pk(1400, None), "pk_range_hi": _pk(None, 250), "pk_range_all": _pk(None, None),
        "pk_range_inverted": _pk(250, 100), "pk_bound_other_type": _pk(1000, "any text"), "sv_member_eq": _sv(CUSTKEY, 100, 100), "sv_member_range": _sv(CUSTKEY, 20, 60), "sv_member_all": _sv(STATUS),
        "sv_nested_range": _sv(PRICE, 10_000_000, 20_000_000), "sv_nested_str": _sv(PRIORITY, "1-URGENT", "3-MEDIUM"), "sv_tuple_range": _sv(PAIR, low, high), "sv_bound_other_type": _sv(PRICE, 30_000_000, "z"),
        "sv_type_mismatch": lambda spark, d: E.sv_range(orders_store(spark, d), SubValueSpec((0,), D.STR), None, None, {SubValueSpec((0,), D.STR)}).selectExpr(*FLAT_ORDER),
        "sv_whole_all": _mixed_whole(D.I64), "sv_whole_eq": _mixed_whole(D.STR, "ASIA", "ASIA"), "sv_whole_range": _mixed_whole(D.I64, 3, 7),
        "dsl_get_one": _dsl("get int(100)"), "dsl_get_between": _dsl("get between int(100) int(250)"), "dsl_get_where": _dsl("get where svspec(2 0 int) between int(10000000) int(20000000)"), "dsl_get_where_all": _dsl("get where svspec(0 int) _"),
    } | {f.__name__: f for f in plain}


_MIXED = """
WITH mixed AS (
  SELECT 1 AS tag, CAST(r_regionkey AS BIGINT) AS ki, CAST(NULL AS VARCHAR) AS ks, CAST(NULL AS BIGINT) AS kt, 3 AS vt, CAST(NULL AS BIGINT) AS vi, r_name AS vs FROM region
  UNION ALL SELECT 2, NULL, s_name, NULL, 1, CAST(s_nationkey AS BIGINT), NULL FROM supplier
  UNION ALL SELECT 3, NULL, n_name, NULL, 1, CAST(n_regionkey AS BIGINT), NULL FROM nation
  UNION ALL SELECT 4, user_id, NULL, event_id, 4, NULL, event_type FROM events)
"""
_LOG = f"""
WITH log AS (SELECT {EVENT_COLS}, event_id AS commit_ver FROM events),
"""


def _last(where: str = "TRUE") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY pk ORDER BY commit_ver DESC) AS rn FROM log WHERE {where}"


def oracles() -> dict[str, str]:
    orders = lambda where: f"SELECT * FROM (SELECT {ORDER_COLS} FROM orders) WHERE {where}"
    live = lambda where: f"{_LOG} last AS ({_last(where)}) SELECT pk, event_type, cents, props FROM last WHERE rn = 1 AND event_type <> 'error'"
    built = f"{_LOG} last AS ({_last()}) SELECT event_type AS sv, pk, cents, props FROM last WHERE rn = 1 AND event_type <> 'error'"
    return {
        "pk_get_one": orders("pk = 100"), "pk_get_missing": orders("pk = -5"), "pk_range_closed": orders("pk BETWEEN 100 AND 250"), "pk_range_lo": orders("pk >= 1400"), "pk_range_hi": orders("pk <= 250"),
        "pk_range_all": orders("TRUE"), "pk_range_inverted": orders("pk BETWEEN 250 AND 100"), "pk_bound_other_type": orders("pk >= 1000"), "sv_member_eq": orders("custkey = 100"), "sv_member_range": orders("custkey BETWEEN 20 AND 60"),
        "sv_member_all": orders("TRUE"), "sv_nested_range": orders("cents BETWEEN 10000000 AND 20000000"), "sv_nested_str": orders("priority BETWEEN '1-URGENT' AND '3-MEDIUM'"),
        "sv_tuple_range": orders("(cents > 10000000 OR (cents = 10000000 AND priority >= 'normal')) AND (cents < 20000000 OR (cents = 20000000 AND priority <= ''))"),
        "sv_tuple_at_bounds": f"""WITH o AS (SELECT {ORDER_COLS} FROM orders), e AS (SELECT min(cents) AS a, max(cents) AS b FROM o WHERE pk IN (100, 200))
SELECT o.*, 'on' AS bounds FROM o, e WHERE cents BETWEEN a AND b AND (cents > a OR priority >= (SELECT priority FROM o WHERE pk IN (100, 200) ORDER BY cents LIMIT 1)) AND (cents < b OR priority <= (SELECT priority FROM o WHERE pk IN (100, 200) ORDER BY cents DESC LIMIT 1))
UNION ALL SELECT o.*, 'within' FROM o, e WHERE cents BETWEEN a AND b AND (cents > a OR priority >= (SELECT priority || '0' FROM o WHERE pk IN (100, 200) ORDER BY cents LIMIT 1)) AND (cents < b OR priority <= (SELECT priority[:-2] FROM o WHERE pk IN (100, 200) ORDER BY cents DESC LIMIT 1))""",
        "sv_bound_other_type": orders("cents >= 30000000"), "sv_type_mismatch": orders("FALSE"),
        "sv_whole_all": f"{_MIXED} SELECT tag, ki, ks, kt FROM mixed WHERE vt = 1", "sv_whole_eq": f"{_MIXED} SELECT tag, ki, ks, kt FROM mixed WHERE vt = 3 AND vs = 'ASIA'",
        "sv_whole_range": f"{_MIXED} SELECT tag, ki, ks, kt FROM mixed WHERE vt = 1 AND vi BETWEEN 3 AND 7", "mixed_member_eq": f"{_MIXED} SELECT tag, ki, ks, kt FROM mixed WHERE vt = 4 AND vs = 'purchase'",
        "dsl_get_one": orders("pk = 100"), "dsl_get_between": orders("pk BETWEEN 100 AND 250"), "dsl_get_where": orders("cents BETWEEN 10000000 AND 20000000"), "dsl_get_where_all": orders("TRUE"),
        "key_only_scan": "SELECT o_orderkey AS pk FROM orders",
        "pk_range_cross_type": f"{_MIXED} SELECT tag, ki, ks, kt FROM mixed WHERE (tag = 1 AND ki >= 3) OR tag = 2 OR (tag = 3 AND ks <= 'NATION_15')",
        "store_current": f"{_MIXED} SELECT tag, ki, ks, kt FROM mixed WHERE tag <> 2",
        "store_compacted": f"{_MIXED} SELECT tag, ki, ks, kt FROM mixed WHERE tag = 4 OR (tag = 3 AND ks >= 'NATION_1')",
        "store_index_scan": f"{_MIXED} SELECT tag, ki, ks, kt FROM mixed WHERE tag = 3 AND length(ks) <= 8 AND vi BETWEEN 1 AND 3",
        "store_statements": """SELECT * FROM (VALUES ('get between int(101) str(quayz)', 'I64(101)', 'I64(1010)'), ('get between int(101) str(quayz)', 'I64(7150)', 'Tuple([Str("t7150"), Tuple([I64(64), Str("t64")]), I64(64)])'),
('get where svspec(int) between int(500) int(1500)', 'I64(100)', 'I64(900)'), ('get where svspec(int) between int(500) int(1500)', 'I64(101)', 'I64(1010)')) AS t(query, pk, pv)""",
        "kv_round_trip": f"{_MIXED} SELECT tag, ki, ks, kt FROM mixed", "stream_current": live("TRUE"),
        "datum_order_rank": f"{_MIXED} SELECT tag, ki, ks, kt, row_number() OVER (ORDER BY tag, ki, ks, kt) AS place FROM mixed",
        "sv_customer_segment": "SELECT c_mktsegment AS sv, c_custkey AS pk, c_name AS name FROM customer WHERE c_mktsegment BETWEEN 'BUILDING' AND 'FURNITURE'",
        "lww_current": live("TRUE"), "lww_point": live("pk = 42"), "snapshot_at": live("commit_ver <= 5000"), "read_your_writes": live("commit_ver <= 6000"), "index_build": built, "index_after_delta": built,
        "index_delta": f"""{_LOG}
h AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS new_sv, lag(CASE WHEN event_type <> 'error' THEN event_type END) OVER w AS old_sv, lag(cents) OVER w AS old_cents, lag(props) OVER w AS old_props
  FROM log WINDOW w AS (PARTITION BY pk ORDER BY commit_ver))
SELECT old_sv AS sv, pk, commit_ver, CAST(NULL AS BIGINT) AS cents, CAST(NULL AS VARCHAR) AS props FROM h WHERE old_sv IS NOT NULL AND old_sv IS DISTINCT FROM new_sv
UNION ALL SELECT new_sv, pk, commit_ver, cents, props FROM h WHERE new_sv IS NOT NULL AND NOT (old_sv IS NOT DISTINCT FROM new_sv AND old_cents IS NOT DISTINCT FROM cents AND old_props IS NOT DISTINCT FROM props)
""",
        "conflict_check": f"SELECT DISTINCT r.event_id AS txn FROM events r JOIN events w ON w.event_id > r.event_id AND w.event_id <= r.event_id + {WINDOW} AND w.user_id BETWEEN r.user_id AND r.user_id + 3 WHERE r.event_type = 'click'",
        "interval_merge": """
WITH i AS (SELECT o_custkey AS custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS lo, CAST(round(o_totalprice * 100) AS BIGINT) + 5000000 AS hi FROM orders),
f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY custkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS grp FROM f)
SELECT custkey, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY custkey, grp
""",
        "compact_full": f"{_LOG} last AS ({_last()}) SELECT pk, commit_ver, event_type FROM last WHERE rn = 1 AND event_type <> 'error'",
        "compact_partial": f"{_LOG} last AS ({_last('commit_ver > 5000 AND commit_ver <= 8000')}) SELECT pk, commit_ver, CASE WHEN event_type <> 'error' THEN event_type END AS event_type FROM last WHERE rn = 1",
        "txn_sum_guard": "SELECT custkey, total, total <= 80000000 AS may_add FROM (SELECT custkey, CAST(sum(cents) AS BIGINT) AS total FROM (SELECT o_custkey AS custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) WHERE cents BETWEEN 0 AND 20000000 GROUP BY custkey)",
        "txn_count_guard": "SELECT o_custkey AS custkey, count(*) AS open_orders FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) >= 5",
    }
