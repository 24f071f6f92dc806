"""Transactions, concurrent writers, index life cycle, unit directories and the HTTP front end over the driver's tables, with their SQL.

Each makes a store from a table and gives as rows what the store holds, or answers, afterwards.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import datum as D
from tidewell.functions.keys import key_of, literal_key, sub_key
from tidewell.operators.entries import current
from tidewell.plans.stores import mixed_store
from tidewell.server import respond
from tidewell.session import shared_dir, table
from tidewell.sources.unit_dirs import list_units, read_index_units, read_units, remove_units, write_units
from tidewell.spec import SubValueSpec
from tidewell.store import Busy, IndexExists, Store, Terminating
from tidewell.txn import Abort, Commit, RetryLimit, Txn, get_one, put_one, run

INT = SubValueSpec.whole(D.I64)
RETRIES = 50
UNITS_AT_ONCE = 1 << 16


def _regions(spark: SparkSession, d: str) -> list:
    return table(spark, d, "region").orderBy("r_regionkey").collect()  # five rows, fixed


def _rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def _nations(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("v"), "n_regionkey")
    kinds = {f.name: f.dataType for f in t.schema}
    return t.select(key_of(F.col("k"), kinds["k"]).alias("pk_key"), key_of(F.col("v"), kinds["v"]).alias("pv_key"), "k", "v", "n_regionkey")


def _store(spark: SparkSession, **how) -> Store:
    return Store(spark, shared_dir(spark, "store"), **how)


def _racing(jobs: list[Callable[[], object]]) -> None:
    """Runs the jobs at once; an error of any of them is raised."""
    errors: list[Exception] = []

    def go(job):
        try:
            job()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=go, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if errors:
        raise errors[0]


def store_two_writers(spark: SparkSession, d: str) -> DataFrame:
    """Nations written by two openings of one store in turns, with vacuum and compaction in between: none is lost."""
    nations, root = _nations(spark, d), shared_dir(spark, "store")
    a, b = Store(spark, root), Store(spark, root)
    _racing(
        [
            lambda: a.put_many(nations.filter("n_regionkey < 2").select("pk_key", "pv_key")),
            lambda: b.put_many(nations.filter("n_regionkey = 2").select("pk_key", "pv_key")),
        ]
    )
    a.vacuum()
    b.put_many(nations.filter("n_regionkey > 2").select("pk_key", "pv_key"))
    a.compact()
    b.vacuum()
    return nations.join(a.entries().select("pk_key"), "pk_key").select(F.col("k").alias("n_nationkey"), F.col("v").alias("n_name"))


def txn_lost_update(spark: SparkSession, d: str) -> DataFrame:
    """One transaction a region, all at once, adds the region's key to a counter."""
    store = _store(spark)

    def add(n: int):
        def fn(t: Txn):
            found = t.get_pk_one("counter")
            t.put("counter", n + (found[1] if found else 0))
            return Commit()

        return lambda: run(store, fn, RETRIES)

    _racing([add(r.r_regionkey) for r in _regions(spark, d)])
    return _rows(spark, [(run(store, get_one("counter"))[1],)], "total bigint")


def txn_write_skew(spark: SparkSession, d: str) -> DataFrame:
    """All regions keep watch; each leaves if it sees more than two on watch. Two stay."""
    store, regions = _store(spark), _regions(spark, d)
    watch = SubValueSpec.whole(D.BYTES)
    store.create_index(watch)
    run(store, lambda t: Commit(t.put_all({r.r_name: b"\1" for r in regions})))

    def leave(name: str):
        def fn(t: Txn):
            if len(t.get_sv_range(watch, b"\1", b"\1")) > 2:
                t.put(name, b"\0")
            return Commit()

        return lambda: run(store, fn, RETRIES)

    _racing([leave(r.r_name) for r in regions])
    return store.sv_entries(watch, b"\1", b"\1").agg(F.count(F.lit(1)).alias("on_watch"))


def txn_phantom(spark: SparkSession, d: str) -> DataFrame:
    """Each region adds an item of weight 9 as long as the sum over the index stays within 27."""
    store = _store(spark)
    store.create_index(INT)

    def add(name: str):
        def fn(t: Txn):
            if sum(sv for sv, _, _ in t.get_sv_range(INT)) + 9 <= 27:
                t.put(name, 9)
            return Commit()

        return lambda: run(store, fn, RETRIES)

    _racing([add(r.r_name) for r in _regions(spark, d)])
    return store.sv_entries(INT).agg((F.count(F.lit(1)) * 9).alias("weight"))


def txn_dirty_write(spark: SparkSession, d: str) -> DataFrame:
    """One transaction a region writes its number to all nations, some abort after their writes: the nations agree on one that committed."""
    store, nations = _store(spark), [r.k for r in _nations(spark, d).select("k").collect()]  # 25 rows, fixed

    def write(n: int):
        def fn(t: Txn):
            t.put_all(dict.fromkeys(nations, n))
            return Abort() if n % 2 else Commit()

        return lambda: run(store, fn, RETRIES)

    _racing([write(r.r_regionkey) for r in _regions(spark, d)])
    found = store.entries()
    return found.agg(
        F.count(F.lit(1)).alias("nations"),
        F.count_distinct("pv_key").alias("numbers"),
        F.bool_or(F.col("pv_key").isin(*[bytearray(D.encode_key(n)) for n in (1, 3)])).alias("aborted_seen"),
    )


def txn_dirty_read(spark: SparkSession, d: str) -> DataFrame:
    """What others see of a transaction's writes: before its commit, within it, after an abort, and after the commit."""
    store, name = _store(spark), _regions(spark, d)[0].r_name
    out, txn = [], Txn(store)
    txn.put(name, 1)
    look = lambda what: out.append((what, (run(store, get_one(name)) or (None, None))[1]))
    look("before the commit")
    out.append(("within", txn.get_pk_one(name)[1]))
    run(store, lambda t: Abort(t.put(name, 7)))
    look("after an abort")
    txn.commit()
    txn.close()
    look("after the commit")
    return _rows(spark, out, "moment string, seen bigint")


def txn_repeatable_read(spark: SparkSession, d: str) -> DataFrame:
    """A reader's view of all nations while they are rewritten, compacted and vacuumed, and a new reader's."""
    store, nations = _store(spark), _nations(spark, d)
    store.put_many(nations.select("pk_key", "pv_key"))
    old = Txn(store)
    store.put_many(nations.select("pk_key", literal_key("changed").alias("pv_key")))
    store.compact()
    store.vacuum()
    first = [("old", *x) for x in old.get_pk_range()]
    old.close()
    return _rows(spark, first + [("new", *x) for x in Txn(store).get_pk_range()], "reader string, n_nationkey bigint, n_name string")


def txn_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How transactions end: without writes, after a conflict, with too many conflicts, by abort, on a serial store, after closing."""
    name, out = _regions(spark, d)[0].r_name, []

    def outcome(what: str, fn: Callable[[], object]) -> None:
        try:
            out.append((what, str(fn())))
        except (RetryLimit, Terminating, RuntimeError) as e:
            out.append((what, type(e).__name__))

    store, tries = _store(spark), []

    def bothered(times: int):
        def fn(t: Txn):
            tries.append(1)
            t.put(name, len(tries))
            if times > len(tries):
                run(store, put_one(name, 0))
            return Commit(len(tries))

        return fn

    outcome("read only", lambda: run(store, get_one(name)))
    outcome("second try", lambda: run(store, bothered(2), 5))
    tries.clear()
    outcome("retry limit", lambda: run(store, bothered(9), 2))
    outcome("abort", lambda: run(store, lambda t: Abort("nothing")))
    outcome("abort, serial", lambda: run(_store(spark, serial=True), lambda t: Abort()))
    store.close()
    outcome("closed", lambda: Txn(store))
    return _rows(spark, out, "what string, outcome string")


def index_life_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Creation beside commits, double creation, another one meanwhile, deletion, and what a scan says at each time."""
    store, out = _store(spark), []
    mixed = mixed_store(spark, d)
    store.put_many(mixed.select("pk_key", "pv_key"))

    def step(what: str, fn: Callable[[], object]) -> None:
        try:
            r = fn()
            out.append((what, "done" if r is None else str(r)))
        except IndexExists as e:
            out.append((what, "exists, readable" if e.readable else "exists, building"))
        except (Busy, LookupError) as e:
            out.append((what, type(e).__name__))

    count = lambda: store.sv_entries(INT).count()
    step("scan before", count)
    build = store._build

    def meanwhile(m, name, spec):
        other = Store(spark, store.root)
        real = other.put_many

        def during(*a):
            step("scan while building", count)
            step("create again while building", lambda: other.create_index(INT))
            step("create another while building", lambda: other.create_index(SubValueSpec.whole(D.STR)))
            step("delete while building", lambda: other.delete_index(INT))
            real(_rows(spark, [(bytearray(D.encode_key("late")), bytearray(D.encode_key(1)))], "pk_key binary, pv_key binary"))

        publish = store._publish

        def once(new):
            publish(new)
            store._publish = publish
            during()

        store._publish = once
        build(m, name, spec)

    store._build = meanwhile
    step("create", lambda: store.create_index(INT))
    store._build = build
    step("scan", count)
    step("create again", lambda: store.create_index(INT))
    step("delete", lambda: store.delete_index(INT))
    step("delete again", lambda: store.delete_index(INT))
    step("scan after", count)
    return _rows(spark, out, "step string, outcome string")


def units_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The mixed entries as unit directories with an index file each, one of them replaced and one unfinished, and back."""
    root, mixed = shared_dir(spark, "units"), mixed_store(spark, d)
    log = mixed.select(F.col("tag").cast("bigint").alias("unit_num"), "pk_key", "pv_key")
    log = log.unionByName(
        log.filter("unit_num = 2").withColumn("unit_num", F.lit(20).cast("bigint"))
    ).unionByName(log.filter("unit_num = 1").withColumn("unit_num", F.lit(30).cast("bigint")))
    units = _rows(
        spark,
        [(1, 1, 1, 0, 0), (2, 2, 2, 0, 0), (3, 3, 3, 0, 0), (4, 4, 4, 0, 0), (20, 2, 2, 1, 1)],
        "unit_num bigint, commit_ver_hi_incl bigint, commit_ver_lo_incl bigint, replacement_num bigint, data_type int",
    )
    index = log.withColumn(
        "sv_key",
        sub_key(F.col("pv_key"), (), D.I64),
    ).filter(F.col("sv_key").isNotNull()).select("unit_num", "sv_key", "pk_key", "pv_key")
    write_units(log, units, root, {1: index})
    entries = current(read_units(spark, root).withColumnRenamed("pv_key", "pv"), ["pk_key"], ["commit_ver", "seq"])
    indexed = read_index_units(spark, root, 1).select("pk_key", F.lit(True).alias("indexed"))
    both = mixed.join(entries.select("pk_key", "commit_ver"), "pk_key").join(indexed, "pk_key", "left")
    return both.select("tag", "ki", "ks", "kt", "commit_ver", F.coalesce("indexed", F.lit(False)).alias("indexed"))


def units_listed(spark: SparkSession, d: str) -> DataFrame:
    """All units' commit info through commit info files; a unit's directory is numbered by its store and its number there.

    A unit has a folder and two files, which take three blocks of disk (12 KB) whatever they hold. So the units are dealt to parts of about
    ``UNITS_AT_ONCE``; each part's directories are written and listed, the listing is kept as a table, and they are removed before the next part's.
    """
    listing = table(spark, d, "commit_units")
    units = listing.select(
        "store_id",
        "unit_num",
        "commit_ver_hi_incl",
        "commit_ver_lo_incl",
        "replacement_num",
        "data_type",
    ).dropna()
    units = units.withColumn("unit_num", F.shiftleft("store_id", 32).bitwiseOR(F.col("unit_num"))).drop("store_id")
    parts = max(1, math.ceil(listing.count() / UNITS_AT_ONCE))
    dealt = units.withColumn("part", F.pmod(F.xxhash64("unit_num"), F.lit(parts)).cast("int")).repartition("part").distinct()
    todo, done, root = (shared_dir(spark, label) for label in ("units-todo", "units-listed", "units"))
    dealt.write.partitionBy("part").parquet(todo)
    todo = spark.read.schema(dealt.schema).parquet(todo)
    number = F.col("unit_num").bitwiseAND(F.lit((1 << 32) - 1))
    for part in range(parts):
        some = todo.filter(F.col("part") == part).drop("part")
        write_units(some.select("unit_num", literal_key("k").alias("pk_key"), literal_key(1).alias("pv_key")), some, root)
        found = list_units(spark, root).select(
            F.shiftright("unit_num", 32).alias("store_id"),
            number.alias("unit_num"),
            "commit_ver_hi_incl",
            "commit_ver_lo_incl",
            "replacement_num",
            "data_type",
        )
        found.write.mode("append").parquet(done)
        remove_units(some, root)
    return spark.read.schema(found.schema).parquet(done)


def http_keys(spark: SparkSession, d: str) -> DataFrame:
    """Status and text of the key routes, for each region."""
    store, out = _store(spark), []
    for r in _regions(spark, d):
        path = f"/key/{r.r_name.replace(' ', '%20')}"
        out += [(r.r_name, what, *respond(store, method, path, r.r_name)) for what, method in (("1 missing", "GET"), ("2 put", "PUT"), ("3 found", "GET"), ("4 delete", "DELETE"), ("5 gone", "GET"))]
    return _rows(spark, out, "r_name string, what string, status int, text string")


def http_statements(spark: SparkSession, d: str) -> DataFrame:
    """Status of the query route over a store of the nations."""
    store = _store(spark)
    store.put_many(_nations(spark, d).select("pk_key", "pv_key"))
    texts = [
        "get int(3)",
        "get int(300)",
        "get between int(300) _",
        "create index svspec(str)",
        "create index svspec(str)",
        "get where svspec(str) str(nowhere)",
        "get where svspec(int) _",
        "delete index svspec(str)",
        "delete index svspec(str)",
        "put int(300) str(x)",
        "get int(300)",
        "del int(300)",
        "no statement",
    ]
    return _rows(spark, [(i, t, respond(store, "POST", "/query", t)[0]) for i, t in enumerate(texts)], "n int, statement string, status int")


def pk_order(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a key range with the place at which each comes out."""
    from tidewell.operators.entries import key_range

    rows = key_range(mixed_store(spark, d), 2, "NATION_3").select("tag", "ki", "ks", "kt").toPandas()  # regions, suppliers and some nations
    return _rows(
        spark,
        [(i, int(r.tag), None if r.ki != r.ki or r.ki is None else int(r.ki), r.ks) for i, r in enumerate(rows.itertuples())],
        "place int, tag int, ki bigint, ks string",
    )


def queries() -> dict:
    return {
        f.__name__: f
        for f in (store_two_writers, txn_lost_update, txn_write_skew, txn_phantom, txn_dirty_write, txn_dirty_read, txn_repeatable_read, txn_outcomes, index_life_cycle, units_round_trip, units_listed, http_keys, http_statements, pk_order)
    }


def oracles() -> dict[str, str]:
    from tidewell.plans.store_queries import _MIXED

    return {
        "store_two_writers": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation",
        "txn_lost_update": "SELECT CAST(sum(r_regionkey) AS BIGINT) AS total FROM region",
        "txn_write_skew": "SELECT least(count(*), 2) AS on_watch FROM region",
        "txn_phantom": "SELECT least(count(*), 3) * 9 AS weight FROM region",
        "txn_dirty_write": "SELECT count(*) AS nations, CAST(1 AS BIGINT) AS numbers, FALSE AS aborted_seen FROM nation",
        "txn_dirty_read": "SELECT * FROM (VALUES ('before the commit', CAST(NULL AS BIGINT)), ('within', 1), ('after an abort', NULL), ('after the commit', 1)) AS t(moment, seen)",
        "txn_repeatable_read": "SELECT 'old' AS reader, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation UNION ALL SELECT 'new', n_nationkey, 'changed' FROM nation",
        "txn_outcomes": "SELECT * FROM (VALUES ('read only', 'None'), ('second try', '2'), ('retry limit', 'RetryLimit'), ('abort', 'nothing'), ('abort, serial', 'RuntimeError'), ('closed', 'Terminating')) AS t(what, outcome)",
        "index_life_cycle": f"""{_MIXED}, n AS (SELECT count(*) AS n FROM mixed WHERE vt = 1)
SELECT step, CASE WHEN outcome = '#' THEN CAST((SELECT n + 1 FROM n) AS VARCHAR) ELSE outcome END AS outcome FROM (VALUES ('scan before', 'NoIndex'), ('scan while building', 'NoIndex'), ('create again while building', 'exists, building'),
  ('create another while building', 'Busy'), ('delete while building', 'Busy'), ('create', 'done'), ('scan', '#'), ('create again', 'exists, readable'), ('delete', 'done'), ('delete again', 'done'), ('scan after', 'NoIndex')) AS t(step, outcome)
""",
        "units_round_trip": f"{_MIXED} SELECT tag, ki, ks, kt, CAST(tag AS BIGINT) AS commit_ver, vt = 1 AS indexed FROM mixed",
        "units_listed": "SELECT DISTINCT store_id, unit_num, commit_ver_hi_incl, commit_ver_lo_incl, replacement_num, data_type FROM commit_units WHERE store_id IS NOT NULL AND unit_num IS NOT NULL AND commit_ver_hi_incl IS NOT NULL AND commit_ver_lo_incl IS NOT NULL AND replacement_num IS NOT NULL AND data_type IS NOT NULL",
        "http_keys": """SELECT r_name, what, CAST(status AS INTEGER) AS status, CASE WHEN status = 200 THEN 'Key:' || chr(13) || chr(10) || 'Str("' || r_name || '")' || chr(13) || chr(10) || 'Value:' || chr(13) || chr(10) || 'Str("' || r_name || '")' || chr(13) || chr(10) ELSE '' END AS text
FROM region, (VALUES ('1 missing', 404), ('2 put', 204), ('3 found', 200), ('4 delete', 204), ('5 gone', 404)) AS t(what, status)""",
        "http_statements": """SELECT CAST(n AS INTEGER) AS n, statement, CAST(status AS INTEGER) AS status FROM (VALUES (0, 'get int(3)', 200), (1, 'get int(300)', 404), (2, 'get between int(300) _', 204), (3, 'create index svspec(str)', 204), (4, 'create index svspec(str)', 304),
 (5, 'get where svspec(str) str(nowhere)', 204), (6, 'get where svspec(int) _', 500), (7, 'delete index svspec(str)', 204), (8, 'delete index svspec(str)', 204), (9, 'put int(300) str(x)', 204), (10, 'get int(300)', 200), (11, 'del int(300)', 204), (12, 'no statement', 500)) AS t(n, statement, status)""",
        "pk_order": f"{_MIXED} SELECT CAST(row_number() OVER (ORDER BY tag, ki, ks) - 1 AS INTEGER) AS place, CAST(tag AS INTEGER) AS tag, ki, ks FROM mixed WHERE (tag = 1 AND ki >= 2) OR tag = 2 OR (tag = 3 AND ks <= 'NATION_3')",
    }
