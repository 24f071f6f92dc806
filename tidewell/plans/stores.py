"""The entry tables that the queries read, over the driver's tables, in the engine's value model.

Money becomes whole cents, times microseconds, whole numbers 64-bit; rows without a key are not entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.keys import key_of
from tidewell.session import table


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _value(*members: Column) -> Column:
    return F.struct(*[m.alias(f"_{i}") for i, m in enumerate(members)])


def orders_store(spark: SparkSession, d: str, cents_from: int | None = None, cents_to: int | None = None) -> DataFrame:
    """pk o_orderkey; value (custkey, status, (price in cents, priority), time).

    Bounds on the cents may be given beforehand: as bounds on the price, a cent wider, they reach the scan, where those on a rounded
    product do not.
    """
    t = table(spark, d, "orders")
    if cents_from is not None:
        t = t.filter(F.col("o_totalprice") >= (cents_from - 1) / 100)
    if cents_to is not None:
        t = t.filter(F.col("o_totalprice") <= (cents_to + 1) / 100)
    value = _value(F.col("o_custkey"), F.col("o_orderstatus"), _value(cents("o_totalprice"), F.col("o_orderpriority")), micros("o_orderdate"))
    return t.select(F.col("o_orderkey").alias("pk"), value.alias("pv"))


def customer_store(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer")
    return t.select(
        F.col("c_custkey").alias("pk"),
        _value(F.col("c_name"), F.col("c_nationkey").cast("bigint"), cents("c_acctbal"), F.col("c_mktsegment")).alias("pv"),
    )


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of puts and deletes: pk user_id, commit_ver event_id; an event of type 'error' is a tombstone."""
    t = table(spark, d, "events")
    value = F.when(F.col("event_type") != "error", _value(F.col("event_type"), cents("value"), F.col("props")))
    return t.select(F.col("user_id").alias("pk"), F.col("event_id").alias("commit_ver"), value.alias("pv"))


def mixed_store(spark: SparkSession, d: str) -> DataFrame:
    """Keys and values of all types: pk_key and pv_key are encoded; tag, ki, ks, kt show the key's parts.

    Regions have integer keys and text values, suppliers bytes and integers, nations texts and integers, events tuples and tuples.
    """
    n = lambda kind: F.lit(None).cast(kind)

    def part(t: DataFrame, tag: int, key: Column, value: Column, ki: Column, ks: Column, kt: Column) -> DataFrame:
        x = t.select(key.alias("k"), value.alias("v"), ki.cast("bigint").alias("ki"), ks.cast("string").alias("ks"), kt.cast("bigint").alias("kt"))
        kinds = {f.name: f.dataType for f in x.schema}
        return x.select(
            key_of(F.col("k"), kinds["k"]).alias("pk_key"),
            key_of(F.col("v"), kinds["v"]).alias("pv_key"),
            F.lit(tag).alias("tag"),
            "ki",
            "ks",
            "kt",
        )

    region, nation, supplier, events = (table(spark, d, t) for t in ("region", "nation", "supplier", "events"))
    return (
        part(region, 1, F.col("r_regionkey").cast("bigint"), F.col("r_name"), F.col("r_regionkey"), n("string"), n("bigint"))
        .unionByName(part(supplier, 2, F.encode("s_name", "UTF-8"), F.col("s_nationkey").cast("bigint"), n("bigint"), F.col("s_name"), n("bigint")))
        .unionByName(part(nation, 3, F.col("n_name"), F.col("n_regionkey").cast("bigint"), n("bigint"), F.col("n_name"), n("bigint")))
        .unionByName(part(events, 4, _value(F.col("user_id"), F.col("event_id")), _value(F.col("event_type"), F.col("props")), F.col("user_id"), n("string"), F.col("event_id")))
    )
