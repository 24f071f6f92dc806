"""Reads over entry tables: newest wins, snapshots, ranges by key or sub-value, index rows and their upkeep.

An entry log has the key columns, a value ``pv`` (null is a tombstone) and an order (``commit_ver``, and ``seq`` where versions repeat). Filters
on the key may go below the newest-wins step, and Catalyst pushes them into the scan; filters on values stay above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import datum as D
from tidewell.functions.keys import between, key_of, literal_key
from tidewell.session import written
from tidewell.spec import SubValueSpec


class NoIndex(LookupError):
    def __init__(self, spec: SubValueSpec):
        super().__init__(f"Secondary index does not exist for {spec}")


def newest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, tombstones included. Aggregated with map-side combine, so a hot key is one row per task.

    The order must be total on a key's rows; of full ties one row wins by its other columns. Null keys are a key.
    """
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return log.groupBy(*keys).agg(last).select(*[F.col(k) if k in keys else F.col(f"_last.{k}").alias(k) for k in log.columns])


def current(log: DataFrame, keys: list[str], order: list[str], value: str = "pv") -> DataFrame:
    """The live entries: newest wins, then tombstones go."""
    return newest(log, keys, order).filter(F.col(value).isNotNull())


def snapshot(log: DataFrame, version: int, column: str = "commit_ver") -> DataFrame:
    return log.filter(F.col(column) <= version)


def staged_over(log: DataFrame, staged: DataFrame, order: list[str]) -> DataFrame:
    """A transaction's view: its staged rows, with their own order, after everything committed."""
    top = [F.lit(2**63 - 1).alias(order[0])]
    mine = staged.select(*[c for c in staged.columns if c != order[0]], *top)
    return log.unionByName(mine, allowMissingColumns=True)


def pk_range(entries: DataFrame, lo: D.Datum | None, hi: D.Datum | None, pk: str = "pk") -> DataFrame:
    """Entries with lo <= pk <= hi, both optional and inclusive, ascending.

    A bound of the column's own type is compared natively; a bound of another type is above or below all keys at once.
    """
    return _ranged(entries, F.col(pk), entries.schema[pk].dataType, lo, hi).orderBy(pk)


def _ranged(entries: DataFrame, column: Column, kind: T.DataType, lo: D.Datum | None, hi: D.Datum | None) -> DataFrame:
    own = {T.LongType: D.I64, T.BinaryType: D.BYTES, T.StringType: D.STR}.get(type(kind), D.TUPLE)
    out = entries.filter(column.isNotNull())
    for bound, low in ((lo, True), (hi, False)):
        if bound is None:
            continue
        tag = D.type_of(bound)
        if tag != own:
            if (tag > own) == low:
                return out.filter(F.lit(False))
        elif own == D.TUPLE:
            first, head = kind.fields[0] if kind.fields else None, bound[0] if bound else None
            if head is not None and isinstance(
                first.dataType,
                {D.I64: T.LongType, D.STR: T.StringType, D.BYTES: T.BinaryType}.get(D.type_of(head), ()),
            ):
                plain = column.getField(first.name)  # a plain comparison, which every row that counts passes, before the key is made
                out = out.filter(plain >= F.lit(head) if low else plain <= F.lit(head))
            key = key_of(column, kind)
            out = out.filter(key >= literal_key(bound) if low else key <= literal_key(bound))
        else:
            out = out.filter(column >= F.lit(bound) if low else column <= F.lit(bound))
    return out


def key_range(entries: DataFrame, lo: D.Datum | None, hi: D.Datum | None, key: str = "pk_key") -> DataFrame:
    """As ``pk_range`` over encoded keys, for stores whose keys have several types; byte order is the order of datums."""
    return entries.filter(between(F.col(key), lo, hi)).orderBy(key)


def sv_range(
    entries: DataFrame,
    spec: SubValueSpec,
    lo: D.Datum | None,
    hi: D.Datum | None,
    indexes: set[SubValueSpec],
    pk: str = "pk",
    value: str = "pv",
) -> DataFrame:
    """Live entries whose sub-value lies in the range, with the whole value and ``sv``, ascending by (sv, pk).

    NoIndex if the spec is not among the defined indexes. Entries without such a sub-value are not in it.
    """
    if spec not in indexes:
        raise NoIndex(spec)
    found = spec.resolve(F.col(value), entries.schema[value].dataType)
    if found is None:
        return entries.withColumn("sv", F.lit(None).cast("bigint")).filter(F.lit(False))
    column, kind = found
    out = _ranged(entries, column, kind, lo, hi).withColumn("sv", column)
    return out.orderBy("sv", pk)


def index_rows(entries: DataFrame, spec: SubValueSpec, value: str = "pv") -> DataFrame:
    """The rows of an index: the entries that have the sub-value, with ``sv``."""
    found = spec.resolve(F.col(value), entries.schema[value].dataType)
    if found is None:
        return entries.withColumn("sv", F.lit(None).cast("bigint")).filter(F.lit(False))
    return entries.withColumn("sv", found[0]).filter(F.col("sv").isNotNull())


def previous(log: DataFrame, keys: list[str], order: list[str], state: Column, name: str, block_bits: int = 12) -> DataFrame:
    """Adds ``name``: the state (a struct) of the row before, in the order of the key's history; null at its start.

    The history is cut into blocks of 2**block_bits values of the (integer) first order column. Within a block a window looks back; the
    first row of a block gets the last state of the block before, from one row a block. A key with most rows is many tasks.
    """
    from pyspark.sql import Window

    first = order[0]
    base = log.withColumn("_b", F.expr(f"shiftright(cast(`{first}` as bigint), {block_bits})")).withColumn("_state", F.struct(state.alias("s")))
    last = base.groupBy(*keys, "_b").agg(F.max_by("_state", F.struct(*order)).alias("_last"))
    carry = last.select(*keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carry"))
    inner = base.withColumn("_prev", F.lag("_state").over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    same = reduce(lambda x, y: x & y, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (*keys, "_b")])
    joined = inner.alias("x").join(carry.alias("y"), same, "left")
    return joined.select(*[F.col(f"x.{c}").alias(c) for c in log.columns], F.coalesce("x._prev", "y._carry")["s"].alias(name))


def index_delta(log: DataFrame, keys: list[str], order: list[str], sv: str = "sv", value: str = "pv") -> DataFrame:
    """What each change of a log does to an index: (sv, keys, order, pv) with a null pv for a removed row.

    ``sv`` is the row's sub-value, null where there is none (tombstones included). Old and new sub-values that differ give a removal and a
    row; equal ones with another value a row; nothing if both are the same. The order must be total on a key's rows.
    """
    new_sv = F.when(F.col(value).isNotNull(), F.col(sv))
    rows = log.withColumn("_new", new_sv)
    rows = previous(rows, keys, order, F.struct(F.col("_new").alias("sv"), F.when(F.col("_new").isNotNull(), F.col(value)).alias("pv")), "_old")
    old, new = F.col("_old.sv"), F.col("_new")
    drop = F.when(old.isNotNull() & ~old.eqNullSafe(new), F.struct(old.alias("sv"), F.lit(None).cast(log.schema[value].dataType).alias("pv")))
    put = F.when(
        new.isNotNull() & ~(old.eqNullSafe(new) & F.col("_old.pv").eqNullSafe(F.col(value))),
        F.struct(new.alias("sv"), F.col(value).alias("pv")),
    )
    out = rows.withColumn("_d", F.explode(F.filter(F.array(drop, put), lambda x: x.isNotNull())))
    return out.select(F.col("_d.sv").alias("sv"), *keys, *order, F.col("_d.pv").alias("pv"))


def place(entries: DataFrame, key: str, name: str) -> DataFrame:
    """Adds each row's place (from 1) in the order of a unique key: ranges are counted, and rows only numbered within their range."""
    from pyspark.sql import Window

    ranged = written(entries.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row for each task
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.withColumn("_w", within).join(before, "_range").select(
        *entries.columns,
        (F.col("_w") + F.col("_before")).cast("bigint").alias(name),
    )


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def compact(log: DataFrame, keys: list[str], order: list[str], reaches_oldest: bool, value: str = "pv") -> DataFrame:
    """One row for each key. Tombstones may go only if the input reaches back to the oldest unit; else they still hide older rows."""
    out = newest(log, keys, order)
    return out.filter(F.col(value).isNotNull()) if reaches_oldest else out
