"""Joins and merges over closed integer intervals, without nested loops and without windows over a whole hot key.

An interval is put on a grid of cells whose width grows by 256 from level to level: it belongs to the lowest level whose cells
are at least as long as itself, so it touches at most two cells there. Two intervals that overlap share a cell at the level of
the longer one. Each side therefore writes few rows whatever the lengths are, and a cell of a level holds few intervals of
that level unless many lie on the same spot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_BITS, STEP_BITS, TOP = 6, 8, 7
#: The bounds of what is taken for all versions; half the longs, so that one more or less is still a long.
LEAST, GREATEST = -(2**62), 2**62


def level_of(lo: Column, hi: Column) -> Column:
    """The grid level of [lo, hi]; intervals too long for a subtraction of longs get the top one."""
    bits = F.coalesce(F.length(F.bin(F.try_subtract(hi.cast("long"), lo.cast("long")))), F.lit(64))  # small code, as it is inlined in many places
    steps = F.shiftright(F.greatest(bits - BASE_BITS, F.lit(0)) + (STEP_BITS - 1), STEP_BITS.bit_length() - 1)
    return F.least(steps, F.lit(TOP))


def _cells(df: DataFrame, lo: str, hi: str, levels: Column, role: int, first_only: bool = False) -> DataFrame:
    """One row for each cell that [lo, hi] touches on each of the given levels."""
    out = df.withColumn("_g_level", F.explode(levels))
    start, stop = F.expr(
        f"shiftright(cast(`{lo}` as bigint), _g_level * {STEP_BITS} + {BASE_BITS})"
    ), F.expr(f"shiftright(cast(`{hi}` as bigint), _g_level * {STEP_BITS} + {BASE_BITS})")
    cells = F.array(start) if first_only else F.when(start == stop, F.array(start)).otherwise(F.sequence(start, stop))
    return out.withColumn("_g_cell", F.explode(cells)).withColumn("_g_role", F.lit(role))


def _levels(*sides: DataFrame) -> list[list[int]]:
    """The levels in use on each side, in one job: at most 8 numbers a side, whatever the data are."""
    seen = [d.select(F.lit(i).alias("side"), level_of(F.col("lo"), F.col("hi")).alias("l")) for i, d in enumerate(sides)]
    found = reduce(DataFrame.unionAll, seen).distinct().collect()
    return [sorted(r.l for r in found if r.side == i) for i in range(len(sides))]


def _matched(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    relation: str,
    condition,
    salts: int,
    levels: list[int] | None,
    how: str,
) -> DataFrame:
    """The rows ``_l`` and, unless ``how`` is a semi join, ``_r`` of related intervals; a pair may come more than once only in a semi join."""
    ok = lambda d: d.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "lo", "hi")]) & (F.col("lo") <= F.col("hi")))
    ls = ok(left).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.struct(*left.columns).alias("_l"),
        F.col("lo").alias("_lo"),
        F.col("hi").alias("_hi"),
    )
    rs = ok(right).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.struct(*right.columns).alias("_r"),
        F.col("lo").alias("_rlo"),
        F.col("hi").alias("_rhi"),
    )
    ls, rs = ls.withColumn("_own", level_of(F.col("_lo"), F.col("_hi"))), rs.withColumn("_own", level_of(F.col("_rlo"), F.col("_rhi")))
    l_levels, r_levels = (levels, levels) if levels is not None else _levels(ok(left), ok(right))
    at = lambda levels: F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast(T.ArrayType(T.IntegerType()))
    # Role 0: the right interval is at least as long; the left one looks it up on each level from its own on.
    lc = _cells(ls, "_lo", "_hi", F.filter(at(r_levels), lambda x: x >= F.col("_own")), 0, first_only=relation == "inside")
    rc = _cells(rs, "_rlo", "_rhi", F.array("_own"), 0)
    if relation == "overlaps":  # Role 1: the left interval is on a higher level.
        lc = lc.unionByName(_cells(ls.filter(F.col("_own") > 0), "_lo", "_hi", F.array("_own"), 1))
        rc = rc.unionByName(_cells(rs, "_rlo", "_rhi", F.filter(at(l_levels), lambda x: x > F.col("_own")), 1))
    # Of role 0 the left side is the large one and gets a random salt; of role 1 the right side.
    salt = F.pmod(F.xxhash64("_l"), F.lit(salts)).cast("int")
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    lc = lc.withColumn(
        "_g_salt",
        F.explode(
            F.when((F.col("_g_role") == 0) & (F.col("_g_level") > 0), F.array(salt)).when(F.col("_g_role") == 0, F.array(F.lit(0))).otherwise(all_salts)
        ),
    )
    r_salt = F.pmod(F.xxhash64("_r"), F.lit(salts)).cast("int")
    rc = rc.withColumn(
        "_g_salt",
        F.explode(
            F.when((F.col("_g_role") == 0) & (F.col("_g_level") > 0), all_salts).when(F.col("_g_role") == 0, F.array(F.lit(0))).otherwise(F.array(r_salt))
        ),
    )
    on = [*[f"_k{i}" for i in range(len(keys))], "_g_role", "_g_level", "_g_cell", "_g_salt"]
    a, b = lc.alias("a"), rc.alias("b")
    test = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on])
    if relation == "inside":
        test &= (F.col("b._rlo") <= F.col("a._lo")) & (F.col("a._hi") <= F.col("b._rhi"))
    else:
        test &= (F.col("b._rlo") <= F.col("a._hi")) & (F.col("a._lo") <= F.col("b._rhi"))
        if how == "inner":  # two intervals may share two cells: they meet where the later one begins
            width = F.expr(f"a._g_level * {STEP_BITS} + {BASE_BITS}")
            test &= F.call_function("shiftright", F.greatest("a._lo", "b._rlo").cast("long"), width) == F.col("a._g_cell")
    if condition is not None:
        test &= condition(lambda c: F.col(f"a._l.{c}"), lambda c: F.col(f"b._r.{c}"))
    return a.join(b, test, how)


def interval_semi_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: list[str],
    relation: str = "overlaps",
    condition=None,
    salts: int = 8,
    levels: list[int] | None = None,
) -> DataFrame:
    """Distinct ``left_id`` of the rows of left for which some row of right has the same keys and a related interval.

    Both sides need the columns ``lo`` and ``hi`` (closed, integers) beside the keys. ``relation`` is ``overlaps`` or ``inside``
    (the left interval lies wholly in one right interval). ``condition(l, r)`` may add a predicate over both rows; it gets
    functions from a column name to a column. Rows with a null key or bound and empty intervals (lo > hi) match nothing; an
    empty side gives an empty result. Extra columns are carried only if the condition uses them, so they may clash.

    ``levels``: the grid levels in use on either side, if known; else each side is read once more to find them (8 at most).

    A hot key is spread over its cells; cells of higher levels, which hold all of a key, are also spread over salts.
    """
    return _matched(
        left,
        right,
        keys,
        relation,
        condition,
        salts,
        levels,
        "left_semi",
    ).select(*[F.col(f"_l.{c}").alias(c) for c in left_id]).distinct()


def overlap_lengths(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    group: list[str],
    name: str,
    right_group: list[str] | None = None,
    salts: int = 8,
    levels: list[int] | None = None,
) -> DataFrame:
    """(group, right_group, name): how many integers of the left rows' intervals lie in right intervals of the same keys.

    Right intervals of one right_group may not overlap, or what they share counts for each. Pairs that meet are folded where they meet
    (partial sums), and only groups that meet anything have a row. Nulls and empty intervals as in ``interval_semi_join``.
    """
    met = _matched(left, right, keys, "overlaps", None, salts, levels, "inner")
    shared = (F.least("_hi", "_rhi") - F.greatest("_lo", "_rlo") + 1).alias("_shared")
    met = met.select(*[F.col(f"_l.{c}").alias(c) for c in group], *[F.col(f"_r.{c}").alias(c) for c in right_group or []], shared)
    return met.groupBy(*group, *(right_group or [])).agg(F.sum("_shared").alias(name))


def running(df: DataFrame, keys: list[str], order: str, value: Column, how: str, name: str, block_bits: int = 12) -> DataFrame:
    """Adds ``name``: the max or sum of ``value`` over all earlier rows of the same keys, in the order of the integer ``order``.

    ``(keys, order)`` must be unique. The scan runs in two steps, within blocks of 2**block_bits order values and over the blocks'
    totals, so that no task gets the whole of a hot key. The first row of a key has null for max and 0 for sum.
    """
    from pyspark.sql import Window

    fold = {"max": F.max, "sum": F.sum}[how]
    base = df.withColumn("_s_block", F.expr(f"shiftright(cast(`{order}` as bigint), {block_bits})")).withColumn("_s_value", value)
    before = Window.partitionBy(*keys, "_s_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy(*keys, "_s_block").agg(fold("_s_value").alias("_s_total"))
    totals = totals.withColumn(
        "_s_carry",
        fold("_s_total").over(Window.partitionBy(*keys).orderBy("_s_block").rowsBetween(Window.unboundedPreceding, -1)),
    ).drop("_s_total")
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (*keys, "_s_block")]
    inner = base.withColumn("_s_in", fold("_s_value").over(before))
    joined = inner.alias("x").join(totals.alias("y"), reduce(lambda a, b: a & b, same), "left")
    both = F.greatest(F.col("x._s_in"), F.col("y._s_carry")) if how == "max" else F.coalesce(F.col("x._s_in"), F.lit(0)) + F.coalesce(F.col("y._s_carry"), F.lit(0))
    return joined.select(*[F.col(f"x.{c}").alias(c) for c in df.columns], both.alias(name))


def merge_intervals(df: DataFrame, keys: list[str], gap: int = 0, block_bits: int = 12) -> DataFrame:
    """The unions (keys, lo, hi) of touching or overlapping intervals.

    With ``gap`` 0 only intervals with a common point are merged ([10,20] and [21,29] stay apart); with 1 adjacent integers
    are. Rows with a null bound or lo > hi are left out. A null key is a key of its own; repeats change nothing.

    Intervals are first merged into islands within blocks of 2**block_bits values of lo, many tasks to a hot key. One row a
    block, its highest end and the start of its last island, then tells each block how far the earlier ones reach and which
    union reaches there: an island is new if it begins beyond that, and else part of that union. One scan carries both.
    """
    from pyspark.sql import Window

    end_before, start_before = "_m_reach", "_m_open"
    block = [*keys, "_m_block"]
    rows = df.filter("lo <= hi").select(*keys, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    rows = rows.withColumn("_m_block", F.expr(f"shiftright(lo, {block_bits})"))
    ordered = Window.partitionBy(*block).orderBy("lo", "hi")
    seen = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_m_new", (seen.isNull() | (F.col("lo") > seen + gap)).cast("int"))
    rows = rows.withColumn("_m_island", F.sum("_m_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(*block, "_m_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ends = islands.groupBy(*block).agg(F.max("hi").alias("_m_end"), F.max("lo").alias("_m_last"))
    earlier = Window.partitionBy(*keys).orderBy("_m_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn(end_before, F.max("_m_end").over(earlier))
    opened = F.when(F.col(end_before).isNull() | (F.col("_m_last") > F.col(end_before) + gap), F.col("_m_last"))
    ends = ends.withColumn("_m_opened", opened).withColumn(start_before, F.max("_m_opened").over(earlier))
    same = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in block])  # no isnotnull on one side: the islands' exchange is reused
    named = islands.alias("x").join(ends.select(*block, end_before, start_before).alias("y"), same)
    fresh = F.col(end_before).isNull() | (F.col("x.lo") > F.col(end_before) + gap)
    named = named.select(
        *[F.col(f"x.{k}").alias(k) for k in keys],
        F.col("x.hi").alias("hi"),
        F.when(fresh, F.col("x.lo")).otherwise(F.col(start_before)).alias("_m_id"),
    )
    return named.groupBy(*keys, "_m_id").agg(F.max("hi").alias("hi")).select(*keys, F.col("_m_id").alias("lo"), "hi")


def gaps_between(df: DataFrame, keys: list[str], all_keys: DataFrame, block_bits: int = 12) -> DataFrame:
    """The intervals (keys, lo, hi) of all longs that no interval of a key covers; a key of ``all_keys`` without any has one, of everything.

    A null key is a key of its own. "All longs" are those from LEAST to GREATEST.
    """
    from pyspark.sql import Window

    # One row before all intervals of a key: it ends where the longs begin, so that the first gap is found like the others.
    merged = merge_intervals(df, keys, 1, block_bits).withColumn("_g_block", F.expr(f"shiftright(lo, {block_bits})"))
    head = all_keys.select(*keys).distinct().select(
        *keys,
        F.lit(None).cast("long").alias("lo"),
        F.lit(None).cast("long").alias("hi"),
        F.lit(None).cast("long").alias("_g_block"),
    )
    rows = merged.unionByName(head)
    # The start after a row: the next one of its block, or the first of the next block.
    within = Window.partitionBy(*keys, "_g_block").orderBy("lo")
    firsts = rows.groupBy(*keys, "_g_block").agg(F.min("lo").alias("_g_first"))
    firsts = firsts.withColumn("_g_after", F.lead("_g_first").over(Window.partitionBy(*keys).orderBy(F.col("_g_block").asc_nulls_first())))
    same = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (*keys, "_g_block")])
    joined = rows.withColumn("_g_next", F.lead("lo").over(within)).alias("x").join(firsts.alias("y"), same)
    start = F.when(F.col("x.hi").isNull(), F.lit(LEAST)).otherwise(F.col("x.hi") + 1)
    stop = F.coalesce(F.col("x._g_next"), F.col("y._g_after")) - 1
    found = joined.select(*[F.col(f"x.{k}").alias(k) for k in keys], start.alias("lo"), F.coalesce(stop, F.lit(GREATEST)).alias("hi"))
    return found.filter("lo <= hi")
