"""A feed of puts and deletes, out of order and with repeats, to the current state (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.live_units import live_units
from tidewell.session import written

TOMBSTONE = 0


def compose_patches(changes: DataFrame, keys: list[str], order: list[str], effect: list[str]) -> DataFrame:
    """One patch for each key: the composition of all its changes.

    A change is a function on the state of its key: a put is the constant function of its value, a delete the constant
    function to nothing. Composing two gives the one that is later in ``order``; this is associative and, as the order is part of
    the patch, also commutative and idempotent. So the changes can be folded in any tree: each map task folds what it has
    (partial aggregation), also of a hot key, and only one patch a key and task is shuffled. Repeats and late ones fold away.

    The order columns must be total on the changes of a key; of equal ones the larger effect (column by column) wins. Nulls in order
    columns sort first. Key columns may be null. The result has the keys, the order and the effect columns.
    """
    patch = F.max(
        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"e{i}") for i, c in enumerate(effect)])
    ).alias("_patch")
    folded = changes.groupBy(*keys).agg(patch)
    plain = [c for c in effect if c not in order]
    return folded.select(
        *keys,
        *[F.col(f"_patch.o{i}").alias(c) for i, c in enumerate(order)],
        *[F.col(f"_patch.e{effect.index(c)}").alias(c) for c in plain],
    )


def apply_patches(base: DataFrame, patches: DataFrame, keys: list[str], is_delete) -> DataFrame:
    """The base after the patches: untouched rows stay, patched keys get the patch's row, deleted keys go.

    Both need the same columns. ``is_delete`` is a boolean column over a patch's row. Neither side may repeat a key (compose first).
    """
    test = F.lit(True)
    for k in keys:
        test &= F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}"))
    untouched = base.alias("b").join(patches.select(*keys).alias("p"), test, "left_anti")
    return untouched.unionByName(patches.filter(~F.coalesce(is_delete, F.lit(False))).select(*base.columns))


KEYS = ["store_id", "pk_type", "pk"]
#: Versions of a range chunk: a hot key's changes are composed in as many tasks as it has chunks.
CHUNK_BITS = 10


def split_at_cut(units: DataFrame) -> DataFrame:
    """The live units as (store_id, unit_num, ver, after): ``after`` tells those above the middle of their store's versions.

    The units up to there make the base, those after it the changes that are applied to it. Where the cut lies changes no result.
    """
    live = units.select("store_id", "unit_num", F.col("commit_ver_hi_incl").alias("ver"))
    middle = live.groupBy("store_id").agg(F.expr("min(ver) + (max(ver) - min(ver)) div 2").alias("_cut"))
    return live.join(middle, "store_id").select("store_id", "unit_num", "ver", (F.col("ver") > F.col("_cut")).alias("after"))


def unit_patches(entries: DataFrame, units: DataFrame, values: bool = False) -> DataFrame:
    """The composed patch of each key of each store, from a feed of unit entries in any order.

    ``units`` is the listing. Entries of other than live units drop out first. A hot key is folded before each shuffle.
    A null datum_type is a put; null keys or seqs take part as nulls.
    """
    live = live_units(units).select("store_id", "unit_num", F.col("commit_ver_hi_incl").alias("ver"))
    return _range_patches(entries, live, values)


def _range_patches(entries: DataFrame, versions: DataFrame, values: bool) -> DataFrame:
    """The composition of the changes in the given units (store_id, unit_num, ver): within range chunks of the versions first, then over these.

    Versions follow one another, so a chunk of them is a range of the order, and a tree over chunks composes in order. A key that
    changes in most versions is spread over its chunks, and each map task folds what it has before it sends anything.
    """
    effect = ["datum_type", "pv"] if values else ["datum_type"]
    order = ["ver", "seq", "unit_num"]
    placed = entries.select("store_id", "unit_num", "pk_type", "pk", "seq", *effect).join(
        versions.select("store_id", "unit_num", "ver").hint("merge"),
        ["store_id", "unit_num"],
    )
    # (joined in one way at every size: units and entries grow together)
    placed = placed.withColumn("_chunk", F.expr(f"shiftright(ver, {CHUNK_BITS})"))
    chunks = compose_patches(placed, [*KEYS, "_chunk"], order, effect)
    return compose_patches(chunks, KEYS, order, effect)


def current_entries(entries: DataFrame, units: DataFrame, base: DataFrame | None = None, values: bool = False) -> DataFrame:
    """The keys that are live at the end, with the change that made them so; ``base`` is the state before, if there is one.

    Without a base, the state at the middle of each store's versions is built first, as a table (the composition of the units up to there, on
    nothing), and the composed changes of the units after it are applied to that.
    """
    deleted = F.col("datum_type") == TOMBSTONE
    if base is not None:
        return apply_patches(base, unit_patches(entries, units, values), KEYS, deleted)
    split = written(split_at_cut(live_units(units)), "split")
    before = _range_patches(entries, split.filter("NOT after"), values)
    base = written(before.filter(~F.coalesce(deleted, F.lit(False))), "base")
    return apply_patches(base, _range_patches(entries, split.filter("after"), values), KEYS, deleted)
