"""Texts into containers of fixed capacity (problem 7): bound-certified repacking.

Documents are spread over partitions by hash and each partition is packed by best-fit decreasing. A lower bound from dual feasible
functions certifies the number of containers of a whole pack. While there is a gap to it, every partition gives the documents of its
emptiest containers into a pool, which is dealt out anew and packed again; a round is kept if it saves containers, and the next one after a
round that does not takes a larger pool.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import written

#: Documents of one partition, about. Bounds the memory of a task; every partition is packed whole.
ITEMS_PER_PART = 10_000
#: Rounds of exchange at most; it ends before where no pack has a gap left. More rounds cost time and may save more containers.
ROUNDS = 4
#: A partition gives the documents of this many of its emptiest containers for each container that is its share of the gap (and once more).
POOL = 64
#: By how much the pool grows after a round without gain.
GROWTH = 8


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """A number of containers below which no packing exists, for ``counts[i]`` items of size ``sizes[i]`` (1 to capacity).

    The largest of the bounds of two families of dual feasible functions: for each threshold t up to half the capacity, sizes above
    capacity - t count as full and sizes below t as nothing; and for k = 1 to 20, sizes rounded to k-ths. All exact, in integers.
    """
    if not len(sizes):
        return 0
    h = np.zeros(capacity + 1, np.int64)
    np.add.at(h, sizes.astype(np.int64), counts.astype(np.int64))
    x = np.arange(capacity + 1, dtype=np.int64)
    number, total = np.cumsum(h), np.cumsum(h * x)
    t = np.arange(0, capacity // 2 + 1)
    upper = capacity - t  # sizes above this count as full
    full = number[-1] - number[upper]
    below = np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    middle = total[upper] - below
    best = int(np.max(full - (-middle // capacity)))
    for k in range(1, 21):
        parts = (k + 1) * x
        exact = parts % capacity == 0
        # u(x) = x where (k+1)x is whole, else floor((k+1)x)/k; in units of 1/(k * capacity)
        u = np.where(exact, x * k, parts // capacity * capacity)
        best = max(best, -int(-(h * u).sum() // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, free room of each container); ties between sizes go by position."""
    order = np.argsort(-sizes, kind="stable")
    into = np.zeros(len(sizes), np.int64)
    free: list[int] = []
    rooms: list[int] = []  # the distinct free rooms, ascending
    stacks: dict[int, list[int]] = {}
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        k = bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms[k]
            stack = stacks[room]
            c = stack.pop()
            if not stack:
                del rooms[k], stacks[room]
        else:
            c, room = len(free), capacity
            free.append(capacity)
        into[i] = c
        rest = room - s
        free[c] = rest
        if rest:
            if rest in stacks:
                stacks[rest].append(c)
            else:
                stacks[rest] = [c]
                insort(rooms, rest)
    return into, np.array(free, np.int64)


@dataclass
class Packed:
    """pieces: (pack_name, container, the key, piece, start_token, n_tokens); bounds: one row for each pack."""

    pieces: DataFrame
    bounds: DataFrame


_PART = "pack_name string, capacity int, rid bigint, size int, container string, free int, place int"


def _pack_part(rows: pd.DataFrame) -> pd.DataFrame:
    """The packing of one partition; ``place`` is the container's, from the emptiest on."""
    rows = rows.sort_values("rid", kind="stable")
    capacity, sizes = int(rows["capacity"].iloc[0]), rows["size"].to_numpy()
    into, free = best_fit_decreasing(sizes, capacity)
    place = np.empty(len(free), np.int32)
    place[np.argsort(-free, kind="stable")] = np.arange(len(free), dtype=np.int32)
    names = np.array([f"{rows['label'].iloc[0]}-{c}" for c in range(len(free))], object)
    return pd.DataFrame(
        {
            "pack_name": rows["pack_name"],
            "capacity": rows["capacity"],
            "rid": rows["rid"],
            "size": sizes,
            "container": names[into],
            "free": free[into],
            "place": place[into],
        }
    )


def _by_pack(values: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, k in values.items():
        out = F.when(F.col("pack_name") == name, F.lit(k)).otherwise(out)
    return out


def _pack(items: DataFrame, parts: dict[str, int], turn: int) -> DataFrame:
    """Items dealt out by hash to as many parts as their pack has, each packed."""
    dealt = items.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(turn)), _by_pack(parts, 1)))
    dealt = dealt.withColumn("label", F.concat_ws("-", F.lit(f"r{turn}"), F.col("part")))
    return written(dealt.groupBy("pack_name", "part").applyInPandas(_pack_part, _PART), "packed")


def _containers(packed: DataFrame) -> dict[str, int]:
    return {r[0]: r[1] for r in packed.groupBy("pack_name").agg(F.count_distinct("container")).collect()}  # one row for each pack


def _exchange(done: DataFrame, bound: dict[str, int], parts: dict[str, int], items_per_part: int, pool_factor: int, rounds: int) -> DataFrame:
    """The packing after the rounds of exchange; see the module."""
    used, factor = _containers(done), dict.fromkeys(bound, pool_factor)
    for turn in range(1, rounds + 1):
        gaps = {p: used[p] - bound[p] for p in used if used[p] > bound[p]}
        if not gaps:
            break
        give = {p: factor[p] * (-(-gap // parts[p]) + 1) for p, gap in gaps.items()}
        pooled = F.col("place") < _by_pack(give, 0)
        pool = done.filter(pooled)
        before = {
            r["pack_name"]: r for r in pool.groupBy("pack_name").agg(
                F.count(F.lit(1)).alias("items"),
                F.count_distinct("container").alias("containers"),
            ).collect()
        }
        again = _pack(pool.select("pack_name", "capacity", "rid", "size"), {p: -(-r["items"] // items_per_part) for p, r in before.items()}, turn)
        saved = {p: before[p]["containers"] - n for p, n in _containers(again).items()}
        for p in gaps:
            if saved.get(p, 0) <= 0:
                factor[p] *= GROWTH
        better = [p for p, n in saved.items() if n > 0]
        if not better:
            continue
        used |= {p: used[p] - saved[p] for p in better}
        mine = F.col("pack_name").isin(*better)
        done = done.filter(~(pooled & mine)).unionByName(again.filter(mine))
    return done


def pack(
    counts: DataFrame,
    capacities: dict[str, int],
    key: str = "doc_id",
    size: str = "n_tokens",
    items_per_part: int = ITEMS_PER_PART,
    pool_factor: int = POOL,
    rounds: int = ROUNDS,
) -> Packed:
    """Every document into containers of each capacity.

    Only a document larger than the capacity is split: into full pieces, which fill containers of their own, and a rest that is packed
    like any document. Every token comes out once per pack. A document without tokens (or of unknown size) has one row without a
    container. Repeated rows are documents of their own; a null key stays null. Ties never split a document.
    ``capacities`` is the (small, fixed) table of packs; only the two named columns of counts are read.
    """
    rows = counts.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "counts")
    packs = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("int").alias("capacity")) for n, c in capacities.items()])
    each = rows.withColumn("p", F.explode(packs)).select("rid", "n", "p.pack_name", "p.capacity")
    items = each.withColumn("size", (F.col("n") % F.col("capacity")).cast("int")).filter("size > 0").select("pack_name", "capacity", "rid", "size")

    def bound_of(part: pd.DataFrame) -> pd.DataFrame:  # one row for each size up to the capacity
        c = int(part["capacity"].iloc[0])
        low = lower_bound(part["size"].to_numpy(), part["items"].to_numpy(), c)
        return pd.DataFrame({"pack_name": [part["pack_name"].iloc[0]], "lower_bound": [low], "items": [part["items"].sum()]})

    sizes = items.groupBy("pack_name", "capacity", "size").agg(F.count(F.lit(1)).alias("items"))
    bounds = written(sizes.groupBy("pack_name").applyInPandas(bound_of, "pack_name string, lower_bound bigint, items bigint"), "bounds")
    known = bounds.collect()  # one row for each pack
    parts = {r["pack_name"]: -(-r["items"] // items_per_part) for r in known}
    done = _exchange(_pack(items, parts, 0), {r["pack_name"]: r["lower_bound"] for r in known}, parts, items_per_part, pool_factor, rounds)
    full = each.filter("n >= capacity").select(
        "rid",
        "pack_name",
        "capacity",
        F.explode(F.sequence(F.lit(0), F.expr("cast(n div capacity as int)") - 1)).alias("piece"),
    )
    full = full.select(
        "rid",
        "pack_name",
        F.concat_ws("-", F.lit("full"), "rid", "piece").alias("container"),
        "piece",
        (F.col("piece").cast("bigint") * F.col("capacity")).alias("start_token"),
        F.col("capacity").alias("n_tokens"),
    )
    none = each.filter("n <= 0").select(
        "rid",
        "pack_name",
        F.lit(None).cast("string").alias("container"),
        F.lit(0).alias("piece"),
        F.lit(0).cast("bigint").alias("start_token"),
        F.lit(0).alias("n_tokens"),
    )
    rest = done.select("rid", "pack_name", "container", "size").join(rows.select("rid", "n"), "rid")
    capacity = F.create_map(*[x for n, c in capacities.items() for x in (F.lit(n), F.lit(c).cast("int"))])[F.col("pack_name")]
    rest = rest.select(
        "rid",
        "pack_name",
        "container",
        F.floor(F.col("n") / capacity).cast("int").alias("piece"),
        (F.col("n") - F.col("size")).alias("start_token"),
        F.col("size").alias("n_tokens"),
    )
    pieces = full.unionByName(rest).unionByName(none).join(rows.select("rid", F.col("k").alias(key)), "rid")
    pieces = pieces.select("pack_name", "container", key, "piece", "start_token", "n_tokens")

    used = done.groupBy("pack_name").agg(F.count_distinct("container").alias("used"))
    filled = each.filter("n >= capacity").groupBy("pack_name").agg(F.sum(F.expr("n div capacity")).alias("full"))
    total = each.groupBy("pack_name", "capacity").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    table = total.join(used, "pack_name", "left").join(filled, "pack_name", "left").join(bounds.drop("items"), "pack_name", "left")
    table = table.select(
        "pack_name",
        "capacity",
        "documents",
        zero("tokens").alias("tokens"),
        (zero("used") + zero("full")).alias("containers"),
        (zero("lower_bound") + zero("full")).alias("lower_bound"),
    )
    return Packed(pieces, table)
