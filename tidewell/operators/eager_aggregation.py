"""Per-key results of a join in which a few keys hold most rows: aggregation before the join (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import fresh


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    group: list[str],
    left_sums: dict[str, str] | None = None,
    right_sums: dict[str, str] | None = None,
    outer: bool = False,
) -> DataFrame:
    """Per-group figures of ``left LEFT JOIN right`` on ``on``, without ever joining rows.

    Method: both inputs are first aggregated by the join key (the left one also by the group columns, which are its own), with
    partial aggregation before each shuffle; the compact states are joined; counts are multiplied and sums combined
    algebraically (a left sum times the right count, a right sum times the left count); then all is rolled up by ``group``.
    A hot key is one state per map task and join key, so no task gets its rows.

    Result: the group columns, ``left_rows`` (rows of left, as delivered), ``joined_rows`` (rows of the inner join), with ``outer`` also
    ``outer_rows`` (rows of the left outer join: the joined ones, and those of left that join nothing), and for each ``{name: column}`` of left_sums and right_sums the sum over the inner join's rows.

    Nulls: a null group value is a group of its own; a null join key joins nothing but still counts in left_rows; null summands
    are skipped (a sum without any summand is null). Repeated rows count as often as they come. Empty tables give no rows; an
    empty right side gives joined_rows 0. Columns not named are not read, so clashing names do no harm.
    """
    left_sums, right_sums = left_sums or {}, right_sums or {}
    n_l, n_r = fresh([*left.columns, *right.columns, *left_sums, *right_sums], "n_left", "n_right")
    g = [f"_g{i}" for i in range(len(group))]
    k = [f"_k{i}" for i in range(len(on))]
    ls = left.select(
        *[F.col(c).alias(a) for c, a in zip(group, g)],
        *[F.col(c).alias(a) for c, a in zip(on, k)],
        *[F.col(c).alias(f"_l_{n}") for n, c in left_sums.items()],
    )
    rs = right.select(*[F.col(c).alias(a) for c, a in zip(on, k)], *[F.col(c).alias(f"_r_{n}") for n, c in right_sums.items()]).dropna(subset=k)
    ls = ls.groupBy(*g, *k).agg(F.count(F.lit(1)).alias(n_l), *[F.sum(f"_l_{n}").alias(f"_l_{n}") for n in left_sums])
    rs = rs.groupBy(*k).agg(F.count(F.lit(1)).alias(n_r), *[F.sum(f"_r_{n}").alias(f"_r_{n}") for n in right_sums])
    states = ls.join(rs, k, "left")
    rolled = states.groupBy(*g).agg(
        F.sum(n_l).alias("left_rows"),
        F.sum(F.col(n_l) * F.coalesce(F.col(n_r), F.lit(0))).alias("joined_rows"),
        F.sum(F.when(F.col(n_r).isNull(), F.col(n_l)).otherwise(F.col(n_l) * F.col(n_r))).alias("outer_rows"),
        *[F.sum(F.col(f"_l_{n}") * F.col(n_r)).alias(n) for n in left_sums],
        *[F.sum(F.col(f"_r_{n}") * F.col(n_l)).alias(n) for n in right_sums],
    )
    return rolled.select(
        *[F.col(a).alias(c) for c, a in zip(group, g)],
        "left_rows",
        "joined_rows",
        *(["outer_rows"] if outer else []),
        *left_sums,
        *right_sums,
    )


def heavy_groups(figures: DataFrame, group: list[str], share: float, rows: str = "left_rows") -> DataFrame:
    """The groups of ``eager_join_aggregate`` with at least ``share`` of all rows, counted by the figure ``rows``. No rows, no groups.

    The total is summed from the groups' figures and joined back as one row. The share is compared in whole numbers.
    """
    total = figures.agg(F.sum(rows).alias("_total"))
    millionths = round(share * 1_000_000)
    both = figures.select(*group, rows).join(F.broadcast(total))  # one row: the size is fixed
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    return both.filter(exact(rows) * F.lit(1_000_000) >= exact("_total") * F.lit(millionths)).select(*group, rows)
