"""Which units of a store hold its data now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.intervals import interval_semi_join, level_of
from tidewell.session import written

INFO = ["commit_ver_lo_incl", "commit_ver_hi_incl", "replacement_num", "data_type"]
COLUMNS = ["store_id", "unit_num", *INFO, "n_entries", "n_bytes"]


def committed_units(units: DataFrame) -> DataFrame:
    """One row for each unit with complete commit info; repeated listings count once, units without info or key not at all.

    Of listings of one unit that differ, the one with the largest (hi, lo, replacement number) is kept, whole.
    """
    rows = units.select(*COLUMNS).dropna(subset=["store_id", "unit_num", *INFO])
    best = F.max(F.struct("commit_ver_hi_incl", "commit_ver_lo_incl", "replacement_num", "data_type", "n_entries", "n_bytes")).alias("u")
    return rows.groupBy("store_id", "unit_num").agg(best).select("store_id", "unit_num", *[F.col(f"u.{c}").alias(c) for c in COLUMNS[2:]])


def live_units(units: DataFrame) -> DataFrame:
    """The committed units that no committed unit of the store with a larger replacement number overlaps.

    Only units above the smallest replacement number can replace others; these few are what every unit is held against, through
    the interval grid. The result is a table in the shared folder, as its users read it more than once. A unit with an empty interval (lo > hi) overlaps nothing and is live.
    """
    units = written(committed_units(units), "committed")
    lo, hi = F.col("commit_ver_lo_incl"), F.col("commit_ver_hi_incl")
    least, levels = units.agg(F.min("replacement_num"), F.collect_set(level_of(lo, hi))).first()
    side = units.select("store_id", "unit_num", lo.alias("lo"), hi.alias("hi"), F.col("replacement_num").alias("rep"))
    above = side.filter(F.col("rep") > (least if least is not None else 0))
    dead = interval_semi_join(side, above, ["store_id"], ["store_id", "unit_num"], condition=lambda a, b: b("rep") > a("rep"), levels=sorted(levels))
    return written(units.join(dead, ["store_id", "unit_num"], "left_anti"), "live")
