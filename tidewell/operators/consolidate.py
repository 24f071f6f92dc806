"""Many small units to few well-sized files (problem 3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.intervals import running
from tidewell.operators.live_units import live_units
from tidewell.session import shared_dir

#: Content bytes (as the listing gives them) of an output file. Parquet stores them in less.
TARGET_BYTES = 128 << 20
SMALL_BYTES = 4096
#: Write tasks at most; a task writes its files one after the other.
MAX_TASKS = 20_000

FIELDS = ["seq", "pk_key", "pk_type", "pk", "datum_type", "pv"]


@dataclass
class Consolidated:
    """What was written, read back.

    entries: each entry of the live units once, with out_num, part and ``copies`` (how often it was delivered); files: one row for each
    file; ranges: one for each output; lineage: one for each live unit, with the rows that were delivered and those that came out.
    """

    entries: DataFrame
    files: DataFrame
    ranges: DataFrame
    lineage: DataFrame


def plan_outputs(units: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Each live unit with the output it goes to: (store_id, out_num) rolls over after every target_bytes, and ``part`` within it.

    Units are taken by version (lo, then number). The running size is a two-step scan over the units that start at one
    version, so a store with most units is no single task. A unit of unknown size counts as 0 bytes. Outputs of a store hold disjoint
    runs of the version order. Units that start at one version share an output; where that makes it larger than the target, it rolls over
    into further parts (files) by unit. A unit of at least target_bytes is well-sized as it is: ``kept`` is set, and it stays where it is.
    """
    u = live_units(units)
    size = F.coalesce("n_bytes", F.lit(0))
    at = u.groupBy("store_id", "commit_ver_lo_incl").agg(F.sum(size).alias("_bytes"))
    at = running(at, ["store_id"], "commit_ver_lo_incl", F.col("_bytes"), "sum", "_before").select("store_id", "commit_ver_lo_incl", "_before")
    placed = u.join(at, ["store_id", "commit_ver_lo_incl"]).withColumn("out_num", F.expr(f"_before div {target_bytes}")).drop("_before")
    # Units of one output: their bytes are bounded by the target and those of its last version.
    inside = Window.partitionBy("store_id", "out_num").orderBy("commit_ver_lo_incl", "unit_num").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_sum", F.sum(size).over(inside)).withColumn("part", F.expr(f"coalesce(_sum, 0) div {target_bytes}")).drop("_sum")
    return placed.withColumn("kept", size >= target_bytes)


def _fold_repeats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with equal content (null equals null) as one, with their number; by hash aggregation, within the partitions there are."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))


def consolidate(units: DataFrame, entries: DataFrame, target_bytes: int = TARGET_BYTES, path: str | None = None) -> Consolidated:
    """Merges the live units' runs into files of about ``target_bytes``, written below ``path`` (the shared folder by default).

    A unit's entries, in order of seq, are a run; each file is a range of the versions and merges the runs of its units into one sorted by
    version, unit and seq. All runs of a file go to one task, and there is a task for each target_bytes. There, repeats of one entry (the
    same in store, unit, seq and all content: a re-delivery) are folded into one row with their number, ``copies``; different entries all stay,
    also under one seq or a null one. The merge is Spark's external sorter: for an order of several columns it is a natural merge sort,
    which finds the runs as they arrive and merges them, spills sorted runs beyond its memory, and merges these by a queue.

    Written are ``plan`` (unit to file), ``entries`` (one Parquet file below store_id=/out_num=/part=) and ``ranges`` (each file's name,
    bytes, versions, keys and counts, for pruning), all before this returns. Entries without a live unit come out nowhere. Live units
    without entries appear in the lineage only. Kept units (see ``plan_outputs``) are not copied: their entries are read where they are.
    """
    spark = entries.sparkSession
    path = path or shared_dir(spark, "consolidated")
    plan_outputs(units, target_bytes).write.parquet(f"{path}/plan")
    plan = spark.read.parquet(f"{path}/plan")
    size, large = plan.agg(F.sum("n_bytes"), F.max("kept")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, -(-int(size or 0) // target_bytes)))
    place = ["store_id", "out_num", "part", "unit_num", "commit_ver_lo_incl"]
    # One way of joining at every size: units and entries grow together.
    source = entries.select("store_id", "unit_num", *FIELDS).join(plan.select(*place, "kept").hint("merge"), ["store_id", "unit_num"])
    runs = source.filter("NOT kept").repartition(tasks, *place[:3])
    merged = _fold_repeats(runs, [*place, *FIELDS]).sortWithinPartitions(*place[:3], "commit_ver_lo_incl", "unit_num", "seq")  # begins as the write's own order, which so adds no sort
    merged.write.partitionBy(*place[:3]).parquet(f"{path}/entries")
    kinds = {f.name: f.dataType for f in merged.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in [*place[3:], *FIELDS, "copies", *place[:3]]])
    written = spark.read.schema(schema).parquet(f"{path}/entries")
    content = F.coalesce(F.octet_length("pk_key"), F.lit(0)) + F.coalesce(F.octet_length("pv"), F.lit(0))
    by_file = written.select(
        *place[:3],
        "unit_num",
        "pk_key",
        content.alias("_content"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_bytes"),
    )
    held = by_file.groupBy(*place[:3], "file", "file_bytes").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.sum("_content").alias("content_bytes"),
        F.min("pk_key").alias("lo_key"),
        F.max("pk_key").alias("hi_key"),
    )
    given = by_file.select(*place[:3], "unit_num").distinct().join(plan, [*place[:3], "unit_num"])
    spans = given.groupBy(*place[:3]).agg(
        F.min("commit_ver_lo_incl").alias("commit_ver_lo_incl"),
        F.max("commit_ver_hi_incl").alias("commit_ver_hi_incl"),
        F.count(F.lit(1)).alias("n_units"),
    )
    held.join(spans, place[:3]).write.parquet(f"{path}/ranges")
    files = spark.read.parquet(f"{path}/ranges")
    everything = written.unionByName(_fold_repeats(source.filter("kept"), [*place, *FIELDS]).select(*schema.names)) if large else written
    sent = entries.groupBy("store_id", "unit_num").agg(F.count(F.lit(1)).alias("rows_in"))
    came = everything.groupBy("store_id", "out_num", "unit_num").agg(F.count(F.lit(1)).alias("entries_out"), F.sum("copies").alias("rows_out"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    lineage = plan.join(sent, ["store_id", "unit_num"], "left").join(came, ["store_id", "out_num", "unit_num"], "left").select(
        *plan.columns,
        count("rows_in"),
        count("entries_out"),
        count("rows_out"),
    )
    ranges = lineage.groupBy("store_id", "out_num").agg(
        F.min("commit_ver_lo_incl").alias("commit_ver_lo_incl"),
        F.max("commit_ver_hi_incl").alias("commit_ver_hi_incl"),
        (F.max("replacement_num") + 1).alias("replacement_num"),
        F.count(F.lit(1)).alias("n_units"),
        F.sum("entries_out").alias("n_entries"),
    )
    return Consolidated(everything, files, ranges, lineage)


def small_inputs(done: Consolidated, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """The live units below ``small_bytes`` that came out whole: all rows delivered for them are accounted for in what was written.

    A unit without any entry is whole with none. A unit of unknown size is no small one.
    """
    whole = done.lineage.filter(F.col("rows_in") == F.col("rows_out"))
    return whole.filter(F.col("n_bytes") < small_bytes).select("store_id", "unit_num")
