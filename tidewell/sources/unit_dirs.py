"""Unit directories of the entry file format: commit info, entries, and the catalog of indexes.

A store's folder has one folder for each unit, named by its number in 16 hex digits, with ``pi.kv`` (entries), ``si-<index>.kv`` (index rows)
and ``commit_info.txt`` (hi,lo,replacement number,data type). A unit of a dead writer has no or an incomplete commit info.
"""

from __future__ import annotations

import contextlib
import os
import re
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.live_units import live_units
from tidewell.session import spread
from tidewell.sources.kv import KvDataSource, file_system, serialized
from tidewell.spec import SubValueSpec

_UNIT = re.compile("[0-9a-f]{16}")
_NAMES = 10_000


def _unit_numbers(root: str) -> Iterator[int]:
    """The numbers of a folder's units; only file systems that are neither local nor mounted give the whole folder at once."""
    system, top = file_system(root)
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(top) as found:
            yield from (int(f.name, 16) for f in found if _UNIT.fullmatch(f.name))
    else:
        yield from (int(f.base_name, 16) for f in system.get_file_info(pafs.FileSelector(top)) if _UNIT.fullmatch(f.base_name))


def _text(system: pafs.FileSystem, file: str) -> str | None:
    try:
        with system.open_input_stream(file) as stream:
            return stream.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


def list_units(spark: SparkSession, root: str, store_id: int = 0) -> DataFrame:
    """The listing of a folder's units as ``live_units`` takes it; parts of the commit info that are missing or wrong are null.

    One task reads the names in the folder, piece by piece, and all tasks open the units' files; the driver sees neither names nor files.
    The folder is read when the rows are. A unit is listed if it has an entry file.
    """

    def names(_):
        for some in batched(_unit_numbers(root), _NAMES):
            yield pa.RecordBatch.from_pydict({"unit_num": pa.array(some, pa.int64())})

    def infos(batches):
        system, top = file_system(root)
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            entries = system.get_file_info([f"{top}/{u:016x}/pi.kv" for u in numbers])
            found = [(u, f.size) for u, f in zip(numbers, entries) if f.type == pafs.FileType.File]
            texts = [_text(system, f"{top}/{u:016x}/commit_info.txt") for u, _ in found]
            columns = ([u for u, _ in found], pa.int64()), ([n for _, n in found], pa.int64()), (texts, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], ["unit_num", "n_bytes", "info"])

    units = spread(spark.range(0, 1, 1, 1).mapInArrow(names, "unit_num bigint")).mapInArrow(infos, "unit_num bigint, n_bytes bigint, info string")
    part = lambda i: F.get(F.split("info", ","), F.lit(i)).try_cast("bigint")
    return units.select(
        F.lit(store_id).cast("bigint").alias("store_id"),
        "unit_num",
        *[part(i).alias(n) for i, n in enumerate(("commit_ver_hi_incl", "commit_ver_lo_incl", "replacement_num"))],
        part(3).cast("int").alias("data_type"),
        F.lit(None).cast("bigint").alias("n_entries"),
        "n_bytes",
    )


def _live(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(KvDataSource)
    return live_units(list_units(spark, root)).select("unit_num", F.col("commit_ver_hi_incl").alias("commit_ver"))


def _of_unit(rows: DataFrame) -> DataFrame:
    return rows.withColumn("unit_num", F.conv(F.regexp_extract("file", "([0-9a-f]{16})/[^/]+$", 1), 16, 10).cast("bigint"))


def read_units(spark: SparkSession, root: str) -> DataFrame:
    """The log of all live units: pk_key, pv_key (null: tombstone), commit_ver, seq (place in the file). Replaced and unfinished units are left out."""
    units = _live(spark, root)
    rows = _of_unit(spark.read.format("kv").option("pattern", "*/pi.kv").load(root))
    return rows.join(units, "unit_num").select("pk_key", "pv_key", "commit_ver", "seq")


def read_index_units(spark: SparkSession, root: str, index: int) -> DataFrame:
    """The rows of an index in all live units: sv_key, pk_key, pv_key (null: removed), commit_ver, seq."""
    units = _live(spark, root)
    rows = _of_unit(spark.read.format("kv").option("kind", "index").option("pattern", f"*/si-{index:016x}.kv").load(root))
    return rows.join(units, "unit_num").select("sv_key", "pk_key", "pv_key", "commit_ver", "seq")


def write_units(log: DataFrame, units: DataFrame, root: str, indexes: dict[int, DataFrame] | None = None) -> None:
    """Unit directories: ``log`` has unit_num, pk_key, pv_key; ``units`` unit_num and the commit info; ``indexes`` number to (unit_num, sv_key, pk_key, pv_key).

    Each file is sorted by its keys and written by one task, row by row. The commit info comes last, so that a unit that was not finished
    has none. A unit without entries gets no entry file. The work goes by files, so tasks are not merged where their bytes are few.
    """
    system, top = file_system(root)
    system.create_dir(top, recursive=True)
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def put(keys: list[str], name: str, rows: DataFrame) -> None:
        def write(batches):
            open_unit, out, n = None, None, 0
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("unit_num", *keys)]
                for unit, *values in zip(*cols):
                    if unit != open_unit:
                        if out is not None:
                            out.close()
                        system, top = file_system(root)
                        system.create_dir(f"{top}/{unit:016x}", recursive=True)
                        out, open_unit, n = system.open_output_stream(f"{top}/{unit:016x}/{name}"), unit, n + 1
                    out.write(serialized(values))
            if out is not None:
                out.close()
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32())})

        sorted_rows = rows.select("unit_num", *keys).repartition(tasks, "unit_num").sortWithinPartitions("unit_num", *keys)
        sorted_rows.mapInArrow(write, "n int").agg(F.sum("n")).collect()

    put(["pk_key", "pv_key"], "pi.kv", log)
    for number, rows in (indexes or {}).items():
        put(["sv_key", "pk_key", "pv_key"], f"si-{number:016x}.kv", rows)

    def infos(batches):
        system, top = file_system(root)
        for batch in batches:
            for u, *info in zip(*(batch.column(i).to_pylist() for i in range(5))):
                system.create_dir(f"{top}/{u:016x}", recursive=True)
                with system.open_output_stream(f"{top}/{u:016x}/commit_info.txt") as out:
                    out.write(commit_info(*info).encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int32())})

    fields = ["unit_num", "commit_ver_hi_incl", "commit_ver_lo_incl", "replacement_num", "data_type"]
    units.select(*fields).repartition(tasks, "unit_num").mapInArrow(infos, "n int").agg(F.sum("n")).collect()


def remove_units(units: DataFrame, root: str) -> None:
    """Deletes the directories of the units in ``units`` (unit_num) with all they hold."""
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def remove(batches):
        system, top = file_system(root)
        for batch in batches:
            for u in batch.column(0).to_pylist():
                with contextlib.suppress(FileNotFoundError):  # a task that was tried again
                    system.delete_dir(f"{top}/{u:016x}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int32())})

    units.select("unit_num").repartition(tasks, "unit_num").mapInArrow(remove, "n int").agg(F.sum("n")).collect()


def commit_info(hi: int, lo: int, replacement: int, data_type: int) -> str:
    """The text of a unit's commit info."""
    return f"{hi},{lo},{replacement},{data_type}"


def parse_catalog(text: str) -> tuple[int, dict[SubValueSpec, tuple[int, bool]]]:
    """The next index number, and the number and readability of each index, from lines ``number``, then ``spec`` and ``number,T`` or ``F``."""
    rows = text.split("\n")
    out: dict[SubValueSpec, tuple[int, bool]] = {}
    for spec, state in zip(rows[1::2], rows[2::2]):
        if spec:
            number, _, flag = state.partition(",")
            if flag not in ("T", "F"):
                raise ValueError(f"not an index state: {state!r}")
            out[SubValueSpec.parse(spec)] = (int(number), flag == "T")
    return int(rows[0]), out


def dump_catalog(next_number: int, indexes: dict[SubValueSpec, tuple[int, bool]]) -> str:
    return f"{next_number}\n" + "".join(f"{s.text()}\n{n},{'T' if r else 'F'}\n" for s, (n, r) in indexes.items())
