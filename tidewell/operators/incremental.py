"""Processing only new or changed records: persisted key and content-hash state (problem 1)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.intervals import gaps_between, merge_intervals, overlap_lengths
from tidewell.operators.live_units import live_units
from tidewell.session import fresh, written
from tidewell.sources.files import Folder


def content_hash(columns: list[str]) -> Column:
    """64 bits over the columns, with nulls told apart from any value. Two contents are only ever compared under one key."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


class IncrementalState:
    """What has been processed, as a versioned table of (key columns, content hash) in the shared folder.

    A run calls ``select`` to get the rows that are new or changed against the current version, processes them, and then calls
    ``commit``, which writes the next version beside the old one and makes it current with one atomic step: the creation of
    its marker file, which fails if another run made it first. A run that dies before that leaves the old version current,
    so that its records are selected again; output keyed by ``run_token`` then replaces what the dead run left. Nothing is
    skipped and nothing is taken as processed twice.

    Key columns may be null (a null key is a key of its own). A key's rows may differ in content: the state keeps each of their
    hashes, and a row is changed if its hash is none of them. Extra columns pass through unchanged.

    A version is committed by the state object that selected against it: ``commit`` fails if another run has committed since.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.keys, self.folder = spark, keys, Folder(spark, root)
        self._schema: dict[int, object] = {}
        self._selected: int | None = None  # the version of the last select, until it is committed on

    def version(self) -> int:
        """The current version; -1 if nothing has been committed."""
        return max((int(n[8:-5]) for n in self.folder.names() if n.startswith("current-") and n.endswith(".json")), default=-1)

    def run_token(self) -> str:
        """The same for each attempt of one run, another after its commit."""
        return f"run-{self.version() + 1:012d}"

    def read(self, v: int | None = None) -> DataFrame | None:
        """The rows of a version, of the current one by default: (key columns, _c_hash), a key once for each of its contents."""
        v = self.version() if v is None else v
        if v < 0:
            return None
        return self.spark.read.parquet(f"{self.folder.root}/{json.loads(self.folder.read(f'current-{v:012d}.json'))['data']}")

    def _hashed(self, rows: DataFrame, content: list[str], name: str) -> DataFrame:
        return rows.withColumn(name, content_hash(content))

    def select(self, rows: DataFrame, content: list[str]) -> DataFrame:
        """The new or changed rows, with all their columns and ``_change`` ('new' or 'changed'; ``__change`` if that name is taken)."""
        self._selected = self.version()
        state = self.read(self._selected)
        now_hash, old_hash, change, *old_keys = fresh(rows.columns, "_c_hash", "_s_hash", "_change", *[f"_s{i}" for i in range(len(self.keys))])
        if state is None:
            return rows.withColumn(change, F.lit("new"))
        now = self._hashed(rows, content, now_hash)
        s = state.groupBy(*[F.col(k).alias(o) for k, o in zip(self.keys, old_keys)]).agg(F.collect_set("_c_hash").alias(old_hash))
        test = F.lit(True)
        for k, o in zip(self.keys, old_keys):
            test &= F.col(k).eqNullSafe(F.col(o))
        joined = now.join(s, test, "left").filter(F.col(old_hash).isNull() | ~F.array_contains(old_hash, F.col(now_hash)))
        return joined.withColumn(change, F.when(F.col(old_hash).isNull(), "new").otherwise("changed")).select(*rows.columns, change)

    def commit(self, rows: DataFrame, content: list[str], keep_missing: bool = True) -> int:
        """Makes the rows' keys and hashes the next version, with the keys of the version before unless ``keep_missing`` is off.

        The version before is the one ``select`` read, or the current one if nothing has been selected.
        """
        before = self.version() if self._selected is None else self._selected
        now = self._hashed(rows.select(*dict.fromkeys([*self.keys, *content])), content, "_c_hash").select(*self.keys, "_c_hash").distinct()
        old, v = self.read(before), before + 1
        if old is not None and keep_missing:
            now = now.withColumn("_age", F.lit(1)).unionByName(old.withColumn("_age", F.lit(0)))
            now = now.groupBy(*self.keys).agg(F.max("_age").alias("_x"), F.collect_set(F.struct("_age", "_c_hash")).alias("_all"))
            now = now.select(*self.keys, F.explode(F.expr("transform(filter(_all, y -> y._age = _x), y -> y._c_hash)")).alias("_c_hash"))
        data = f"state-{v:012d}-{Folder.token()}"
        now.write.parquet(f"{self.folder.root}/{data}")
        self.folder.create(f"current-{v:012d}.json", json.dumps({"data": data}))
        self._selected = None
        return v


PAIR = ["store_id", "consumer", "unit_num"]
SPAN = ["commit_ver_lo_incl", "commit_ver_hi_incl"]
CONTENT = [*SPAN, "n_handled"]
#: The first cut-off, as a share of the ledger's time: most of it is state that later runs find, as in a job that has been going for long.
EARLY = 7 / 8


def _handled(runs: DataFrame) -> DataFrame:
    """The intervals (store_id, consumer, lo, hi) of the successful runs. Null bounds and lo > hi are none; repeats add nothing later."""
    done = runs.filter((F.col("status") == "succeeded") & F.col("store_id").isNotNull() & F.col("consumer").isNotNull())
    return done.select("store_id", "consumer", F.col("commit_ver_lo_incl").alias("lo"), F.col("commit_ver_hi_incl").alias("hi")).filter("lo <= hi")


def pending_at(runs: DataFrame, units: DataFrame) -> DataFrame:
    """What was left to each consumer by the given ledger rows: (store_id, consumer, unit_num, lo, hi, n_handled) of its store's units with an
    unhandled version, where n_handled is the number of the unit's versions that successful runs had covered.

    The versions that a consumer's merged intervals leave out (its gaps) are joined with the units through the interval grid, so that units a
    consumer has done never meet it; consumers and units are not multiplied out. A null consumer has done nothing.
    """
    followers = runs.select("store_id", "consumer").dropna(subset=["store_id"]).distinct()
    gaps = written(gaps_between(_handled(runs), ["store_id", "consumer"], followers), "gaps")
    side = units.select("store_id", "unit_num", F.col(SPAN[0]).alias("lo"), F.col(SPAN[1]).alias("hi"))
    left = overlap_lengths(side, gaps, ["store_id"], ["store_id", "unit_num", "lo", "hi"], "_left", ["consumer"])
    return left.select(
        *PAIR,
        F.col("lo").alias(SPAN[0]),
        F.col("hi").alias(SPAN[1]),
        (F.col("hi") - F.col("lo") + 1 - F.col("_left")).alias(CONTENT[2]),
    )


def handled_now(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of which the ledger covers any version, with n_handled as it is by now."""
    done = written(merge_intervals(_handled(runs), ["store_id", "consumer"], gap=1), "done")
    side = pairs.select(*PAIR, F.col(SPAN[0]).alias("lo"), F.col(SPAN[1]).alias("hi"))
    met = overlap_lengths(side, done, ["store_id", "consumer"], [*PAIR, "lo", "hi"], CONTENT[2])
    return met.select(*PAIR, F.col("lo").alias(SPAN[0]), F.col("hi").alias(SPAN[1]), CONTENT[2])


def unhandled_units(spark: SparkSession, runs: DataFrame, units: DataFrame, root: str) -> DataFrame:
    """For each store and consumer the live units with a commit version that no successful run has handled.

    The state (root) is kept over two cut-offs of the ledger. The first version holds, for each consumer and unit that were not done
    when EARLY of the ledger's time had passed, the hash of the unit's versions and of how many of them had been handled. The later ledger rows
    then only matter to these pairs: those whose handled number is new or has changed against the state are committed as the next version.
    Last, all pairs of the first cut-off are hashed as they would be if they were done (every version handled) and held against the
    state: what is in it with that hash has been done since, what is missing (``new``) or has another hash (``changed``: done in part) is
    for the next run. The cut-off decides how the work is split, not what comes out; rows without a time belong to the later part.

    Ledger rows with null bounds or lo > hi cover nothing, nor do runs of a null consumer; repeats add nothing. A unit without any version
    (lo > hi) has nothing left to handle.
    """
    live = live_units(units)
    first, last = runs.agg(F.min("started_at"), F.max("started_at")).first() if "started_at" in runs.columns else (None, None)
    early = runs.filter(F.col("started_at") < F.lit(first + (last - first) * EARLY)) if first is not None else runs.limit(0)
    followers = runs.select("store_id", "consumer").distinct()  # those that only come later have everything left
    early = early.select("store_id", "consumer", *SPAN, "status").unionByName(followers, allowMissingColumns=True)
    pairs = written(pending_at(early, live), "pairs")
    state = IncrementalState(spark, root, PAIR)
    state.commit(pairs.filter(F.col(CONTENT[2]) > 0), CONTENT)
    grown = state.select(handled_now(runs, pairs), CONTENT)
    state.commit(grown, CONTENT)
    return state.select(pairs.withColumn(CONTENT[2], F.col(SPAN[1]) - F.col(SPAN[0]) + 1), CONTENT)
