"""A change feed as a stream: current state kept up by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.changes import compose_patches
from tidewell.sources.files import Folder


class StateTable:
    """Composed patches as a base and the deltas after it: each micro-batch adds one, its own changes composed.

    ``v<number>`` is the state up to and with a batch, ``d<number>`` a batch alone. Reading composes the newest whole base with the later
    deltas. After ``fold_every`` deltas a batch writes a base in place of its delta, and what that covers is deleted, but for the base before,
    which readers may still use. A batch that is run again after a failure writes the folder of its number again, from what came before it, so no
    change is lost or counted twice.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str], effect: list[str], fold_every: int = 20):
        self.spark, self.keys, self.order, self.effect, self.fold_every, self.folder = spark, keys, order, effect, fold_every, Folder(spark, root)

    def _parts(self, before: int | None = None) -> list[str]:
        """The newest base and the deltas after it, of batches below ``before``."""
        names = [n for n in self.folder.names() if n[:1] in "vd" and n[1:].isdigit() and (before is None or int(n[1:]) < before)]
        whole = sorted((n for n in names if self.folder.exists(f"{n}/_SUCCESS")), key=lambda n: int(n[1:]))
        base = max((i for i, n in enumerate(whole) if n[0] == "v"), default=0)
        return whole[base:]

    def read(self, before: int | None = None) -> DataFrame | None:
        parts = self._parts(before)
        if not parts:
            return None
        rows = self.spark.read.parquet(*[f"{self.folder.root}/{n}" for n in parts])
        return rows if len(parts) == 1 else compose_patches(rows, self.keys, self.order, self.effect)

    def apply(self, batch: DataFrame, number: int) -> None:
        changes = batch.select(*dict.fromkeys([*self.keys, *self.order, *self.effect]))
        parts = self._parts(number)
        fold = len(parts) >= self.fold_every
        if fold:
            changes = changes.unionByName(self.read(number).select(*changes.columns))
        compose_patches(changes, self.keys, self.order, self.effect).write.mode("overwrite").parquet(
            f"{self.folder.root}/{'v' if fold else 'd'}{number:012d}"
        )
        if fold:
            for n in self.folder.names():
                if n[:1] in "vd" and n[1:].isdigit() and int(n[1:]) < int(parts[0][1:]):
                    self.folder.delete(n)


def follow(spark: SparkSession, stream: DataFrame, state: StateTable, checkpoint: str) -> None:
    """Takes all that is there now, in micro-batches, into the state; call again for what comes later."""
    query = stream.writeStream.foreachBatch(
        lambda batch,
        number: state.apply(batch, number),
    ).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(state: StateTable, is_delete) -> DataFrame:
    return state.read().filter(~F.coalesce(is_delete, F.lit(False)))
