"""Session helpers: table access and the folder shared by all executors."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, as a lazily read Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str = "work") -> str:
    """A fresh path below the folder all executors share.

    The cluster names the folder in ``spark.checkpoint.dir``. Only where that is unset and all runs in one process (tests, a laptop) is a
    temporary folder of this machine made and set, so that later calls and ``checkpoint()`` agree on it; elsewhere it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, cut off from their lineage by a table in the shared folder."""
    path = shared_dir(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of the given columns (case does not count)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ship_code(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of the session's cluster, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tidewell_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="tidewell-code-")) / "tidewell.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent).as_posix())
    context.addPyFile(str(target))
    context._tidewell_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """A scan for work in Python: one of fewer splits than there are cores is dealt out to all of them, a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
