from pyspark.sql import functions as F

from tidewell.session import shared_dir
from tidewell.streaming.feed import StateTable, current, follow


def test_follow(spark, rows):
    feed, schema = shared_dir(spark, "feed"), "k string, ver bigint, kind int, v string"
    state, offsets = StateTable(spark, shared_dir(spark), ["k"], ["ver"], ["kind", "v"]), shared_dir(spark)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
    put = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(feed)
    put([("a", 3, 1, "late"), ("b", 1, 1, "x")])
    put([("a", 1, 1, "old"), ("c", 2, 1, "y"), ("a", 3, 1, "late")])
    follow(spark, stream(), state, offsets)
    assert rows(current(state, F.col("kind") == 0).select("k", "v")) == [("a", "late"), ("b", "x"), ("c", "y")]
    put([("c", 9, 0, None), ("b", 0, 0, None)])
    follow(spark, stream(), state, offsets)
    assert rows(current(state, F.col("kind") == 0).select("k", "v")) == [("a", "late"), ("b", "x")]
    state.apply(spark.createDataFrame([("c", 9, 0, None), ("b", 0, 0, None)], schema), 2)  # a batch that is run again
    assert current(state, F.col("kind") == 0).count() == 2


def test_deltas_are_folded(spark, rows):
    state = StateTable(spark, shared_dir(spark), ["k"], ["ver"], ["kind", "v"], fold_every=2)
    batch = lambda *data: spark.createDataFrame(list(data), "k string, ver bigint, kind int, v string")
    want = {}
    for n in range(7):
        data = [(k, n * 10 + i, int((n + i) % 4 > 0), f"{n}{i}") for i, k in enumerate("abc"[: 1 + n % 3])]
        state.apply(batch(*data), n)
        if n == 4:
            state.apply(batch(*data), n)  # run again after it was written
        want |= {k: (kind, v) for k, _, kind, v in data}
        assert rows(current(state, F.col("kind") == 0).select("k", "v")) == sorted((k, v) for k, (kind, v) in want.items() if kind)
    names = state.folder.names()
    assert sum(x[0] == "v" for x in names) <= 2 and len(names) <= 5  # what a base covers is gone
