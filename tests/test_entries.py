import random

import pytest
from pyspark.sql import functions as F

from tidewell import datum as D
from tidewell.operators import entries as E
from tidewell.spec import SubValueSpec

LOG = "pk bigint, commit_ver bigint, pv struct<_0:string,_1:bigint,_2:struct<_0:bigint,_1:string>>"


def a_log(n=400, seed=4):
    r = random.Random(seed)
    vers = r.sample(range(1, 40000), n)
    return [(r.choice([1, 1, 1, 2, 3, 4, None]), v, r.choice([None, (r.choice("ab"), r.choice([1, 2, None]), (r.randrange(3), "x"))])) for v in vers]


def fold(log):
    out = {}
    for pk, _, pv in sorted(log, key=lambda x: x[1]):
        out[pk] = pv
    return out


def test_newest_and_snapshot(spark, rows):
    log = a_log()
    df = spark.createDataFrame(log, LOG)
    for cut in (0, 9000, 10**6):
        want = {k: v for k, v in fold([x for x in log if x[1] <= cut]).items() if v is not None}
        got = {x.pk: tuple(x.pv[:2]) for x in E.current(E.snapshot(df, cut), ["pk"], ["commit_ver"]).collect()}
        assert got == {k: v[:2] for k, v in want.items()}
    assert E.compact(df, ["pk"], ["commit_ver"], False).count() == len(fold(log))
    assert E.current(df.limit(0), ["pk"], ["commit_ver"]).count() == 0


def test_staged(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "pk bigint, commit_ver bigint, pv string").withColumn("seq", F.lit(0).cast("bigint"))
    staged = spark.createDataFrame([(1, None, 1), (3, "x", 1), (3, "y", 2)], "pk bigint, pv string, seq bigint")
    got = {r.pk: r.pv for r in E.current(E.staged_over(df, staged, ["commit_ver"]), ["pk"], ["commit_ver", "seq"]).collect()}
    assert got == {2: "b", 3: "y"}


def test_index_delta(spark, rows):
    log = [(k, v, None if p is None else (p[0] if p[1] != 2 else None, p[1], p[2])) for k, v, p in a_log()]
    df = spark.createDataFrame(log, LOG).withColumn("sv", F.col("pv._0"))
    delta = E.index_delta(df, ["pk"], ["commit_ver"])
    want = set()
    state = {}
    for pk, ver, pv in sorted(log, key=lambda x: x[1]):
        old, state[pk] = state.get(pk), pv
        a, b = old and old[0], pv and pv[0]
        if a is not None and a != b:
            want.add((a, pk, ver, False))
        if b is not None and (a != b or old != pv):
            want.add((b, pk, ver, True))
    got = {(r.sv, r.pk, r.commit_ver, r.pv is not None) for r in delta.collect()}
    assert got == want
    built = E.index_rows(E.current(df.drop("sv"), ["pk"], ["commit_ver"]), SubValueSpec((0,), D.STR))
    folded = E.current(delta, ["sv", "pk"], ["commit_ver"])
    assert rows(folded.select("sv", "pk")) == rows(built.select("sv", "pk"))


def test_ranges(spark):
    df = spark.createDataFrame([(k, ("ab"[k % 2], k, (k, "x"))) for k in range(10)] + [(None, ("a", 1, (1, "x")))], "pk bigint, pv struct<_0:string,_1:bigint,_2:struct<_0:bigint,_1:string>>")
    pks = lambda d: [r.pk for r in d.collect()]
    assert pks(E.pk_range(df, 3, 5)) == [3, 4, 5] and pks(E.pk_range(df, 5, 3)) == [] and len(pks(E.pk_range(df, None, None))) == 10
    assert pks(E.pk_range(df, 8, "any")) == [8, 9] and pks(E.pk_range(df, "any", None)) == [] and pks(E.pk_range(df, None, b"")) == list(range(10))
    whole, pair, first = SubValueSpec((), D.TUPLE), SubValueSpec((2,), D.TUPLE), SubValueSpec((0,), D.STR)
    both = {pair, first, whole, SubValueSpec((0,), D.I64), SubValueSpec((7,), D.STR)}
    assert pks(E.sv_range(df.dropna(subset=["pk"]), first, "b", None, both)) == [1, 3, 5, 7, 9]
    assert pks(E.sv_range(df.dropna(subset=["pk"]), pair, (3, "x"), (4,), both)) == [3]
    assert E.sv_range(df, SubValueSpec((0,), D.I64), None, None, both).count() == 0 and E.sv_range(df, SubValueSpec((7,), D.STR), None, None, both).count() == 0
    with pytest.raises(E.NoIndex, match="Secondary index does not exist"):
        E.sv_range(df, SubValueSpec((1,), D.I64), None, None, both)


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id AS pk", "named_struct('_0', id, '_1', cast(id as string)) AS pv", "id AS commit_ver").write.parquet(path)
    df = spark.read.parquet(path)
    plan = E.pk_range(df, 3, 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(pk), GreaterThanOrEqual(pk,3), LessThanOrEqual(pk,5)]" in plan
    plan = E.current(df.filter("pk = 7"), ["pk"], ["commit_ver"])._jdf.queryExecution().toString()
    assert "EqualTo(pk,7)" in plan
    plan = E.sv_range(df, SubValueSpec((0,), D.I64), 3, 5, {SubValueSpec((0,), D.I64)}).select("pk")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(pv._0,3)" in plan and "pv:struct<_0:bigint>" in plan


def test_place(spark):
    df = spark.createDataFrame([(i * 7919 % 1009,) for i in range(1009)], "k bigint")
    assert all(r.place == r.k + 1 for r in E.place(df, "k", "place").collect())


def test_first_members_are_cut_with_built_ins(spark):
    import random

    from tidewell import datum as D
    from tidewell.functions.keys import sub_key
    from pyspark.sql import functions as F

    r = random.Random(8)
    leaf = lambda: r.choice([0, -1, 2**63 - 1, -(2**63), 256, b"", b"\0", b"\0\0", b"a\0", b"\0\1\0", b"\xff\0\0\1", "", "\0", "é\0", "x" * 40, "\0\1"])
    values = [leaf() for _ in range(40)] + [tuple(leaf() if r.random() < 0.8 else (leaf(),) for _ in range(r.randrange(3))) for _ in range(300)]
    df = spark.createDataFrame([(bytearray(D.encode_key(v)),) for v in values] + [(None,)], "v binary")
    for tag in (D.I64, D.STR, D.BYTES, D.TUPLE):
        got = [None if x.s is None else bytes(x.s) for x in df.select(sub_key(F.col("v"), (0,), tag).alias("s")).collect()]
        assert got == [D.slice_key(D.encode_key(v), [0], tag) for v in values] + [None]
    assert "ArrowEvalPython" not in df.select(sub_key(F.col("v"), (0,), D.STR))._jdf.queryExecution().executedPlan().toString()
