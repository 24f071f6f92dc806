"""Problems 1 to 5 against brute force on small tables, with their edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from test_intervals import UNITS, a_listing, brute_live
from tidewell.functions.json_tree import _parse_deep, members, parse
from tidewell.operators import changes, consolidate, eager_aggregation, incremental, nested
from tidewell.session import shared_dir

RUNS = "store_id bigint, consumer string, run_id bigint, commit_ver_lo_incl bigint, commit_ver_hi_incl bigint, status string"
ENTRIES = "feed_pos bigint, store_id bigint, unit_num bigint, seq int, pk_key binary, pk_type int, pk string, datum_type int, pv string, n_bytes bigint"


def test_unhandled_units(spark, rows):
    r = random.Random(7)
    listing = a_listing()
    runs = []
    for i in range(120):
        lo = r.randrange(1, 300)
        runs.append((r.choice([1, 1, 2, 3, 9]), r.choice(["x", "y", None]), i, lo, lo + r.choice([0, 3, 40, -1]), r.choice(["succeeded", "succeeded", "failed", None])))
    runs += [(1, "x", 500, None, 3, "succeeded"), (None, "x", 501, 1, 400, "succeeded"), runs[0]]
    got = rows(incremental.unhandled_units(spark, spark.createDataFrame(runs, RUNS), spark.createDataFrame(listing, UNITS), shared_dir(spark)).select("store_id", "consumer", "unit_num"))
    want = set()
    for s, c in {x[:2] for x in runs if x[0] is not None}:
        done = {v for x in runs if x[:2] == (s, c) and x[5] == "succeeded" and x[3] is not None for v in range(x[3], x[4] + 1)}
        want |= {(s, c, u[1]) for u in brute_live(listing) if u[0] == s and set(range(u[3], u[2] + 1)) - done}
    # a null consumer is a consumer of its own, but no run can cover for it by equality
    assert {x for x in got if x[1] is not None} == {x for x in want if x[1] is not None} and len(got) == len(set(got))
    empty = incremental.unhandled_units(spark, spark.createDataFrame(runs, RUNS).limit(0), spark.createDataFrame(listing, UNITS), shared_dir(spark))
    assert empty.count() == 0


def test_incremental_state(spark, rows):
    schema = "id bigint, a string, b bigint, _change string, _c_hash string"
    first = [(1, "x", 1, "q", "q"), (2, None, 2, "q", "q"), (None, "n", 3, "q", "q"), (3, "", None, "q", "q")]
    state = incremental.IncrementalState(spark, shared_dir(spark), ["id"])
    df = spark.createDataFrame(first, schema)
    assert "__change" in state.select(df, ["a", "b"]).columns  # the row's own columns stay
    df = df.drop("_change")
    assert state.read() is None and rows(state.select(df, ["a", "b"]).select("id", "_change")) == [(None, "new"), (1, "new"), (2, "new"), (3, "new")]
    token = state.run_token()
    assert state.run_token() == token  # a run that died is repeated under its token
    assert state.commit(df, ["a", "b"]) == 0 and state.run_token() != token
    assert state.select(df, ["a", "b"]).count() == 0
    second = [(1, "x", 1, "", ""), (2, "", 2, "", ""), (None, "n", 3, "", ""), (3, None, None, "", ""), (4, "new", 0, "", ""), (4, "new", 0, "", "")]
    df2 = spark.createDataFrame(second, schema).drop("_change")
    assert rows(state.select(df2, ["a", "b"]).select("id", "_change")) == [(2, "changed"), (3, "changed"), (4, "new"), (4, "new")]
    state.commit(df2.filter("id = 4"), ["a", "b"])
    assert rows(state.select(df2, ["a", "b"]).select("id")) == [(2,), (3,)]
    other = incremental.IncrementalState(spark, state.folder.root, ["id"])
    other.version = lambda: 0  # as seen by a writer that began before the last commit
    with pytest.raises(FileExistsError):
        other.commit(df2, ["a", "b"])
    assert state.version() == 1


def test_incremental_state_of_differing_rows_and_two_runs(spark, rows):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n"), (None, "m")], "id bigint, a string")
    state = incremental.IncrementalState(spark, shared_dir(spark), ["id"])
    state.commit(df, ["a"])
    assert state.select(df, ["a"]).count() == 0  # nothing has changed
    more = spark.createDataFrame([(1, "x"), (1, "w")], df.schema)
    assert rows(state.select(more, ["a"])) == [(1, "w", "changed")]
    other = incremental.IncrementalState(spark, state.folder.root, ["id"])
    assert rows(other.select(more, ["a"])) == [(1, "w", "changed")]
    assert state.commit(more, ["a"]) == 1
    with pytest.raises(FileExistsError):  # the same version was selected by both
        other.commit(more, ["a"])
    assert rows(state.select(df, ["a"])) == [(1, "y", "changed")]  # a key's contents are those of its last commit
    assert other.select(more, ["a"]).count() == 0 and other.commit(more, ["a"]) == 2


def test_json_tree():
    for text in ["[]", "{}", '[1,{"a":[null,true,"x\\u00e9"]}]', " 3 ", '"s"', '{"a":{"b":[]} , "c":-1.5e3}']:
        assert parse(text) == _parse_deep(text)
    for text in ["", "[1,", '{"a"}', "[1 2]", "1 2", "nul", "[NaN]", '{"a":1,}', "[1,]", "Infinity"]:
        for f in (parse, _parse_deep):
            with pytest.raises(ValueError):
                f(text)
    assert list(members([1, None, 2])) == [(0, "1")] * 0 + [(0, 1), (2, 2)]
    assert list(members({"1": "a", "0": "b", "5": None})) == [(0, "b"), (1, "a")]
    assert list(members({"datum_type": 1})) == [(0, {"datum_type": 1})]
    assert list(members("[4]")) == [(0, "4")] and list(members("text")) == [(0, "text")] and list(members(None)) == [] and list(members({})) == []


def test_tuple_members(spark, rows):
    schema = "value_id bigint, datum_type int, members_count int, datum_body string, path string"
    t = lambda b: {"datum_type": 4, "datum_body": b}
    one, two = {"datum_type": 1, "datum_body": 7, "unit": "kg"}, {"datum_type": 3, "datum_body": "[1]"}
    deep = one
    for _ in range(60):
        deep = t([deep])
    data = [
        (1, 4, 9, json.dumps([one, None, t([two, t({"2": one, "0": None})]), t(json.dumps([one, "bare"])), t(one), t(5), t(None), {"datum_type": 4}])),
        (1, 4, 9, json.dumps([one, None, t([two, t({"2": one, "0": None})]), t(json.dumps([one, "bare"])), t(one), t(5), t(None), {"datum_type": 4}])),
        (2, 4, None, "[" + json.dumps(one)),
        (3, 4, 1, json.dumps(json.dumps([one]))),
        (4, 3, 1, '["not a tuple"]'),
        (5, 4, 1, None),
        (6, 4, 1, ""),
        (7, 4, 1, "[NaN]"),
        (8, 4, 0, json.dumps([deep])),
        (None, 4, 1, "[1]"),
        (9, 4, 1, "[" * 3000 + "]" * 3000),
    ]
    df = spark.createDataFrame([(*x, "clash") for x in data], schema)
    got = rows(nested.tuple_members(df, fields=False).filter("value_id IS NULL OR value_id < 8").select("value_id", "parent_path", "position"))
    assert got == sorted(
        [(1, "", i) for i in (0, 2, 3, 4, 5, 6, 7)] + [(1, "2", 0), (1, "2", 1), (1, "2.1", 2), (1, "3", 0), (1, "3", 1), (1, "4", 0), (1, "5", 0), (3, "", 0), (None, "", 0)], key=lambda x: (x[0] is not None, x)
    )
    full = nested.tuple_members(df)
    assert {"datum_type", "datum_body", "unit", "position", "path"} <= set(full.columns)
    assert full.filter("value_id = 8").count() == 61
    row = full.filter("value_id = 1 AND path = '3.1'").first()
    assert row.datum_body == "bare" and row.datum_type is None and full.filter("value_id = 1 AND path = '0'").first().unit == "kg"
    assert nested.tuple_members(df.limit(0)).count() == 0


def test_shared_inlining(spark, rows):
    docs = [{"id": 1, "who": {"name": "a", "home": {"city": "x"}}, "tags": ["p", "q"], "parts": [{"n": 1, "parts": [{"n": 2}]}]}, {"id": 2, "who": None, "tags": [], "extra": {"home": {"city": "y"}}}]
    df = spark.createDataFrame([(10, json.dumps(docs[0])), (11, json.dumps(docs[1])), (12, "{"), (13, None)], "k bigint, j string")
    plan = nested.inline_plan(nested.schema_graph(df, "j"))
    assert plan.tables == {"value", "tags", "parts", "home"}  # repeated, recursive, shared
    assert plan.columns["value"] == ["extra", "id", "who", "who.name"]
    out = nested.shred(df, ["k"], "j", plan)
    assert rows(nested.table_of(out, plan, "value", ["k"]).select("k", "id", "who_name")) == [(10, "1", "a"), (11, "2", None)]
    parts = nested.table_of(out, plan, "parts", ["k"])
    assert rows(parts.select("path", "parent_path", "n")) == [("parts:0", "", "1"), ("parts:0.parts:0", "parts:0", "2")]
    assert rows(nested.table_of(out, plan, "home", ["k"]).select("k", "parent_table", "city")) == [(10, "value", "x"), (11, "value", "y")]


def a_feed(listing, seed=11):
    r = random.Random(seed)
    out = []
    for s, u in sorted({x[:2] for x in listing if None not in x[:2]} | {(77, 1)}):
        for seq in range(r.choice([0, 1, 5, 12])):
            pk = r.choice(["hot", "hot", *"abcdefgh"])
            kind = r.choice([3, 3, 4, 0, None])
            out += [(0, s, u, seq, pk.encode(), 3, pk, kind, r.choice([None, "", f'"{seq}"']), 1)] * r.choice([1, 1, 2])
    r.shuffle(out)
    return out


def test_changes(spark, rows):
    listing = a_listing()
    feed = a_feed(listing)
    e, u = spark.createDataFrame(feed, ENTRIES), spark.createDataFrame(listing, UNITS)
    live = {x[:2]: x for x in brute_live(listing)}
    best = {}
    for f in feed:
        if f[1:3] in live:
            k = (f[1], f[5], f[6])
            rank = (live[f[1:3]][2], f[3], f[2])
            if k not in best or rank > best[k][0]:
                best[k] = (rank, f)
    want = sorted((*k, f[2], f[3]) for k, (_, f) in best.items() if f[7] != 0)
    got = rows(changes.current_entries(e, u).select("store_id", "pk_type", "pk", "unit_num", "seq"))
    assert got == want and want
    # the same from a state and the rest of the feed, in two steps
    half = changes.unit_patches(e.filter("unit_num % 2 = 0"), u)
    both = changes.compose_patches(half.unionByName(changes.unit_patches(e, u)), ["store_id", "pk_type", "pk"], ["ver", "seq", "unit_num"], ["datum_type"])
    assert rows(both) == rows(changes.unit_patches(e, u))
    base = spark.createDataFrame([(500, 3, "kept", 1, 1, 1, 3), (1, 3, "hot", 0, 0, 0, 3)], half.schema)
    after = rows(changes.current_entries(e, u, base).select("store_id", "pk_type", "pk", "unit_num", "seq"))
    assert (500, 3, "kept", 1, 1) in after and [x for x in after if x[0] != 500] == want
    assert changes.current_entries(e.limit(0), u).count() == 0


def test_consolidate(spark, rows):
    listing = a_listing()
    feed = a_feed(listing)
    done = consolidate.consolidate(spark.createDataFrame(listing, UNITS), spark.createDataFrame(feed, ENTRIES), target_bytes=20000)
    live = {x[:2]: x for x in brute_live(listing)}
    want = sorted({f[1:4] for f in feed if f[1:3] in live})
    assert rows(done.entries.select("store_id", "unit_num", "seq")) == want
    assert rows(consolidate.small_inputs(done)) == sorted(k for k, u in live.items() if u[7] is not None and u[7] < 4096)
    ranges = sorted(done.ranges.collect(), key=lambda x: (x.store_id, x.out_num))
    assert sum(x.n_entries for x in ranges) == len(want) and sum(x.n_units for x in ranges) == len(live)
    per = {}
    for (s, n), u in live.items():
        row = done.lineage.filter(f"store_id = {s} AND unit_num = {n}").first() if len(per) < 3 else None
        per[s, n] = row
    lin = {(x.store_id, x.unit_num): x.out_num for x in done.lineage.collect()}
    for s in {k[0] for k in live}:
        order = sorted((k for k in live if k[0] == s), key=lambda k: live[k][3])
        outs = [lin[k] for k in order]
        assert outs == sorted(outs)  # by version
        before = 0
        seen = {}
        for k in order:
            seen.setdefault(live[k][3], before)
            assert lin[k] == seen[live[k][3]] // 20000
            before += live[k][7] or 0
    assert consolidate.consolidate(spark.createDataFrame(listing, UNITS).limit(0), spark.createDataFrame(feed, ENTRIES)).entries.count() == 0


def test_consolidate_keeps_different_entries(spark, rows):
    listing = a_listing()
    s, u = next(k for k in sorted(x[:2] for x in brute_live(listing)))
    entry = lambda pos, seq, pk, kind, pv: (pos, s, u, seq, pk.encode(), 3, pk, kind, pv, 1)
    feed = [entry(0, 0, "a", 3, "x"), entry(1, 0, "a", 3, "x"), entry(2, 0, "b", 3, "x"), entry(3, 0, "a", 3, "y"), entry(4, 0, "a", 0, "x"), entry(5, None, "a", 3, "x"), entry(6, None, "c", 3, None), entry(7, None, "c", 3, None), entry(8, 1, "d", 3, "")]
    done = consolidate.consolidate(spark.createDataFrame(listing, UNITS), spark.createDataFrame(feed, ENTRIES))
    assert rows(done.entries.select("seq", "pk", "datum_type", "pv")) == sorted({(f[3], f[6], f[7], f[8]) for f in feed}, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))
    assert done.ranges.agg(F.sum("n_entries")).first()[0] == 7


def test_eager_aggregation(spark, rows):
    r = random.Random(2)
    left = [(r.choice(["hot"] * 8 + ["a", None]), r.choice([1, 2, None]), r.choice([5, None, -3]), "z") for _ in range(200)]
    right = [(r.choice([1, 2, 2, 3, None]), r.choice([10, None]), "z") for _ in range(20)]
    L, R = spark.createDataFrame(left, "g string, k bigint, x bigint, n_left string"), spark.createDataFrame(right, "k bigint, y bigint, n_left string")
    got = rows(eager_aggregation.eager_join_aggregate(L, R, ["k"], ["g"], {"sx": "x"}, {"sy": "y"}))
    want = []
    for g in ["hot", "a", None]:
        mine = [l for l in left if l[0] == g]
        pairs = [(l, q) for l in mine for q in right if l[1] is not None and l[1] == q[0]]
        total = lambda v: sum(x for x in v if x is not None) if any(x is not None for x in v) else None
        want.append((g, len(mine), len(pairs), total([l[2] for l, _ in pairs]), total([q[1] for _, q in pairs])))
    assert got == sorted(want, key=lambda x: (x[0] is not None, x))
    figures = eager_aggregation.eager_join_aggregate(L, R, ["k"], ["g"])
    assert rows(eager_aggregation.heavy_groups(figures, ["g"], 0.5).select("g")) == [("hot",)]
    exact = spark.createDataFrame([("a", 15), ("b", 14), ("c", 971)], "g string, left_rows bigint")
    assert rows(eager_aggregation.heavy_groups(exact, ["g"], 0.015).select("g")) == [("a",), ("c",)]
    none = eager_aggregation.eager_join_aggregate(L.limit(0), R, ["k"], ["g"])
    assert none.count() == 0 and eager_aggregation.heavy_groups(none, ["g"], 0.1).count() == 0
    assert [x.joined_rows for x in eager_aggregation.eager_join_aggregate(L, R.limit(0), ["k"], ["g"]).collect()] == [0, 0, 0]


def test_optional_objects_and_lists_of_members_get_rows(spark, rows):
    body = json.dumps([{"datum_type": 1, "datum_body": "5", "note": {"a": 1, "deep": {"b.c": "z"}}, "tags": [{"x": 1}, {"x": 2}, None, 7]}, {"datum_type": 4, "datum_body": {"2147483647": 1, "2147483648": 2}}])
    df = spark.createDataFrame([(1, 4, body), (1, 4, body), (2, 4, "[]"), (3, 4, "[")], "value_id bigint, datum_type int, datum_body string")
    found = nested.tuple_tables(df)
    assert found.plan.tables == {"value", "member", "tags"}
    assert rows(found.table("member").select("path", "parent_path", "note_a", "note_deep_b_c")) == [("0", "", "1", "z"), ("1", "", None, None), ("1.2147483647", "1", None, None)]
    tags = found.table("tags")
    assert rows(tags.select("value_id", "path", "parent_table", "parent_path", "position", "x", "datum_body")) == [(1, "0.tags:0", "member", "0", 0, "1", None), (1, "0.tags:1", "member", "0", 1, "2", None), (1, "0.tags:3", "member", "0", 3, None, "7")]
    assert rows(found.table("value").select("value_id", "parent_table")) == [(1, None), (2, None)]
    # every link leads to a row
    every = found.rows
    assert every.alias("x").filter("parent_table IS NOT NULL").join(every.alias("y"), F.expr("x.value_id = y.value_id AND x.parent_path = y.path AND x.parent_table = y.table"), "left_anti").count() == 0


def test_the_schema_graph_decides_the_tables(spark, monkeypatch):
    df = spark.createDataFrame([(1, 4, "[1, [2]]")], "value_id bigint, datum_type int, datum_body string")
    assert nested.tuple_members(df, fields=False).count() == 2
    monkeypatch.setattr(nested, "graph_of", lambda rows: set())
    assert nested.tuple_members(df, fields=False).count() == 0
    monkeypatch.undo()
    monkeypatch.setattr(nested, "MAX_EDGES", 1)
    with pytest.raises(ValueError, match="keyed by data"):
        nested.tuple_members(df)


def test_consolidated_files(spark, rows):
    listing = [(1, k, k, k, 0, 0, 9, 100 + k, "x") for k in range(1, 61)] + [(1, 100, 100, 100, 0, 1, 9, 5000, "x"), (2, 1, 1, 1, 0, 0, 9, None, "x"), (3, 1, 1, 1, 0, 0, 0, 7, "x")]
    feed = [(0, s, u, q, f"k{q}".encode(), 3, f"k{q}", 3, "v" * (n or 3), 1) for s, u, *_, n, _ in listing for q in range(3) if s != 3]
    r = random.Random(4)
    r.shuffle(feed)
    feed += feed[:20]
    done = consolidate.consolidate(spark.createDataFrame(listing, UNITS), spark.createDataFrame(feed, ENTRIES), target_bytes=1000)
    files = sorted(done.files.collect(), key=lambda f: (f.store_id, f.out_num, f.part))
    assert len({f.file for f in files}) == len(files) and all(f.file_bytes > 0 for f in files)  # one file a range
    ones = [f for f in files if f.store_id == 1]
    spans = [(f.commit_ver_lo_incl, f.commit_ver_hi_incl) for f in ones]
    assert len(ones) > 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    per_unit = {f: sum(100 + u for u in range(f[0], f[1] + 1)) for f in spans}
    assert all(500 <= per_unit[f] <= 2000 for f in spans[:-1])  # by bytes, but the last
    assert done.lineage.filter("kept").count() == 1 and done.entries.count() == len(set(feed)) and done.entries.agg(F.sum("copies")).first()[0] == len(feed)
    for f in ones:  # each file is sorted by version, unit and place
        got = [(x.commit_ver_lo_incl, x.unit_num, x.seq) for x in spark.read.parquet(f.file).collect()]
        assert got == sorted(got)
    assert (3, 1) in rows(consolidate.small_inputs(done))
    # an entry that is lost on the way shows in what is found
    lost = done.entries.filter("NOT (unit_num = 7 AND seq = 1)")
    came = lost.groupBy("store_id", "unit_num").agg(F.sum("copies").alias("n"))
    short = done.lineage.drop("rows_out").join(came, ["store_id", "unit_num"], "left").withColumn("rows_out", F.coalesce("n", F.lit(0)))
    assert (1, 7) in rows(consolidate.small_inputs(done)) and (1, 7) not in rows(consolidate.small_inputs(consolidate.Consolidated(lost, done.files, done.ranges, short)))


def test_one_version_of_many_units_rolls_over(spark):
    listing = [(1, k, 5, 5, 0, 0, 1, 400, "x") for k in range(20)]
    feed = [(0, 1, k, 0, b"k", 3, "k", 3, "v", 1) for k in range(20)]
    done = consolidate.consolidate(spark.createDataFrame(listing, UNITS), spark.createDataFrame(feed, ENTRIES), target_bytes=1000)
    assert [f.n_units for f in done.files.orderBy("part").collect()] == [3, 2, 3, 2, 3, 2, 3, 2]


def test_the_join_decides_heavy_groups(spark, rows):
    left = spark.createDataFrame([("a", 1)] * 6 + [("b", 2)] * 4 + [("c", 9)] * 2, "g string, k bigint")
    right = spark.createDataFrame([(1,), (2,), (2,), (2,)], "k bigint")
    figures = eager_aggregation.eager_join_aggregate(left, right, ["k"], ["g"], outer=True)
    assert rows(figures.select("g", "left_rows", "joined_rows", "outer_rows")) == [("a", 6, 6, 6), ("b", 4, 12, 12), ("c", 2, 0, 2)]
    assert rows(eager_aggregation.heavy_groups(figures, ["g"], 0.4, "outer_rows").select("g")) == [("b",)]
    assert rows(eager_aggregation.heavy_groups(figures, ["g"], 0.4).select("g")) == [("a",)]


def test_p4_found_joins_both_tables(spark):
    from tidewell.plans import problem_queries

    plan = problem_queries.p4_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (_k0" in plan and "Join Cross" not in plan.replace("Join Cross\n", "") and plan.count("spec_id") > 1


def test_both_changes_of_the_incremental_state_occur(spark, rows, monkeypatch):
    from datetime import datetime

    day = lambda d: datetime(2020, 1, d)
    runs = [(1, "x", 1, 1, 4, "succeeded", day(1)), (1, "x", 2, 5, 8, "succeeded", day(9)), (1, "x", 3, 12, 12, "succeeded", day(9)), (1, "y", 4, 1, 50, "succeeded", day(9)), (1, "x", 5, 9, 20, "failed", day(8)), (1, "x", 6, None, 9, "succeeded", None)]
    listing = [(1, n, hi, lo, 0, 0, 1, 1, "x") for n, lo, hi in ((1, 1, 2), (2, 3, 6), (3, 7, 9), (4, 10, 13), (5, 14, 20), (6, 9, 8))]
    df = spark.createDataFrame(runs, RUNS + ", started_at timestamp")
    seen = []
    select = incremental.IncrementalState.select

    def watched(self, rows_, content):
        out = select(self, rows_, content)
        seen.append(sorted((r.consumer, r.unit_num, r._change) for r in out.collect()))
        return out

    monkeypatch.setattr(incremental.IncrementalState, "select", watched)
    found = incremental.unhandled_units(spark, df, spark.createDataFrame(listing, UNITS), shared_dir(spark))
    assert seen[0] == [("x", 2, "changed"), ("x", 3, "new"), ("x", 4, "new"), *[("y", n, "new") for n in (1, 2, 3, 4, 5)]]
    assert seen[1] == [("x", 3, "changed"), ("x", 4, "changed"), ("x", 5, "new")] == sorted((r.consumer, r.unit_num, r._change) for r in found.collect())
    # without the hash every pair that is in the state counts as done
    monkeypatch.setattr(incremental, "content_hash", lambda columns: F.lit(0).cast("bigint"))
    broken = incremental.unhandled_units(spark, df, spark.createDataFrame(listing, UNITS), shared_dir(spark))
    assert sorted((r.consumer, r.unit_num) for r in broken.collect()) == [("x", 5)]


def test_changes_apply_to_a_base(spark, rows, monkeypatch):
    listing = [(1, n, n, n, 0, 0, 1, 1, "x") for n in (1, 2, 3, 4)]
    feed = [(0, 1, 1, 0, b"a", 3, "a", 3, "1", 1), (0, 1, 1, 1, b"b", 3, "b", 3, "1", 1), (0, 1, 2, 0, b"c", 3, "c", 0, None, 1), (0, 1, 3, 0, b"a", 3, "a", 0, None, 1), (0, 1, 4, 0, b"d", 3, "d", 3, "1", 1)]
    e, u = spark.createDataFrame(feed, ENTRIES), spark.createDataFrame(listing, UNITS)
    key = lambda df: rows(df.select("pk", "unit_num"))
    assert key(changes.current_entries(e, u)) == [("b", 1), ("d", 4)]
    monkeypatch.setattr(changes, "apply_patches", lambda base, patches, keys, is_delete: base)
    assert key(changes.current_entries(e, u)) == [("a", 1), ("b", 1)]  # the base alone


def test_gaps(spark, rows):
    from tidewell.operators.intervals import GREATEST, LEAST, gaps_between, overlap_lengths

    df = spark.createDataFrame([("a", 5, 9), ("a", 10, 20), ("a", 5000, 9000), ("a", 30, 29), (None, 1, 1)], "k string, lo bigint, hi bigint")
    keys = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "k string")
    want = [(None, LEAST, 0), (None, 2, GREATEST), ("a", LEAST, 4), ("a", 21, 4999), ("a", 9001, GREATEST), ("b", LEAST, GREATEST)]
    assert rows(gaps_between(df, ["k"], keys)) == want
    left = spark.createDataFrame([("a", i, lo, hi) for i, lo, hi in ((1, 1, 6), (2, 6, 6), (3, 0, 10**6), (4, 7, 3), (5, None, 3))], "k string, id int, lo bigint, hi bigint")
    got = rows(overlap_lengths(left, df.filter("lo <> 10"), ["k"], ["id"], "n", salts=3))
    assert got == [(1, 2), (2, 1), (3, 5 + 4001)]
