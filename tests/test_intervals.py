import random

from tidewell.operators.intervals import interval_semi_join, merge_intervals, running
from tidewell.operators.live_units import committed_units, live_units
from pyspark.sql import functions as F

UNITS = "store_id bigint, unit_num bigint, commit_ver_hi_incl bigint, commit_ver_lo_incl bigint, replacement_num bigint, data_type int, n_entries bigint, n_bytes bigint, extra string"


def some_intervals(n, seed, wide=True):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lo = r.choice([r.randrange(0, 3000), r.randrange(-100, 100), 2**40 + r.randrange(100)])
        length = r.choice([0, 0, 0, 3, 70, 1500, 40000, 2**33 if wide else 5, -2])
        out.append((i, r.choice(["a", "a", "a", "b", None]), lo, lo + length, r.randrange(4)))
    return [*out, (n, "a", None, 5, 1), (n + 1, "a", 1, None, 1), (n + 2, "a", -(2**63), 2**63 - 1, 0)]


def test_semi_join(spark, rows):
    a, b = some_intervals(150, 1), some_intervals(60, 2)[:-1]
    schema = "id bigint, k string, lo bigint, hi bigint, w int"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for relation in ("overlaps", "inside"):

        def related(x, y):
            if None in (x[1], y[1], x[2], x[3], y[2], y[3]) or x[2] > x[3] or y[2] > y[3] or x[1] != y[1] or y[4] <= x[4]:
                return False
            return x[2] <= y[3] and y[2] <= x[3] if relation == "overlaps" else y[2] <= x[2] and x[3] <= y[3]

        want = sorted((x[0],) for x in a if any(related(x, y) for y in b))
        got = rows(interval_semi_join(left, right, ["k"], ["id"], relation, condition=lambda l, r: r("w") > l("w"), salts=3))
        assert got == want and want
    assert interval_semi_join(left, right.limit(0), ["k"], ["id"]).count() == 0
    assert interval_semi_join(left.limit(0), right, ["k"], ["id"]).count() == 0


def merged(intervals, gap):
    out = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def test_merge(spark, rows):
    r = random.Random(3)
    data = [(r.choice(["a", "b", None]), lo := r.randrange(400), lo + r.choice([0, 1, 5, 30, -1])) for _ in range(300)] + [("a", 10, 20), ("a", 21, 29), ("c", 10, 20), ("c", 20, 30), ("c", None, 3)]
    df = spark.createDataFrame(data, "k string, lo bigint, hi bigint")
    for gap in (0, 1):
        want = []
        for k in {d[0] for d in data}:
            want += [(k, *i) for i in merged([d[1:] for d in data if d[0] == k and d[1] is not None and d[1] <= d[2]], gap)]
        key = lambda x: (x[0] is not None, x)
        assert rows(merge_intervals(df, ["k"], gap, block_bits=4)) == sorted(want, key=key)


def test_running(spark):
    data = [("a", i, (i * 37) % 101) for i in range(0, 300, 3)]
    df = spark.createDataFrame(data, "k string, o bigint, v bigint")
    for how, f, empty in (("max", max, None), ("sum", sum, 0)):
        got = {r.o: r.x for r in running(df, ["k"], "o", F.col("v"), how, "x", block_bits=4).collect()}
        for i, (_, o, _) in enumerate(data):
            assert got[o] == (f(d[2] for d in data[:i]) if i else empty)


def a_listing(seed=5, n=220):
    r = random.Random(seed)
    out = []
    for i in range(n):
        store = r.choice([1, 1, 1, 2, 3])
        rep = r.choice([0, 0, 0, 0, 1, 2, 3])
        lo = r.randrange(1, 300)
        hi = lo if rep == 0 else lo + r.choice([1, 4, 20, 80])
        row = [store, i, hi, lo, rep, int(rep > 0), 3, r.choice([10, 4095, 4096, 9000, None]), "x"]
        if r.random() < 0.1:
            row[r.choice([2, 3, 4, 5])] = None
        out += [tuple(row)] * r.choice([1, 1, 1, 2])
    return [*out, (None, 1, 1, 1, 0, 0, 1, 1, "x"), (1, None, 1, 1, 9, 0, 1, 1, "x"), (4, 900, 3, 5, 0, 0, 1, 1, "x")]


def brute_live(listing):
    units = {u[:2]: u for u in listing if None not in u[:6]}.values()
    return [u for u in units if not any(v[0] == u[0] and v[4] > u[4] and v[3] <= u[2] and u[3] <= v[2] and v[3] <= v[2] and u[3] <= u[2] for v in units)]


def test_live_units(spark, rows):
    listing = a_listing()
    df = spark.createDataFrame(listing, UNITS)
    got = rows(live_units(df).select("store_id", "unit_num"))
    assert got == sorted(u[:2] for u in brute_live(listing))
    assert committed_units(df).count() == len({u[:2] for u in listing if None not in u[:6]})
    assert live_units(df.limit(0)).count() == 0
