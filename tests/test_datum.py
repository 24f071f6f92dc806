import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import datum as D
from tidewell.functions.keys import between, key_of, sub_key
from tidewell.spec import SubValueSpec

leaf = st.one_of(st.integers(-(2**63), 2**63 - 1), st.binary(max_size=6), st.text(max_size=6).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)))
datums = st.recursive(leaf, lambda x: st.lists(x, max_size=4).map(tuple), max_leaves=10)


def rank(d):
    tag = D.type_of(d)
    return (tag, [rank(m) for m in d] if tag == D.TUPLE else d.encode() if tag == D.STR else d)


@settings(max_examples=300, deadline=None)
@given(datums, datums, datums)
def test_key_order_and_round_trip(a, b, c):
    assert (D.encode_key(a) < D.encode_key(b)) == (rank(a) < rank(b))
    assert D.decode_key(D.encode_key(a)) == a
    left, right = D.encode_key(a) + D.encode_key(c), D.encode_key(b) + D.encode_key(c)
    assert (left < right) == ((rank(a), rank(c)) < (rank(b), rank(c)))


@settings(max_examples=300, deadline=None)
@given(datums, st.lists(st.integers(0, 3), max_size=3), st.sampled_from([D.I64, D.BYTES, D.STR, D.TUPLE]))
def test_slice_is_extract(d, path, tag):
    want = SubValueSpec(tuple(path), tag).extract(d)
    got = D.slice_key(D.encode_key(d), path, tag)
    assert (None if got is None else D.decode_key(got)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), datums), max_size=5))
def test_file_form(ds):
    data, at = b"".join(map(D.serialize, ds)), 0
    for d in ds:
        got, at = D.deserialize(data, at)
        assert got == d
    assert at == len(data)


def test_file_form_bytes():
    assert D.serialize(("a", (1,))) == bytes.fromhex("04" "18000000" "02000000" "03" "01000000" "61" "04" "01000000" "01" "0100000000000000")
    assert D.serialize(5) == b"\x01\x05" + bytes(7)
    assert D.serialize(None) == b"\x00"


def test_spec():
    spec = SubValueSpec((1, 2), D.STR)
    assert spec.text() == "3;1,2," and SubValueSpec.parse("3;1,2,") == spec
    assert SubValueSpec.whole(D.I64).text() == "1;"
    assert spec.extract((0, (0, 0, "x"))) == "x"
    for v in ("x", (0,), (0, (1,)), (0, (0, 0, 1)), (0, 5)):
        assert spec.extract(v) is None


def test_column_keys(spark):
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("s", T.StringType()), T.StructField("b", T.BinaryType()), T.StructField("t", T.StructType([T.StructField("_0", T.LongType()), T.StructField("_1", T.StructType([T.StructField("_0", T.StringType())]))]))])
    random.seed(1)
    data = [(random.choice([0, -1, 2**63 - 1, -(2**63), 7]), random.choice(["", "a", "a\0b", "ü\0", "\0"]), random.choice([b"", b"\0", b"\1\0\0", b"xy\0"]), (k, ("\0z",))) for k in range(30)]
    df = spark.createDataFrame(data, schema)
    out = df.select(*[key_of(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields]).collect()
    for row, got in zip(data, out):
        assert [bytes(x) for x in got] == [D.encode_key(x) for x in row]
    null = spark.createDataFrame([(None, None, None, None)], schema)
    assert list(null.select(*[key_of(F.col(f.name), f.dataType) for f in schema.fields]).first()) == [None] * 4


def test_sub_key_and_between(spark):
    values = [1, "x", (1, "a"), (1, ("b", 2)), b"", ()]
    df = spark.createDataFrame([(bytearray(D.encode_key(v)),) for v in values] + [(None,)], "k binary")
    got = [None if r[0] is None else D.decode_key(bytes(r[0])) for r in df.select(sub_key(F.col("k"), (1, 0), D.STR)).collect()]
    assert got == [None, None, None, "b", None, None, None]
    assert df.filter(between(F.col("k"), 1, "x")).count() == 3
    assert df.filter(between(F.col("k"), "x", 1)).count() == 0
