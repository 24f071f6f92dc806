import pytest

from tidewell import datum as D
from tidewell.plans.dsl import CreateIndex, DeleteIndex, GetPK, GetSV, ParseError, Put, parse
from tidewell.spec import SubValueSpec as S


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("put int(100) str(1000)", Put(100, "1000")),
        ("del int(100)", Put(100, None)),
        ("get int(100)", GetPK(100, 100, True)),
        ("put int(7150) tup( str(t7150) tup( int(64) str(t64) ) int(64) )", Put(7150, ("t7150", (64, "t64"), 64))),
        ("get tup( )", GetPK((), (), True)),
        ("get between int(50) str(pier9)", GetPK(50, "pier9")),
        ("get between _ str(pier9)", GetPK(None, "pier9")),
        ("get between _ _", GetPK(None, None)),
        ("create index svspec(1 0 int)", CreateIndex(S((1, 0), D.I64))),
        ("delete index svspec(str)", DeleteIndex(S((), D.STR))),
        ("get where svspec(int) int(1000)", GetSV(S((), D.I64), 1000, 1000)),
        ("get where svspec(0 str) between str(a) _", GetSV(S((0,), D.STR), "a", None)),
        ("get where svspec(1 0 int) _", GetSV(S((1, 0), D.I64), None, None)),
        ("get str(_)", GetPK("_", "_", True)),
        ("get str( @ )", GetPK("@", "@", True)),
        ("get str( ) )", GetPK(")", ")", True)),
        # beyond the plain form
        ("get int(-5)", GetPK(-5, -5, True)),
        ("get tup(str(a) int(1))", GetPK(("a", 1), ("a", 1), True)),
        ("get str('a b.c \\' _')", GetPK("a b.c ' _", "a b.c ' _", True)),
        ('get str("")', GetPK("", "", True)),
        ("get bytes(00ff)", GetPK(b"\x00\xff", b"\x00\xff", True)),
        ("get bytes()", GetPK(b"", b"", True)),
        ("create index svspec(0 tup)", CreateIndex(S((0,), D.TUPLE))),
    ],
)
def test_parse(text, want):
    assert parse(text) == want


@pytest.mark.parametrize("text", ["", "get", "put int(1)", "get int(x)", "get int(9223372036854775808)", "get int(1) int(2)", "get where svspec(int)", "create svspec(int)", "get str()", "get tup( int(1)", "drop index svspec(int)", "get 'x'"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse(text)
