"""Order-preserving binary keys as column expressions, from built-in functions only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import datum as D


def key_of(column: Column, kind: T.DataType) -> Column:
    """The key of a typed column: long, binary, string, or a struct of these. Null if the datum or any member is null."""
    if isinstance(kind, T.LongType):
        flipped = column.bitwiseXOR(F.lit(-(2**63)).cast("long"))
        return F.concat(F.lit(b"\x01"), F.unhex(F.lpad(F.hex(flipped), 16, "0")))
    if isinstance(kind, T.StringType):
        escaped = F.replace(column, F.lit("\x00"), F.lit("\x00\x01"))
        return F.concat(F.lit(b"\x03"), F.encode(escaped, "UTF-8"), F.lit(b"\x00\x00"))
    if isinstance(kind, T.BinaryType):
        escaped = F.unhex(F.regexp_replace(F.hex(column), r"\G((?:..)*?)00", "$10001"))
        return F.concat(F.lit(b"\x02"), escaped, F.lit(b"\x00\x00"))
    if isinstance(kind, T.StructType):
        members = [key_of(column.getField(f.name), f.dataType) for f in kind.fields]
        return F.concat(F.lit(b"\x04"), *members, F.lit(b"\x00"))
    raise TypeError(f"not in the value model: {kind.simpleString()}")


def literal_key(d: D.Datum) -> Column:
    return F.lit(D.encode_key(d))


def between(key: Column, lo: D.Datum | None, hi: D.Datum | None) -> Column:
    """lo <= key <= hi in the order of datums, over all types; None is no bound. A lo above hi gives nothing."""
    test = F.lit(True)
    if lo is not None:
        test = key >= literal_key(lo)
    if hi is not None:
        test = (key <= literal_key(hi)) if lo is None else test & (key <= literal_key(hi))
    return test


def sub_key(column: Column, path: tuple[int, ...], tag: int) -> Column:
    """The key of the sub-value of an encoded value, null where it has none of that type.

    The whole value and a first member that is no tuple are cut with built-in functions; other members in Arrow batches in Python.
    Only for stores whose values have no common schema; a typed store resolves its specs to plain columns.
    """

    @F.pandas_udf("binary")
    def cut(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else D.slice_key(bytes(k), path, tag))

    if not path:
        return F.when(F.substring(column, 1, 1) == F.lit(bytes([tag])), column)
    if path == (0,) and tag in (D.I64, D.STR, D.BYTES):
        here = F.substring(column, 1, 2) == F.lit(bytes([D.TUPLE, tag]))
        if tag == D.I64:
            return F.when(here, F.substring(column, 2, 9))
        # Zero bytes inside are followed by 01, so the first two in a row are the end; one character stands for a byte here.
        end = F.instr(F.decode(column, "ISO-8859-1"), "\x00\x00")
        return F.when(here, F.substr(column, F.lit(2), end))
    return cut(column)
