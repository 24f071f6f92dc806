"""Sub-value specifications: a path of tuple positions and the type expected there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import datum as D


@dataclass(frozen=True)
class SubValueSpec:
    """An empty path is the whole value. The type must match exactly; where path or type don't fit, there is no sub-value."""

    member_idxs: tuple[int, ...]
    datum_type: int

    @staticmethod
    def whole(datum_type: int) -> SubValueSpec:
        return SubValueSpec((), datum_type)

    def text(self) -> str:
        return f"{self.datum_type};" + "".join(f"{i}," for i in self.member_idxs)

    @staticmethod
    def parse(text: str) -> SubValueSpec:
        kind, _, path = text.partition(";")
        if int(kind) not in D.TYPE_NAMES.values():
            raise ValueError(f"no such type: {kind}")
        return SubValueSpec(tuple(int(x) for x in path.split(",") if x), int(kind))

    def extract(self, value: D.Datum) -> D.Datum | None:
        for i in self.member_idxs:
            if not isinstance(value, tuple) or i >= len(value):
                return None
            value = value[i]
        return value if D.type_of(value) == self.datum_type else None

    def resolve(self, column: Column, kind: T.DataType) -> tuple[Column, T.DataType] | None:
        """The sub-value as a column of a typed value, or None if no value of that schema has it.

        Plain field access: Catalyst prunes the other columns and pushes comparisons into the scan.
        """
        for i in self.member_idxs:
            if not isinstance(kind, T.StructType) or i >= len(kind.fields):
                return None
            column, kind = column.getField(kind.fields[i].name), kind.fields[i].dataType
        expected = {D.I64: T.LongType, D.BYTES: T.BinaryType, D.STR: T.StringType, D.TUPLE: T.StructType}[self.datum_type]
        return (column, kind) if isinstance(kind, expected) else None
