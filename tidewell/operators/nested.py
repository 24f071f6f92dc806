"""Deeply nested records to related flat tables (problem 2): shared inlining.

An element is what stands under one name: the root, an object's field, a list's item (named as the list). The graph has an edge
from element to element with a mark whether the child is repeated. Elements that are repeated, that have several parents or
that lie on a cycle get a table of their own; every other one is inlined as a column of the nearest element with a table.
Each row of a table has the record's key, its own path, its parent's path (the foreign key), the parent's table and its position.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.json_tree import members, parse
from tidewell.session import spread, written

TUPLE = 4
ROOT, MEMBER = "value", "member"
#: Pairs of element names that the driver takes at most. Records that are keyed by data exceed it, and that is an error.
MAX_EDGES = 100_000
#: The column of an element that is a bare scalar.
OWN = "_value"

#: A walker lists the children of a node: (element name, position or None for a single one, node).
Walker = Callable[[str, object], Iterator[tuple[str, int | None, object]]]


def json_children(name: str, node) -> Iterator[tuple[str, int | None, object]]:
    """Plain JSON: an object's fields are single children, a list's items repeated children under the list's name."""
    if isinstance(node, dict):
        for k, v in node.items():
            if isinstance(v, list):
                for i, item in enumerate(v):
                    if item is not None:
                        yield k, i, item
            elif v is not None:
                yield k, None, v
    elif isinstance(node, list):
        for i, item in enumerate(node):
            if item is not None:
                yield name, i, item


def datum_children(name: str, node) -> Iterator[tuple[str, int | None, object]]:
    """Datums: a tuple's body holds repeated ``member`` children in any encoding; every other field, and all below it, is plain JSON.

    A list or object as the body of another type is wrong and has no children, nor has a member that is a bare list.
    """
    if name not in (ROOT, MEMBER):
        yield from json_children(name, node)
        return
    if not isinstance(node, dict):
        return
    is_tuple = str(node.get("datum_type")) == str(TUPLE)
    for k, v in node.items():
        if k == "datum_body" and is_tuple:
            for i, m in members(v):
                yield MEMBER, i, m
        elif k == "datum_body" and isinstance(v, (list, dict)):
            continue
        else:
            yield from json_children(name, {k: v})


@dataclass
class InlinePlan:
    tables: set[str]
    columns: dict[str, list[str]] = field(default_factory=dict)
    inner: set[str] = field(default_factory=set)  # elements that have children


def inline_plan(edges: set[tuple[str, str, bool]], root: str = ROOT) -> InlinePlan:
    """Which elements get tables, and the inlined columns of each (dotted where an inlined element has children)."""
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    for a, b, _ in edges:
        parents.setdefault(b, set()).add(a)
        children.setdefault(a, set()).add(b)
    tables = {root} | {b for _, b, many in edges if many}
    leaves = {b for _, b, _ in edges if not children.get(b)}
    tables |= {b for b, p in parents.items() if len(p) > 1 and b not in leaves}  # a shared leaf is a column of each parent
    for start in children:  # elements on a cycle
        seen, todo = set(), [*children[start]]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += children.get(x, ())
        if start in seen:
            tables.add(start)
    plan = InlinePlan(tables, inner={a for a, _, _ in edges})
    for t in sorted(tables):
        out, todo = [], [(c, c) for c in sorted(children.get(t, ()))]
        while todo:
            name, path = todo.pop(0)
            if name in tables:
                continue
            out.append(path)
            todo += [(c, f"{path}.{c}") for c in sorted(children.get(name, ()))]
        plan.columns[t] = out
    return plan


def _text(node) -> str | None:
    if node is None or isinstance(node, (dict, list)):
        return None
    if isinstance(node, bool):
        return "true" if node else "false"
    return str(node).encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def _trees(batch: pa.RecordBatch, text: str, wrap: Callable | None) -> Iterator[tuple[int, object]]:
    for i, s in enumerate(batch.column(text).to_pylist()):
        if s is not None:
            try:
                node = parse(s)
            except ValueError:
                continue
            yield i, wrap(node) if wrap else node


_COLUMNS = "table string, path string, parent_table string, parent_path string, position int, fields map<string,string>"


def _step(name: str, at: int | None, plain: str | None) -> str:
    if name == plain and at is not None:
        return str(at)
    safe = name.replace("%", "%25").replace(".", "%2E").replace(":", "%3A")
    return f"{safe}:{'' if at is None else at}"


def elements(
    df: DataFrame,
    keys: list[str],
    text: str,
    walker: Walker = json_children,
    wrap: Callable | None = None,
    root: str = ROOT,
    plain: str | None = None,
    own: str = OWN,
    fields: bool = True,
) -> DataFrame:
    """Every element of every record in one pass: keys, ``table`` (its name), ``path``, ``parent_table``, ``parent_path``, ``position``, ``fields``.

    An element is the root, an item of a list, or an object; scalars that stand alone under a name are ``fields`` (a map) of the element that
    holds them, and an item that is a scalar itself has it under ``own``. Paths are the steps from the root joined by ``.``: a position for
    the element named ``plain``, else the name (with % . : escaped), ``:`` and the position, if it has one. A record that is not complete JSON,
    is null or blank gives no rows. Key columns may not have the names of the result's own columns (ValueError); other columns are not read.
    """
    if clash := {k.lower() for k in keys} & {"table", "path", "parent_table", "parent_path", "position", "fields"}:
        raise ValueError(f"key columns named like the result's own: {sorted(clash)}")
    schema = df.select(*keys).schema
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()))
    names = ("table", "path", "parent_table", "parent_path", "position", "fields")

    def rows(batches):
        for batch in batches:
            source, cols = [], ([], [], [], [], [], [])
            c_table, c_path, c_above, c_above_path, c_at, c_fields = (c.append for c in cols)
            for i, tree in _trees(batch, text, wrap):
                todo = [(root, "", None, None, None, tree)]
                while todo:
                    name, path, above, above_path, at, node = todo.pop()
                    values: dict[str, str] = {}
                    if isinstance(node, (dict, list)):
                        for child, pos, below in walker(name, node):
                            if pos is not None or isinstance(below, (dict, list)):
                                step = _step(child, pos, plain)
                                todo.append((child, f"{path}.{step}" if path else step, name, path, pos, below))
                            elif fields:
                                values[child] = _text(below)
                    elif fields and node is not None:
                        values[own] = _text(node)
                    source.append(i)
                    c_table(name)
                    c_path(path)
                    c_above(above)
                    c_above_path(above_path)
                    c_at(at)
                    c_fields(list(values.items()) if fields else None)
            out = [batch.column(k).take(pa.array(source, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays(out + [pa.array(c, t) for c, t in zip(cols, kinds)], [*keys, *names])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema], _COLUMNS])
    return df.select(*dict.fromkeys([*keys, text])).mapInArrow(rows, ddl)


def graph_of(rows: DataFrame) -> set[tuple[str, str, bool]]:
    """The edges (parent, child, repeated) of ``elements`` rows: one row for each pair of names goes to the driver, MAX_EDGES at most."""
    inner = rows.filter(F.col("parent_table").isNotNull()).select("parent_table", "table", F.col("position").isNotNull())
    leaves = rows.select("table", F.explode(F.map_keys("fields")), F.lit(False))
    found = {tuple(r) for r in inner.unionAll(leaves).distinct().limit(MAX_EDGES + 1).collect()}
    if len(found) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} pairs of element names: the records are keyed by data")
    return found


def schema_graph(
    df: DataFrame,
    text: str,
    walker: Walker = json_children,
    wrap: Callable | None = None,
    root: str = ROOT,
) -> set[tuple[str, str, bool]]:
    """The edges (parent, child, repeated) that occur in any record."""
    return graph_of(elements(df, [], text, walker, wrap, root))


def inline(rows: DataFrame, keys: list[str], plan: InlinePlan, root: str = ROOT, plain: str | None = None) -> DataFrame:
    """The rows of ``elements`` as the plan has them: those of elements with a table, with the fields of all that is inlined into them.

    An inlined element's fields go to the nearest element above it with a table, under its dotted name; what hangs below an inlined
    element hangs below that one.
    """
    inlined = sorted({p.split(".")[-1] for cols in plan.columns.values() for p in cols} - plan.tables)
    inner = [c for c in inlined if c in plan.inner]
    if not inner:
        return rows.filter(F.col("table").isin(*sorted(plan.tables)))
    tail = "(?:(?:^|\\.)(?:" + "|".join(re.escape(_step(c, None, None)) for c in inner) + "))+$"
    last = F.regexp_extract(F.col("_owner"), "([^.:]*):[^.]*$", 1)
    name_of = lambda path: F.when(path == "", F.lit(root)).when(last != "", _unescaped(last)).otherwise(F.lit(plain))
    mine = rows.filter(F.col("table").isin(*sorted(plan.tables))).withColumn("_owner", F.regexp_replace("parent_path", tail, ""))
    mine = mine.withColumn(
        "parent_table",
        F.when(F.col("parent_path").isNotNull(), name_of(F.col("_owner"))),
    ).withColumn("parent_path", F.col("_owner")).drop("_owner")
    below = rows.filter(F.col("table").isin(*inner)).withColumn("_owner", F.regexp_replace("path", tail, ""))
    steps = F.expr("ltrim('.', substring(path, length(_owner) + 1))")
    prefix = F.concat(_unescaped(F.replace(steps, F.lit(":"), F.lit(""))), F.lit("."))
    below = below.withColumn("_prefix", prefix).withColumn("path", F.col("_owner"))
    below = below.select(*keys, "path", F.transform_keys("fields", lambda k, _: F.concat(F.col("_prefix"), k)).alias("fields"))
    parts = mine.select(*keys, "path", F.explode_outer(F.map_entries("fields")).alias("_e")).unionByName(
        below.select(*keys, "path", F.explode(F.map_entries("fields")).alias("_e"))
    )
    gathered = parts.groupBy(*keys, "path").agg(F.map_from_entries(F.collect_set(F.when(F.col("_e").isNotNull(), F.col("_e")))).alias("_all"))
    same = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (*keys, "path")])
    return mine.alias("x").join(gathered.alias("y"), same, "left").select(
        *[F.col(f"x.{c}").alias(c) for c in rows.columns if c != "fields"],
        F.col("y._all").alias("fields"),
    )


def _unescaped(column):
    for code, char in (("%2E", "."), ("%3A", ":"), ("%25", "%")):
        column = F.replace(column, F.lit(code), F.lit(char))
    return column


def shred(
    df: DataFrame,
    keys: list[str],
    text: str,
    plan: InlinePlan,
    walker: Walker = json_children,
    wrap: Callable | None = None,
    root: str = ROOT,
) -> DataFrame:
    """All tables' rows of the plan, from one more pass over the texts; see ``elements`` and ``inline``."""
    return inline(elements(df, keys, text, walker, wrap, root), keys, plan, root)


def table_of(rows: DataFrame, plan: InlinePlan, table: str, keys: list[str]) -> DataFrame:
    """One flat table of the shredded rows, with a text column for each inlined element."""
    cols = [F.col("fields")[c].alias(c.replace(".", "_")) for c in plan.columns.get(table, [])]
    return rows.filter(F.col("table") == table).select(*keys, "path", "parent_table", "parent_path", "position", *cols)


def tuple_records(values: DataFrame) -> DataFrame:
    """The distinct records of type Tuple: (value_id, datum_body). Repeats go; records without a body have no members."""
    return values.filter((F.col("datum_type") == TUPLE) & F.col("datum_body").isNotNull()).select("value_id", "datum_body").distinct()


def as_tuple(body) -> dict:
    return {"datum_type": TUPLE, "datum_body": body}


@dataclass
class Tables:
    """The flat tables of a set of records: ``rows`` of all tables and the plan that made them."""

    rows: DataFrame
    plan: InlinePlan
    keys: list[str]

    def table(self, name: str) -> DataFrame:
        """One table; without rows if the records have no such element."""
        return table_of(self.rows, self.plan, name, self.keys)


def tuple_tables(values: DataFrame, fields: bool = True) -> Tables:
    """All Tuple records as flat tables by shared inlining: ``value`` for the records, ``member`` for members at any depth, linked by paths.

    One pass parses each different record once and writes its elements as a table in the shared folder; the schema graph is taken from
    these rows and decides which elements are tables (repeated, shared or recursive ones) and which are columns of others.
    ``fields=False`` leaves the columns out.
    """
    rows = written(
        elements(spread(tuple_records(values)), ["value_id"], "datum_body", datum_children, as_tuple, plain=MEMBER, own="datum_body", fields=fields),
        "elements",
    )
    plan = inline_plan(graph_of(rows))
    return Tables(inline(rows, ["value_id"], plan, plain=MEMBER), plan, ["value_id"])


def tuple_members(values: DataFrame, fields: bool = True) -> DataFrame:
    """The member table of all Tuple records, at any depth.

    Columns: value_id, path, parent_table, parent_path, position and, with ``fields``, the inlined columns as text (datum_type, datum_body,
    members_count and other optional fields; those of an object under its name and theirs, joined by ``_``). An optional list has a table of its
    own. members_count decides nothing; a null member has no row and shifts no other.
    """
    found = tuple_tables(values, fields)
    return found.table(MEMBER) if fields else found.rows.filter(F.col("table") == MEMBER).select("value_id", "path", "parent_path", "position")
