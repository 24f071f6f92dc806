"""The queries of the general training-data problems 1 to 5, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import changes, consolidate, eager_aggregation, incremental, live_units, nested
from tidewell.session import shared_dir, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incremental.unhandled_units(spark, table(spark, sf_dir, "consumer_runs"), table(spark, sf_dir, "commit_units"), shared_dir(spark, "p1"))
    return rows.select("store_id", "consumer", "unit_num")


def p1_listing_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units that are new or changed in the whole listing against the state after the rows listed before 2020."""
    units, content = table(spark, sf_dir, "commit_units"), [*live_units.INFO, "n_entries", "n_bytes"]
    state = incremental.IncrementalState(spark, shared_dir(spark, "p1"), ["store_id", "unit_num"])
    cols = ["store_id", "unit_num", *content]
    state.commit(units.filter(F.col("listed_at") < F.lit("2020-01-01").cast("timestamp_ntz")).select(*cols).distinct(), content)
    return state.select(units.select(*cols).distinct(), content).select("store_id", "unit_num", F.col("_change").alias("change"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.tuple_members(table(spark, sf_dir, "nested_values"), fields=False)
    return rows.select("value_id", "parent_path", F.col("position").alias("member_idx"))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member table with its inlined columns."""
    return nested.tuple_members(table(spark, sf_dir, "nested_values"))


#: The output size of the two queries whose SQL names it; ``p3_found`` and ``p3_files`` take the operator's own.
SQL_TARGET = 1 << 20


def _consolidated(spark: SparkSession, sf_dir: str, target_bytes: int = consolidate.TARGET_BYTES) -> consolidate.Consolidated:
    return consolidate.consolidate(table(spark, sf_dir, "commit_units"), table(spark, sf_dir, "unit_entries"), target_bytes)


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records' own table, with the number of members that link to each of them directly."""
    found = nested.tuple_tables(table(spark, sf_dir, "nested_values"))
    direct = found.table(nested.MEMBER).filter("parent_path = ''").groupBy("value_id").agg(F.count(F.lit(1)).alias("n_direct"))
    return found.table(nested.ROOT).select("value_id", "datum_type").join(direct, "value_id", "left").withColumn(
        "n_direct",
        F.coalesce("n_direct", F.lit(0)),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small live units that came out whole."""
    return consolidate.small_inputs(_consolidated(spark, sf_dir))


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each file written: its range of versions and what it holds."""
    done = _consolidated(spark, sf_dir)
    return done.files.select("store_id", "out_num", "part", "commit_ver_lo_incl", "commit_ver_hi_incl", "n_units", "n_entries", "content_bytes")


def p3_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range metadata of the outputs."""
    done = _consolidated(spark, sf_dir, SQL_TARGET)
    return done.ranges.select("store_id", "out_num", "commit_ver_lo_incl", "commit_ver_hi_incl", "replacement_num", "n_units", "n_entries")


def p3_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry of the live units with its output."""
    done = _consolidated(spark, sf_dir, SQL_TARGET)
    return done.entries.select("store_id", "out_num", "unit_num", "seq", "pk_type", "pk", "datum_type")


def _sub_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eager_aggregation.eager_join_aggregate(
        table(spark, sf_dir, "index_rows"), table(spark, sf_dir, "commit_units"), ["store_id", "unit_num"], ["sv_type", "sv"], left_sums={"seq_sum": "seq"}, right_sums={"unit_bytes": "n_bytes"}
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy sub-values by the rows of ``index_rows LEFT JOIN specs``: a row counts once for each spec that it has, so once as delivered.

    The specs' key is spec_id; a spec that is listed twice is one. Rows of an unknown spec have no partner and count as well.
    """
    specs = table(spark, sf_dir, "sv_specs").select("spec_id").distinct()
    figures = eager_aggregation.eager_join_aggregate(table(spark, sf_dir, "index_rows"), specs, ["spec_id"], ["sv_type", "sv"], outer=True)
    return eager_aggregation.heavy_groups(figures, ["sv_type", "sv"], 0.015, "outer_rows").select("sv_type", "sv")


def p4_sub_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sub-value: rows as delivered, rows of the join with the unit listing, and sums of either side over that join."""
    return _sub_values(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.current_entries(table(spark, sf_dir, "unit_entries"), table(spark, sf_dir, "commit_units"))
    return rows.select("store_id", "pk_type", "pk", "unit_num", "seq")


def p5_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current value of each live key."""
    rows = changes.current_entries(table(spark, sf_dir, "unit_entries"), table(spark, sf_dir, "commit_units"), values=True)
    return rows.select("store_id", "pk_type", "pk", "datum_type", "pv")


def queries() -> dict:
    return {
        f.__name__: f for f in (
            p1_found,
            p1_listing_delta,
            p2_found,
            p2_members,
            p2_values,
            p3_found,
            p3_files,
            p3_ranges,
            p3_entries,
            p4_found,
            p4_sub_values,
            p5_found,
            p5_current,
        )
    }


_LIVE = """
committed AS (SELECT DISTINCT store_id, unit_num, commit_ver_lo_incl AS lo, commit_ver_hi_incl AS hi, replacement_num AS rep, n_entries, n_bytes
  FROM commit_units WHERE store_id IS NOT NULL AND unit_num IS NOT NULL AND commit_ver_lo_incl IS NOT NULL AND commit_ver_hi_incl IS NOT NULL AND replacement_num IS NOT NULL AND data_type IS NOT NULL),
live AS (SELECT * FROM committed u WHERE NOT EXISTS (SELECT 1 FROM committed v WHERE v.store_id = u.store_id AND v.rep > u.rep AND v.lo <= u.hi AND u.lo <= v.hi))
"""

_CURRENT = f"""
WITH {_LIVE}, placed AS (SELECT e.store_id, e.pk_type, e.pk, e.unit_num, e.seq, e.datum_type, e.pv,
    row_number() OVER (PARTITION BY e.store_id, e.pk_type, e.pk ORDER BY l.hi DESC, e.seq DESC, e.unit_num DESC, e.datum_type DESC NULLS LAST, e.pv DESC NULLS LAST) AS rn
  FROM unit_entries e JOIN live l ON e.store_id = l.store_id AND e.unit_num = l.unit_num)
"""

_PLAN = f"""
WITH {_LIVE}, plan AS (SELECT *, CAST((sum(coalesce(n_bytes, 0)) OVER (PARTITION BY store_id ORDER BY lo RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(coalesce(n_bytes, 0)) OVER (PARTITION BY store_id, lo)) // 1048576 AS BIGINT) AS out_num FROM live),
once AS (SELECT DISTINCT store_id, unit_num, seq, pk_type, pk, datum_type FROM unit_entries),
came AS (SELECT p.store_id, p.out_num, o.unit_num, o.seq, o.pk_type, o.pk, o.datum_type FROM once o JOIN plan p ON o.store_id = p.store_id AND o.unit_num = p.unit_num)
"""


def _files_sql(target: int) -> str:
    return f"""
WITH {_LIVE}, plan AS (SELECT *, CAST((sum(coalesce(n_bytes, 0)) OVER (PARTITION BY store_id ORDER BY lo RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(coalesce(n_bytes, 0)) OVER (PARTITION BY store_id, lo)) // {target} AS BIGINT) AS out_num FROM live),
parts AS (SELECT *, CAST((sum(coalesce(n_bytes, 0)) OVER (PARTITION BY store_id, out_num ORDER BY lo, unit_num) - coalesce(n_bytes, 0)) // {target} AS BIGINT) AS part FROM plan),
once AS (SELECT DISTINCT store_id, unit_num, seq, pk_key, pk_type, pk, datum_type, pv FROM unit_entries)
SELECT p.store_id, p.out_num, p.part, min(p.lo) AS commit_ver_lo_incl, max(p.hi) AS commit_ver_hi_incl, count(DISTINCT p.unit_num) AS n_units, count(*) AS n_entries,
  CAST(sum(coalesce(octet_length(o.pk_key), 0) + coalesce(strlen(o.pv), 0)) AS BIGINT) AS content_bytes
FROM parts p JOIN once o ON o.store_id = p.store_id AND o.unit_num = p.unit_num WHERE coalesce(p.n_bytes, 0) < {target} GROUP BY 1, 2, 3
"""


_MEMBERS = r"""
WITH RECURSIVE records AS (SELECT DISTINCT value_id, datum_body FROM nested_values WHERE datum_type = 4 AND json_valid(datum_body)),
kids(value_id, parent, i, v) AS (
  SELECT value_id, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), json_object('datum_type', 4, 'datum_body', CAST(datum_body AS JSON)) FROM records
  UNION ALL
  SELECT value_id, parent, m.i, m.v FROM (
    SELECT value_id, path AS parent, unnest(CASE
        WHEN json_type(b) = 'ARRAY' THEN list_transform(range(CAST(json_array_length(b) AS BIGINT)), lambda i: {'i': i, 'v': json_extract(b, '$[' || i || ']')})
        WHEN json_type(b) <> 'OBJECT' THEN [{'i': CAST(0 AS BIGINT), 'v': b}]
        WHEN len(json_keys(b)) = 0 THEN []
        WHEN list_contains(json_keys(b), 'datum_type') OR list_contains(json_keys(b), 'datum_body') OR len(list_filter(json_keys(b), lambda k: regexp_matches(k, '^[0-9]{1,9}$'))) = 0 THEN [{'i': CAST(0 AS BIGINT), 'v': b}]
        ELSE list_transform(list_filter(json_keys(b), lambda k: regexp_matches(k, '^[0-9]{1,9}$')), lambda k: {'i': CAST(k AS BIGINT), 'v': json_extract(b, '$."' || k || '"')}) END) AS m
    FROM (SELECT value_id, path, CASE WHEN json_type(raw) = 'VARCHAR' AND json_valid(raw ->> '$') AND regexp_matches(raw ->> '$', '^\s*[\[{]') THEN CAST(raw ->> '$' AS JSON) ELSE raw END AS b
      FROM (SELECT value_id, CASE WHEN i IS NULL THEN '' WHEN parent = '' THEN CAST(i AS VARCHAR) ELSE parent || '.' || i END AS path, json_extract(v, '$.datum_body') AS raw FROM kids
        WHERE json_type(v) = 'OBJECT' AND json_extract_string(v, '$.datum_type') = '4') WHERE raw IS NOT NULL AND json_type(raw) <> 'NULL')
  ) WHERE json_type(m.v) <> 'NULL')
"""


def oracles() -> dict[str, str]:
    return {
        "p1_found": f"""
WITH RECURSIVE {_LIVE}, done AS (SELECT DISTINCT store_id, consumer, commit_ver_lo_incl AS lo, commit_ver_hi_incl AS hi FROM consumer_runs WHERE status = 'succeeded' AND commit_ver_lo_incl <= commit_ver_hi_incl),
pairs AS (SELECT c.store_id, c.consumer, l.unit_num, unnest(range(l.lo, l.hi + 1)) AS ver FROM live l JOIN (SELECT DISTINCT store_id, consumer FROM consumer_runs) c ON c.store_id = l.store_id)
SELECT DISTINCT store_id, consumer, unit_num FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.store_id = p.store_id AND d.consumer = p.consumer AND p.ver BETWEEN d.lo AND d.hi)
""",
        "p1_listing_delta": """
WITH cols AS (SELECT store_id, unit_num, commit_ver_lo_incl, commit_ver_hi_incl, replacement_num, data_type, n_entries, n_bytes, listed_at FROM commit_units),
state AS (SELECT DISTINCT * EXCLUDE listed_at FROM cols WHERE listed_at < TIMESTAMP '2020-01-01'), now AS (SELECT DISTINCT * EXCLUDE listed_at FROM cols)
SELECT n.store_id, n.unit_num, CASE WHEN EXISTS (SELECT 1 FROM state s WHERE s.store_id = n.store_id AND s.unit_num = n.unit_num) THEN 'changed' ELSE 'new' END AS change
FROM (SELECT * FROM now EXCEPT SELECT * FROM state) n
""",
        "p2_found": f"{_MEMBERS} SELECT value_id, parent AS parent_path, CAST(i AS INTEGER) AS member_idx FROM kids WHERE i IS NOT NULL",
        "p2_members": f"""{_MEMBERS} SELECT value_id, CASE WHEN parent = '' THEN '' ELSE parent || '.' END || i AS path, CASE WHEN parent = '' THEN 'value' ELSE 'member' END AS parent_table, parent AS parent_path, CAST(i AS INTEGER) AS position,
  CASE WHEN json_type(v) = 'ARRAY' THEN NULL WHEN json_type(v) <> 'OBJECT' THEN v ->> '$' WHEN json_extract_string(v, '$.datum_type') = '4' OR json_type(v, '$.datum_body') IN ('OBJECT', 'ARRAY') THEN NULL ELSE json_extract_string(v, '$.datum_body') END AS datum_body,
  json_extract_string(v, '$.datum_type') AS datum_type, json_extract_string(v, '$.members_count') AS members_count, json_extract_string(v, '$.note') AS note, json_extract_string(v, '$.unit') AS unit FROM kids WHERE i IS NOT NULL
""",
        "p2_values": f"{_MEMBERS} SELECT value_id, '4' AS datum_type, (SELECT count(*) FROM kids m WHERE m.value_id = kids.value_id AND m.parent = '') AS n_direct FROM kids WHERE i IS NULL",
        "p3_found": f"WITH {_LIVE} SELECT store_id, unit_num FROM live WHERE n_bytes < 4096",
        "p3_files": _files_sql(consolidate.TARGET_BYTES),
        "p3_ranges": f"""{_PLAN}, n AS (SELECT store_id, out_num, count(*) AS n_entries FROM came GROUP BY 1, 2)
SELECT p.store_id, p.out_num, min(p.lo) AS commit_ver_lo_incl, max(p.hi) AS commit_ver_hi_incl, max(p.rep) + 1 AS replacement_num, count(*) AS n_units, coalesce(max(n.n_entries), 0) AS n_entries
FROM plan p LEFT JOIN n ON n.store_id = p.store_id AND n.out_num = p.out_num GROUP BY 1, 2
""",
        "p3_entries": f"{_PLAN} SELECT * FROM came",
        "p4_found": "SELECT sv_type, sv FROM index_rows GROUP BY 1, 2 HAVING count(*) * 1000000 >= 15000 * (SELECT count(*) FROM index_rows)",
        "p4_sub_values": """
SELECT i.sv_type, i.sv, count(DISTINCT i.rid) AS left_rows, count(u.store_id) AS joined_rows, CAST(sum(CASE WHEN u.store_id IS NOT NULL THEN i.seq END) AS BIGINT) AS seq_sum, CAST(sum(u.n_bytes) AS BIGINT) AS unit_bytes
FROM (SELECT *, row_number() OVER () AS rid FROM index_rows) i LEFT JOIN commit_units u ON u.store_id = i.store_id AND u.unit_num = i.unit_num GROUP BY 1, 2
""",
        "p5_found": f"{_CURRENT} SELECT store_id, pk_type, pk, unit_num, seq FROM placed WHERE rn = 1 AND datum_type IS DISTINCT FROM 0",
        "p5_current": f"{_CURRENT} SELECT store_id, pk_type, pk, datum_type, pv FROM placed WHERE rn = 1 AND datum_type IS DISTINCT FROM 0",
    }
