import threading
import urllib.error
import urllib.request

import pytest

from tidewell import datum as D
from tidewell.operators.entries import current
from tidewell.server import respond, serve
from tidewell.session import shared_dir
from tidewell.sources.unit_dirs import dump_catalog, list_units, parse_catalog, read_units
from tidewell.spec import SubValueSpec as S
from tidewell.store import Store


@pytest.mark.parametrize("serial", [False, True])
def test_script(spark, serial):
    store = Store(spark, shared_dir(spark, "http"), serial=serial)
    ask = lambda method, path, body="": respond(store, method, path, body)
    query = lambda text: respond(store, "POST", "/query", text)[0]
    assert ask("PUT", "/key/quay", "crate") == (204, "")
    assert ask("GET", "/key/quay") == (200, 'Key:\r\nStr("quay")\r\nValue:\r\nStr("crate")\r\n')
    assert ask("DELETE", "/key/quay")[0] == 204 and ask("GET", "/key/quay")[0] == 404
    assert query("put int(100) int(1000)") == 204 and query("get int(100)") == 200 and query("get int(102)") == 404
    assert query("put int(7150) tup( str(t7150) tup( int(64) str(t64) ) int(64) )") == 204
    assert query("get between int(7150) str(quayz)") == 200 and query("get between int(7200) _") == 204
    assert query("get where svspec(int) _") == 500 and query("nonsense") == 500
    assert query("delete index svspec(int)") == 204 and query("create index svspec(int)") == 204
    assert query("create index svspec(int)") == (204 if serial else 304)
    assert query("get where svspec(int) int(1000)") == 200 and query("get where svspec(int) between _ int(5)") == 204
    assert ask("POST", "/wasm")[0] == 501 and ask("GET", "/other")[0] == 404


def test_socket(spark):
    server = serve(Store(spark, shared_dir(spark, "http")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/key/a%20b"
    assert urllib.request.urlopen(urllib.request.Request(url, b"x", method="PUT")).status == 204
    assert 'Str("a b")' in urllib.request.urlopen(url).read().decode()
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(url + "c")
    server.shutdown()


def test_unit_dirs(spark, tmp_path):
    def unit(num, info, *pairs):
        (d := tmp_path / f"{num:016x}").mkdir()
        (d / "pi.kv").write_bytes(b"".join(D.serialize(k) + D.serialize(v) for k, v in pairs))
        (d / "si-0000000000000001.kv").write_bytes(D.serialize(7) + D.serialize(7))
        if info is not None:
            (d / "commit_info.txt").write_text(info)

    unit(1, "1,1,0,0", (1, "old"), (2, "b"), (2, "c"))
    unit(2, "2,2,0,0", (1, None))
    unit(10, "3,3,0,0", ("x", (1, "y")))
    unit(11, "2,1,1,1", (2, "c"))  # replaces units 1 and 2
    unit(12, None, (9, 9))
    unit(13, "4,4", (9, 9))
    listed = {r.unit_num: r for r in list_units(spark, str(tmp_path)).collect()}
    assert set(listed) == {1, 2, 10, 11, 12, 13} and listed[11].commit_ver_lo_incl == 1 and listed[13].replacement_num is None
    live = current(read_units(spark, str(tmp_path)).withColumnRenamed("pv_key", "pv"), ["pk_key"], ["commit_ver", "seq"])
    assert {D.decode_key(bytes(r.pk_key)): D.decode_key(bytes(r.pv)) for r in live.collect()} == {2: "c", "x": (1, "y")}


def test_units_are_listed_by_tasks(spark, tmp_path):
    for num in range(25):
        (d := tmp_path / f"{num:016x}").mkdir()
        (d / "pi.kv").write_bytes(b"x" * num)
    (d / "commit_info.txt").write_text("1,2,3,0")
    (tmp_path / f"{99:016x}").mkdir()  # no entry file
    (tmp_path / "scnd_idxs").mkdir()
    found = list_units(spark, str(tmp_path))
    assert found.inputFiles() == []  # the driver holds no file of the folder
    assert sorted((r.unit_num, r.n_bytes, r.data_type) for r in found.collect()) == [(n, n, 0 if n == 24 else None) for n in range(25)]
    (tmp_path / f"{7:016x}" / "commit_info.txt").write_bytes(b"9,8,\xff,1")
    assert [tuple(r)[2:6] for r in found.filter("unit_num = 7").collect()] == [(9, 8, None, 1)]

    from tidewell.sources.unit_dirs import remove_units

    remove_units(spark.createDataFrame([(n,) for n in (3, 4, 500)], "unit_num bigint"), str(tmp_path))
    assert {r.unit_num for r in found.collect()} == {*range(25)} - {3, 4}
    empty = tmp_path / "empty"
    empty.mkdir()
    assert list_units(spark, str(empty)).count() == 0


def test_units_listed_in_parts(spark, tmp_path, monkeypatch):
    from tidewell.plans import txn_queries

    fields = "store_id bigint, unit_num bigint, commit_ver_hi_incl bigint, commit_ver_lo_incl bigint, replacement_num bigint, data_type int"
    units = [(s, u, u + 1, u, u % 3, s % 2) for s in (1, 2) for u in range(20)]
    torn = [(1, 50, None, 1, 0, 0), (None, 51, 1, 1, 0, 0)]
    spark.createDataFrame(units + torn + units[:9], fields).write.parquet(str(tmp_path / "commit_units.parquet"))
    spark.createDataFrame([], fields).write.parquet(str(tmp_path / "none" / "commit_units.parquet"))
    standing, listed = [], txn_queries.list_units

    def watched(spark, root):
        standing.append(len(list(tmp_path.glob("units/*/pi.kv"))))
        return listed(spark, root)

    monkeypatch.setattr(txn_queries, "shared_dir", lambda spark, label: f"file://{tmp_path}/{label}")
    monkeypatch.setattr(txn_queries, "list_units", watched)
    monkeypatch.setattr(txn_queries, "UNITS_AT_ONCE", 7, raising=False)
    got = txn_queries.units_listed(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(units)
    assert len(standing) == 8 and sum(standing) == 40 and max(standing) < 40  # 51 rows of the table
    assert not list(tmp_path.glob("units/*"))
    monkeypatch.setattr(txn_queries, "shared_dir", lambda spark, label: f"file://{tmp_path}/none/{label}")
    assert txn_queries.units_listed(spark, str(tmp_path / "none")).count() == 0


def test_catalog():
    indexes = {S((1, 2), D.STR): (4, True), S((), D.I64): (5, False)}
    assert parse_catalog(dump_catalog(6, indexes)) == (6, indexes)
    assert parse_catalog("1\n") == (1, {})
    for bad in ("", "1\n3;\nx,Q\n"):
        with pytest.raises(ValueError):
            parse_catalog(bad)


def test_units_with_indexes(spark, tmp_path, rows):
    from pyspark.sql import functions as F

    from tidewell.sources.unit_dirs import read_index_units, write_units

    key = lambda d: None if d is None else bytearray(D.encode_key(d))
    log = [(1, 7, "old"), (1, "x", (4, "y")), (2, 7, None), (3, 8, "left out")]
    index = [(1, (4, "y"), "x", (4, "y")), (2, "old", 7, None)]
    info = [(1, 1, 1, 0, 0), (2, 2, 2, 0, 0), (3, 1, 1, 0, 0), (4, 3, 3, 1, 1)]
    frame = lambda data, n, names: spark.createDataFrame([(r[0], *map(key, r[1:])) for r in data], "unit_num bigint, " + ", ".join(f"{c} binary" for c in names))
    units = spark.createDataFrame(info[:2] + info[3:], "unit_num bigint, commit_ver_hi_incl bigint, commit_ver_lo_incl bigint, replacement_num bigint, data_type int")
    root = str(tmp_path / "units")
    write_units(frame(log, 3, ["pk_key", "pv_key"]), units, root, {5: frame(index, 4, ["sv_key", "pk_key", "pv_key"])})
    plain = lambda df: sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect())
    got = plain(read_units(spark, root).select("commit_ver", "pk_key", F.coalesce("pv_key", F.lit(b"-"))))
    assert got == sorted((u, D.encode_key(k), b"-" if v is None else D.encode_key(v)) for u, k, v in log[:3])
    got = plain(read_index_units(spark, root, 5).select("commit_ver", "sv_key", "pk_key", F.coalesce("pv_key", F.lit(b"-"))))
    assert got == sorted((u, D.encode_key(s), D.encode_key(k), b"-" if v is None else D.encode_key(v)) for u, s, k, v in index)
    assert read_index_units(spark, root, 6).count() == 0
    assert (tmp_path / "units" / f"{4:016x}" / "commit_info.txt").read_text() == "3,3,1,1" and not (tmp_path / "units" / f"{3:016x}" / "commit_info.txt").exists()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = spark.read.format("kv").option("pushdown", "true").option("pattern", "*/pi.kv").load(root).filter((F.col("pk_key") >= F.lit(D.encode_key(8))) & (F.col("pk_key") < F.lit(D.encode_key("x"))))
        assert [bytes(r.pk_key) for r in one.collect()] == [D.encode_key(8)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_entries_in_pieces():
    import io

    from tidewell.sources import kv

    data = [(i, "v" * (i * 7)) for i in range(60)]
    raw = b"".join(D.serialize(k) + D.serialize(v) for k, v in data)
    old, kv.PIECE = kv.PIECE, 5
    try:
        assert list(kv.read_entries(io.BytesIO(raw), 2)) == data
        with pytest.raises(ValueError, match="ends inside"):
            list(kv.read_entries(io.BytesIO(raw[:-1]), 2))
        with pytest.raises(ValueError, match="ends inside"):
            list(kv.read_entries(io.BytesIO(D.serialize(1)), 2))
    finally:
        kv.PIECE = old
