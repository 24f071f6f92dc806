"""The entry file format (key, value, key, value, ...) as a Spark data source, ``format("kv")``.

    spark.dataSource.register(KvDataSource)
    spark.read.format("kv").load("folder or file")           # pk_key, pv_key (null: tombstone), file (below the folder, at any depth), seq
    spark.read.format("kv").option("kind", "index").load(..)  # sv_key, pk_key, pv_key, file, seq: index files hold sub-value, key, value
    df.select("pk_key", "pv_key").write.format("kv").mode("append").save("folder")

One task reads one file, in order and in pieces; a file that ends inside a datum is an error. Keys and values come in encoded form. The option
``pattern`` takes a glob of the files' paths below the folder ("*/pi.kv"), by default all ``*.kv``. With the option ``pushdown`` bounds on the leading
key (``>``, ``>=``, ``<``, ``<=``, ``=``) are taken over from filters, and entries outside are not made into rows; the session must have
spark.sql.python.filterPushdown.enabled then. Paths are those of local and mounted file systems and of all that pyarrow knows by URI (``hdfs://``, ``s3://``), on every executor.
"""

from __future__ import annotations

import fnmatch
import struct
import uuid
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tidewell import datum as D

PIECE = 1 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" not in path:
        path = "/" + path.removeprefix("file:").lstrip("/")
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def read_entries(stream, width: int) -> Iterator[tuple]:
    """Entries of ``width`` datums each from a binary stream; the whole file is never in memory."""
    data, at, ended = b"", 0, False
    while True:
        try:
            entry, end = [], at
            if end < len(data):
                for _ in range(width):
                    d, end = D.deserialize(data, end)
                    entry.append(d)
            elif ended:
                return
            else:
                raise IndexError
        except (IndexError, struct.error, D.Torn):
            if ended:
                raise ValueError("the file ends inside a datum") from None
            more = stream.read(max(PIECE, len(data) - at))
            ended = not more
            data, at = data[at:] + more, 0
            continue
        yield tuple(entry)
        at = end


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str, index: bool, pattern: str | None):
        self.path, self.index, self.pattern, self.tests = path, index, pattern, []

    def _wanted(self, key: bytes) -> bool:
        for kind, bound in self.tests:
            if not {
                "EqualTo": key == bound,
                "GreaterThan": key > bound,
                "GreaterThanOrEqual": key >= bound,
                "LessThan": key < bound,
                "LessThanOrEqual": key <= bound,
            }[kind]:
                return False
        return True

    def partitions(self):
        system, top = file_system(self.path)
        info = system.get_file_info(top)
        if info.type == pafs.FileType.File:
            return [_File(top)]
        found = [f.path for f in system.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File]
        named = [(f, self._name(f, top)) for f in found if f.endswith(".kv") and not f.rsplit("/", 1)[-1].startswith(".")]
        return [_File(f) for f, name in sorted(named) if self.pattern is None or fnmatch.fnmatch(name, self.pattern)]

    @staticmethod
    def _name(file: str, top: str) -> str:
        return file.rsplit("/", 1)[-1] if file == top else file.removeprefix(top.rstrip("/") + "/")

    def read(self, partition):
        if partition is None:
            return
        system, top = file_system(self.path)
        name = self._name(partition.value, top)
        with system.open_input_stream(partition.value) as stream:
            for seq, entry in enumerate(read_entries(stream, 3 if self.index else 2)):
                if None in entry[:-1]:
                    raise ValueError(f"a tombstone as key in {name}")
                keys = [D.encode_key(d) for d in entry[:-1]]
                if self._wanted(keys[0]):
                    yield *map(bytearray, keys), None if entry[-1] is None else bytearray(D.encode_key(entry[-1])), name, seq


class _PushingReader(_Reader):
    def pushFilters(self, filters):  # noqa: N802
        lead = "sv_key" if self.index else "pk_key"
        for f in filters:
            if isinstance(
                f,
                (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual),
            ) and f.attribute == (lead,) and isinstance(f.value, (bytes, bytearray)):
                self.tests.append((type(f).__name__, bytes(f.value)))
            else:
                yield f


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        system, top = file_system(self.path)
        system.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.kv"
        with system.open_output_stream(f"{top}/.{name}") as out:
            for r in rows:
                out.write(serialized(r))
        return _Written(name)

    def commit(self, messages):
        system, top = file_system(self.path)
        for m in messages:
            system.move(f"{top}/.{m.name}", f"{top}/{m.name}")

    def abort(self, messages):
        system, top = file_system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{top}/.{m.name}")


def serialized(keys) -> bytes:
    """Encoded keys (the last one may be null) in the file form."""
    return b"".join(D.serialize(None if k is None else D.decode_key(bytes(k))) for k in keys)


class KvDataSource(DataSource):
    @classmethod
    def name(cls):
        return "kv"

    def _index(self) -> bool:
        kind = self.options.get("kind", "entries")
        if kind not in ("entries", "index"):
            raise ValueError(f"no such kind of file: {kind}")
        return kind == "index"

    def schema(self):
        return ("sv_key binary, " if self._index() else "") + "pk_key binary, pv_key binary, file string, seq bigint"

    def reader(self, schema):
        kind = _PushingReader if self.options.get("pushdown", "false").lower() == "true" else _Reader
        return kind(self.options["path"], self._index(), self.options.get("pattern"))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])
