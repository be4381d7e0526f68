"""Plugins: sources and sinks of one's own as Spark data sources, read in parallel and written with a commit.

A plugin says what it is (name, version, what it detects) and can do either or both of

* scan: ``partitions(options)`` lists what is to be read, one task each, and ``scan(part, options)`` yields rows of ``schema``;
* report: ``report(rows, options)`` takes a task's rows and returns a receipt; ``publish(receipts, options)`` runs once after all tasks have succeeded, and
  ``withdraw(receipts, options)`` if any has failed.

    install(spark, plugin)
    spark.read.format("name").option(...).load()
    df.write.format("name").mode("append").option(...).save()

``folder()`` is one: JSON lines in a folder. Tasks write to a staging place of their own; publishing lists their files in a manifest, whose writing is the commit, and only what
manifests list is read. So a write that fails, an attempt that is run twice or a lost executor leaves no row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

Options = dict[str, str]


@dataclass(frozen=True)
class Plugin:
    name: str
    version: str
    schema: str | None = None
    description: str = ""
    detects: tuple[str, ...] = field(default=())
    partitions: Callable[[Options], list] | None = None
    scan: Callable[[object, Options], Iterator[tuple]] | None = None
    report: Callable[[Iterator[dict], Options], object] | None = None
    publish: Callable[[list, Options], None] | None = None
    withdraw: Callable[[list, Options], None] | None = None


@dataclass
class _Part(InputPartition):
    what: object


@dataclass
class _Receipt(WriterCommitMessage):
    what: object


class _Reader(DataSourceReader):
    def __init__(self, plugin: Plugin, options: Options):
        self.plugin, self.options = plugin, options

    def partitions(self):
        return [_Part(p) for p in self.plugin.partitions(self.options)] if self.plugin.partitions else [_Part(None)]

    def read(self, partition):
        if partition is not None:  # Spark reads once where there is nothing to read
            yield from self.plugin.scan(partition.what, self.options)


class _Writer(DataSourceWriter):
    def __init__(self, plugin: Plugin, options: Options):
        self.plugin, self.options = plugin, options

    def write(self, iterator):
        return _Receipt(self.plugin.report((row.asDict(recursive=True) for row in iterator), self.options))

    def commit(self, messages):
        if self.plugin.publish:
            self.plugin.publish([m.what for m in messages], self.options)

    def abort(self, messages):
        if self.plugin.withdraw:
            self.plugin.withdraw([m.what for m in messages if m is not None], self.options)


def install(spark: SparkSession, plugin: Plugin) -> None:
    """Makes the plugin a format of the session's readers and writers."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return plugin.name

        def schema(self) -> str:
            wanted = self.options.get("schema", plugin.schema)
            if not wanted:
                raise ValueError(f"{plugin.name} needs a schema")
            return wanted

        def reader(self, schema: StructType) -> DataSourceReader:
            if plugin.scan is None:
                raise ValueError(f"{plugin.name} can't be read")
            return _Reader(plugin, dict(self.options) | {"schema_json": schema.json()})

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            if plugin.report is None:
                raise ValueError(f"{plugin.name} can't be written")
            if overwrite:
                raise ValueError(f"{plugin.name} only appends")
            return _Writer(plugin, dict(self.options))

    spark.dataSource.register(Source)


def listed(plugins: list[Plugin]) -> list[tuple[str, str, str, bool, bool]]:
    """(name, version, detects, scans, reports) of plugins, by name."""
    return sorted((p.name, p.version, ",".join(p.detects), p.scan is not None, p.report is not None) for p in plugins)


# JSON lines in a folder that driver and executors share: staging/<file>, manifests/<run>.json
def _at(options: Options):
    from pyarrow import fs

    root = options["path"]
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _manifests(options: Options) -> list[str]:
    from pyarrow import fs

    files, root = _at(options)
    found = files.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    names = []
    for info in sorted(found, key=lambda f: f.path):
        if info.path.endswith(".json"):
            with files.open_input_stream(info.path) as stream:
                names += json.loads(stream.read().decode())
    return names


def _lines(name: str, options: Options) -> Iterator[tuple]:
    files, root = _at(options)
    columns = [f["name"] for f in json.loads(options["schema_json"])["fields"]]
    with files.open_input_stream(f"{root}/staging/{name}") as stream:
        rest = b""
        while block := stream.read(1 << 20):
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                row = json.loads(line)
                yield tuple(row.get(c) for c in columns)


def _stage(rows: Iterator[dict], options: Options) -> str | None:
    files, root = _at(options)
    first = next(rows, None)
    if first is None:
        return None
    name = f"{uuid.uuid4().hex}.jsonl"
    files.create_dir(f"{root}/staging", recursive=True)
    with files.open_output_stream(f"{root}/staging/{name}") as stream:
        stream.write(json.dumps(first).encode() + b"\n")
        for row in rows:
            stream.write(json.dumps(row).encode() + b"\n")
    return name


def _list_them(receipts: list, options: Options) -> None:
    files, root = _at(options)
    files.create_dir(f"{root}/manifests", recursive=True)
    run = uuid.uuid4().hex
    with files.open_output_stream(f"{root}/manifests/{run}.part") as stream:
        stream.write(json.dumps(sorted(r for r in receipts if r)).encode())
    files.move(f"{root}/manifests/{run}.part", f"{root}/manifests/{run}.json")


def _drop(receipts: list, options: Options) -> None:
    files, root = _at(options)
    for name in receipts:
        if name:
            files.delete_file(f"{root}/staging/{name}")


def folder(name: str = "folder", schema: str | None = None) -> Plugin:
    """JSON lines of a folder (option path), a task a file; appended with a commit."""
    return Plugin(name, "1", schema, "JSON lines of a folder", (), _manifests, _lines, _stage, _list_them, _drop)
