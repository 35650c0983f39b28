"""Landed files as a Spark source: listed in parts by tasks, heads read without the bodies."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

SCHEMA = "path string, rel_path string, ext string, mtime timestamp, length bigint, head binary"

_COMPARISONS: dict[type, Callable] = {
    ds.EqualTo: lambda x, v: x == v, ds.GreaterThan: lambda x, v: x > v, ds.GreaterThanOrEqual: lambda x, v: x >= v,
    ds.LessThan: lambda x, v: x < v, ds.LessThanOrEqual: lambda x, v: x <= v, ds.In: lambda x, v: x in v,
    ds.StringStartsWith: lambda x, v: x.startswith(v), ds.StringEndsWith: lambda x, v: x.endswith(v), ds.StringContains: lambda x, v: v in x,
}


@dataclass
class Share(ds.InputPartition):
    """Part ``part`` of ``parts`` of the names in ``folder`` (by checksum); with ``deep``, all folders below too."""

    folder: str
    part: int = 0
    parts: int = 1
    deep: bool = False


def file_ext(name: str) -> str:
    """Lower-case extension with its dot, empty without one."""
    base = name.rsplit("/", 1)[-1]
    return base[base.rindex(".") :].lower() if "." in base else ""


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _entries(uri: str) -> list:
    """(uri, file info) directly below a folder; the file itself if it is one; none if nothing is there."""
    from pyarrow import fs

    store, name = _store(uri)
    own = store.get_file_info(name)
    if own.type == fs.FileType.File:
        return [(uri, own)]
    return [(f"{uri}/{f.base_name}", f) for f in store.get_file_info(fs.FileSelector(name, allow_not_found=True))]


class LandedFiles(ds.DataSource):
    """Options: path, head_bytes (0: heads stay null), share (files a task looks at), spread (folders the driver opens)."""

    @classmethod
    def name(cls) -> str:
        return "landed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        o = self.options
        return LandedReader(o["path"].rstrip("/"), int(o.get("head_bytes", 0)), int(o.get("share", 10_000)), int(o.get("spread", 64)))


class LandedReader(ds.DataSourceReader):
    def __init__(self, root: str, head_bytes: int, share: int, spread: int):
        self.root, self.head_bytes, self.share, self.spread = root, head_bytes, share, spread
        self.tests: list[tuple[str, Callable, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        """Comparisons of rel_path, path, ext and length are settled before a file is opened."""
        for f in filters:
            test, column = _COMPARISONS.get(type(f)), getattr(f, "attribute", ())
            if test and len(column) == 1 and column[0] in ("path", "rel_path", "ext", "length"):
                self.tests.append((column[0], test, f.value))
            elif not isinstance(f, ds.IsNotNull) or column not in (("path",), ("rel_path",), ("ext",), ("length",)):
                yield f

    def partitions(self) -> list[Share]:
        """Opens folders level by level until there are enough; wide ones are dealt out in shares."""
        from pyarrow import fs

        shares, level = [], [self.root]
        while level and len(shares) + len(level) < self.spread:
            below = []
            for folder in level:
                found = _entries(folder)
                files = sum(f.type == fs.FileType.File for _, f in found)
                parts = -(-files // self.share)
                shares += [Share(folder, part, parts) for part in range(parts)]
                below += [uri for uri, f in found if f.type == fs.FileType.Directory]
            level = below
        return shares + [Share(folder, deep=True) for folder in level] or [Share(self.root)]

    def _wanted(self, uri: str, rel: str, length: int) -> bool:
        values = {"path": uri, "rel_path": rel, "length": length, "ext": file_ext(rel)}
        return all(test(values[column], value) for column, test, value in self.tests)

    def read(self, partition: Share) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        schema = pa.schema([("path", pa.string()), ("rel_path", pa.string()), ("ext", pa.string()), ("mtime", pa.timestamp("us", tz="UTC")), ("length", pa.int64()), ("head", pa.binary())])
        todo, rows = [partition.folder], []
        while todo:
            for uri, f in _entries(todo.pop()):
                if f.type == fs.FileType.Directory:
                    if partition.deep:
                        todo.append(uri)
                    continue
                rel = uri[len(self.root) + 1 :] or f.base_name
                if zlib.crc32(f.base_name.encode()) % partition.parts != partition.part or not self._wanted(uri, rel, f.size):
                    continue
                head = None
                if self.head_bytes:
                    store, name = _store(uri)
                    with store.open_input_file(name) as opened:
                        head = opened.read(self.head_bytes)
                rows.append((uri, rel, file_ext(rel), f.mtime, f.size, head))
                if len(rows) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def landed_files(spark: SparkSession, path: str, head_bytes: int = 0, share: int = 10_000) -> DataFrame:
    """(path, rel_path, ext, mtime, length, head) of all files below a folder, empty ones included.

    ``head`` holds the first ``head_bytes`` bytes; no more of a file is read. A missing folder has
    no files. The driver opens a few folders to deal the work out: a wide folder in shares of
    its names, deeper ones whole. Filters on path, rel_path, ext and length reach the listing
    (the session's switch for that is set here).
    """
    spark.dataSource.register(LandedFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("landed_files").options(path=path, head_bytes=str(head_bytes), share=str(share)).load()


def _write(root: str):
    def run(batches):
        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for rel, content in zip(batch["rel_path"], batch["content"], strict=True):
                store.create_dir(f"{base}/{rel}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{base}/{rel}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    return run


def land_files(files: DataFrame, root: str) -> int:
    """Writes one file per row (rel_path, content) below ``root`` from tasks; returns their number.

    A task that runs again writes the same files again.
    """
    rows = files.select("rel_path", F.col("content").cast("binary").alias("content"))
    return rows.mapInPandas(_write(root), "n bigint").agg(F.sum("n")).first()[0] or 0
