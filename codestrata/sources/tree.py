"""Source-tree scan: a data source that lists, then an even spread of the reading.

Spark's file formats skip names that start with ``_`` or ``.``, and those are real source files.  This source
lists a tree and keeps them: a file system all workers can see, or any store that has a URI pyarrow opens.  The driver only opens
the top of the tree, until there are enough directories to share out, and keeps no file names; the directories go into a
bounded number of shares.  Listing can be uneven, so it yields paths, sizes and extensions only; the paths are then spread by
hash and each task reads its own files.  Filters on ``path`` (a prefix, one or several paths), ``ext`` and ``size`` reach the listing:
directories that can't hold a match aren't opened, and no excluded file is read.  A directory that can't be listed becomes a
row of its own with size 0 and, once read, a read error.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

from ..functions.paths import CODE_EXTS, LANGUAGE_BY_EXT
from .tables import files_from_table

BATCH_BYTES = 16 * 1024 * 1024
PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class _Share(InputPartition):
    """Directories of a listing task: of the first ones only their own files, of the others everything below."""

    shallow: tuple[str, ...]
    deep: tuple[str, ...]


@dataclass
class _Entry:
    path: str
    name: str
    is_dir: bool
    is_file: bool
    size: int


class _LocalStore:
    """A mounted file system; directories behind symbolic links are not followed."""

    def entries(self, path: str) -> list[_Entry] | None:
        """Entries of a directory, or None if it can't be listed."""
        try:
            with os.scandir(path) as found:
                return [self._entry(e) for e in found]
        except OSError:
            return None

    def _entry(self, e: os.DirEntry) -> _Entry:
        is_dir, is_file = e.is_dir(follow_symlinks=False), e.is_file()
        try:
            size = e.stat().st_size if is_file else 0
        except OSError:
            size = 0
        return _Entry(e.path, e.name, is_dir, is_file, size)

    def kind(self, path: str) -> str:
        return "file" if os.path.isfile(path) else "dir" if os.path.isdir(path) else "none"

    def size(self, path: str) -> int:
        return os.path.getsize(path)

    def read(self, path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    def write(self, path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        # Put in place whole, so that a task that runs twice leaves no half-written file.
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)


class _UriStore:
    """A store behind a URI; paths keep the URI's scheme."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(uri)
        self.scheme = uri[: len(uri) - len(base)] if uri.endswith(base) else uri.split(":", 1)[0] + "://"

    def _bare(self, path: str) -> str:
        return path.removeprefix(self.scheme)

    def entries(self, path: str) -> list[_Entry] | None:
        from pyarrow import fs

        try:
            found = self.fs.get_file_info(fs.FileSelector(self._bare(path)))
        except OSError:
            return None
        return [_Entry(self.scheme + i.path, i.base_name, i.type == fs.FileType.Directory, i.type == fs.FileType.File, i.size or 0) for i in found]

    def kind(self, path: str) -> str:
        from pyarrow import fs

        found = self.fs.get_file_info(self._bare(path)).type
        return {fs.FileType.File: "file", fs.FileType.Directory: "dir"}.get(found, "none")

    def size(self, path: str) -> int:
        return self.fs.get_file_info(self._bare(path)).size or 0

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(self._bare(path)) as f:
            return f.read()

    def write(self, path: str, data: bytes) -> None:
        bare = self._bare(path)
        self.fs.create_dir(os.path.dirname(bare), recursive=True)
        part = f"{bare}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        self.fs.move(part, bare)


def _store(path: str):
    return _UriStore(path) if "://" in path or path.startswith("file:") else _LocalStore()


class SourceTree(DataSource):
    """Files of a tree: ``spark.read.format("source_tree").option("exts", ".py,.js").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, ext string, size long"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(
            self.options["path"],
            tuple(self.options.get("exts", ",".join(CODE_EXTS)).split(",")),
            int(self.options.get("splits", "64")),
        )


class _TreeReader(DataSourceReader):
    def __init__(self, path: str, exts: tuple[str, ...], splits: int):
        self.path, self.exts, self.splits = path, exts, splits
        self.prefixes, self.only_exts, self.least, self.most = None, None, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what listing can use.  All filters stay with Spark as well, so taking one only saves work."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("path",) and isinstance(f, (StringStartsWith, EqualTo, In)):
                told = tuple(f.value) if isinstance(f, In) else (f.value,)
                self.prefixes = told if self.prefixes is None else tuple(p for p in told if p.startswith(self.prefixes)) or ("\0",)
            elif column == ("ext",) and isinstance(f, (EqualTo, In)):
                told = set(f.value) if isinstance(f, In) else {f.value}
                self.only_exts = told if self.only_exts is None else self.only_exts & told
            elif column == ("size",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.most = f.value if self.most is None else min(self.most, f.value)
            elif column == ("size",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value)
        return filters

    def _may_hold(self, directory: str) -> bool:
        """Whether a path below the directory can have one of the prefixes."""
        inside = directory.rstrip("/") + "/"
        return self.prefixes is None or inside.startswith(self.prefixes) or any(p.startswith(inside) for p in self.prefixes)

    def _row(self, path: str, size: int) -> tuple | None:
        ext = os.path.splitext(path)[1]
        out = (
            self.prefixes is not None and not path.startswith(self.prefixes)
            or self.only_exts is not None and ext not in self.only_exts
            or size < self.least
            or self.most is not None and size > self.most
        )
        return None if out else (path, ext, size)

    def partitions(self) -> list[_Share]:
        store = _store(self.path)
        kind = store.kind(self.path)
        if kind == "file":
            return [_Share((self.path,), ())]
        if kind == "none":
            raise ValueError(f"Path does not exist: {self.path}")
        shallow, deep = [], [self.path]
        while deep and len(deep) < self.splits:
            shallow += deep
            deep = [e.path for d in deep for e in store.entries(d) or [] if e.is_dir and self._may_hold(e.path)]
        n = max(1, min(self.splits, len(shallow) + len(deep)))
        # Deep directories are dealt from the first share on, shallow ones from the last, so small trees spread as well.
        return [_Share(tuple(shallow[n - 1 - i :: n]), tuple(deep[i::n])) for i in range(n)]

    def read(self, share: _Share) -> Iterator[tuple[str, str, int]]:
        store = _store(self.path)
        pending = [(p, False) for p in share.shallow] + [(p, True) for p in share.deep]
        while pending:
            path, deep = pending.pop()
            alone = path == self.path and store.kind(path) == "file"
            entries = None if alone else store.entries(path)
            if entries is None:
                row = self._row(path, store.size(path)) if alone else (path, "", 0)
                if row:
                    yield row
                continue
            for entry in entries:
                if entry.is_dir:
                    if deep and self._may_hold(entry.path):
                        pending.append((entry.path, True))
                elif entry.name.endswith(self.exts) and entry.is_file:
                    row = self._row(entry.path, entry.size)
                    if row:
                        yield row


def _loading(root: str):
    """Contents of the listed files of a tree; a file that cannot be read gets null content."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = _store(root)  # of the root's URI: the paths below it need not be valid URIs
        for pdf in batches:
            rows, size = [], 0
            for path in pdf["path"]:
                try:
                    data = store.read(path)
                except OSError:
                    data = None
                rows.append((path, data))
                size += len(data or b"")
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", "content"])

    return load


def list_source_tree(spark: SparkSession, path: str, exts: list[str] | None = None, splits: int = 64) -> DataFrame:
    """``path, ext, size`` of the files of a tree; ``where`` on these columns reaches the listing."""
    spark.dataSource.register(SourceTree)
    spark.conf.set(PUSH_DOWN, "true")
    return spark.read.format("source_tree").option("exts", ",".join(exts or CODE_EXTS)).option("splits", str(splits)).load(path)


def scan_source_tree(
    spark: SparkSession, path: str, exts: list[str] | None = None, splits: int = 64, partitions: int | None = None,
    max_file_size_mb: float | None = None, languages: list[str] | None = None, prefix: str | None = None,
) -> DataFrame:
    """Files table of a directory or a single file, given by a path or a URI; ``partitions`` is the number of reading tasks.

    Files beyond the size limit, in other languages or without the path prefix are not opened.
    """
    exts = list(exts or CODE_EXTS)
    if languages is not None:
        exts = [e for e in exts if LANGUAGE_BY_EXT.get(e) in languages]
    listed = list_source_tree(spark, path, exts or ["\0"], splits)
    if max_file_size_mb is not None:
        listed = listed.where(F.col("size") <= int(max_file_size_mb * 1024 * 1024))
    if prefix is not None:
        listed = listed.where(F.col("path").startswith(prefix))
    tasks = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files_from_table(listed.select("path").repartition(tasks, "path").mapInPandas(_loading(path), "path string, content binary"))


def write_source_tree(files: DataFrame, root: str) -> int:
    """Write ``(path, content)`` rows as files below ``root``, a path or a URI; the tasks write, the number of files comes back.

    Paths are relative to the root; one that leads out of it is an error.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, n = _store(root), 0
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"path leads out of the tree: {path}")
                store.write(f"{root.rstrip('/')}/{path}", bytes(data))
                n += 1
        yield pd.DataFrame({"n": [n]})

    rows = files.select("path", F.col("content").cast("binary").alias("content")).where("content is not null")
    return rows.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
