"""The corpus scan as a table: ``spark.read.format("corpus")``.

A row for each source file below the inputs, with its size, its content when that is asked for, and for what could not
be read the reason. Planning opens only the upper folders, until there is a partition for each of a few hundred tasks;
what lies below is walked by the tasks. A folder of very many files is dealt over several partitions by name.

Options: ``paths`` and ``ignore``, JSON lists of absolute paths or URIs; ``content``, ``false`` for a dry run;
``partitions``, how many are wanted.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.files import SUFFIX, _canonical, _open, decode

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ``kind`` is file, input, ignore or folder; a row with an ``error`` has no size and no content.
SCHEMA = "path string, kind string, linked boolean, size bigint, raw binary, error string"
PARTITIONS = 200
FILES_PER_PART = 5_000
_FLUSH_BYTES = 8 << 20
_ARROW = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("linked", pa.bool_()), ("size", pa.int64()), ("raw", pa.binary()),
    ("error", pa.string()),
])


@dataclass
class Part(InputPartition):
    """A folder to walk, its own files dealt by name, a single file, or an error found while planning."""

    path: str
    kind: str  # tree, own, file, error, nothing
    at: int = 0
    of: int = 1
    what: str = ""
    error: str = ""


def _entries(folder: str, opened: dict) -> list[tuple[str, bool]]:
    """Names in a folder and whether each is one; a local link that leads nowhere is listed, which Arrow leaves out."""
    system, inner = _open(folder, opened)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(inner) as entries:
            return sorted((e.name, e.is_dir()) for e in entries)
    return sorted((i.base_name, i.type == fs.FileType.Directory) for i in system.get_file_info(fs.FileSelector(inner)))


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CorpusReader(self.options)


class CorpusReader(DataSourceReader):
    def __init__(self, options):
        # Options keep no case of their keys; values stay as they are.
        own = {k.lower(): v for k, v in dict(options).items()}
        self.paths, self.ignore = json.loads(own.get("paths", "[]")), json.loads(own.get("ignore", "[]"))
        self.content = own.get("content", "true").lower() == "true"
        self.wanted = int(own.get("partitions", PARTITIONS))
        self.skipped: set[str] = {_canonical(p) for p in self.ignore}

    def _below(self, path: str, tops: set[str]) -> bool:
        """Whether the path or a folder above it is one of ``tops``."""
        while path and path not in tops:
            shorter = path.rpartition("/")[0]
            if shorter == path:
                return False
            path = shorter
        return path in tops

    def partitions(self) -> list[Part]:
        opened: dict = {}
        kind_of = lambda path: (lambda s, p: s.get_file_info(p).type)(*_open(path, opened))
        parts = [Part(p, "error", what="ignore", error="does not exist") for p in sorted(self.skipped) if kind_of(p) == fs.FileType.NotFound]
        folders, files = set(), set()
        for path in sorted({_canonical(p) for p in self.paths}):
            kind = kind_of(path)
            if self._below(path, self.skipped):
                continue
            if kind == fs.FileType.Directory:
                folders.add(path)
            elif kind == fs.FileType.File and path.endswith(SUFFIX):
                files.add(path)
            else:
                parts.append(Part(path, "error", what="input", error="neither a folder nor a source file"))
        # An input inside another one is walked with it.
        outer = {p for p in folders if not self._below(p.rpartition("/")[0], folders)}
        parts += [Part(p, "file") for p in sorted(files) if not self._below(p.rpartition("/")[0], outer)]
        frontier = sorted(outer)
        while frontier and len(frontier) + len(parts) < self.wanted:
            below = []
            for folder in frontier:
                try:
                    children, n = self._listed(folder, opened)
                except OSError:  # the task that reads it tells
                    children, n = [], 1
                below += children
                of = -(-n // FILES_PER_PART)
                parts += [Part(folder, "own", at, of) for at in range(of)]
            frontier = below
        parts += [Part(p, "tree") for p in frontier]
        return parts or [Part("", "nothing")]  # Spark wants one

    def _listed(self, folder: str, opened: dict) -> tuple[list[str], int]:
        """Sub-folders that are no links and not ignored, and how many other entries are source files by name."""
        children, n = [], 0
        for name, is_dir in _entries(folder, opened):
            path = f"{folder.rstrip('/')}/{name}"
            if is_dir:
                if _canonical(path) == path and path not in self.skipped:
                    children.append(path)
            elif name.endswith(SUFFIX):
                n += 1
        return children, n

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(part, {}):
            rows.append(row)
            held += len(row.get("raw") or b"") + 200
            if held > _FLUSH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _rows(self, part: Part, opened: dict) -> Iterator[dict]:
        if part.kind == "error":
            yield {"path": part.path, "kind": part.what, "error": part.error}
        elif part.kind == "nothing":
            return
        elif part.kind == "file":
            yield self._file(part.path, part.path, opened)
        else:
            waiting = [part.path]
            while waiting:
                folder = waiting.pop()
                try:
                    entries = _entries(folder, opened)
                except OSError as error:
                    yield {"path": folder, "kind": "folder", "error": type(error).__name__}
                    continue
                for name, is_dir in entries:
                    path = f"{folder.rstrip('/')}/{name}"
                    if is_dir:
                        if part.kind == "tree" and _canonical(path) == path and path not in self.skipped:
                            waiting.append(path)
                    elif name.endswith(SUFFIX) and zlib.crc32(name.encode(errors="surrogateescape")) % part.of == part.at:
                        real = _canonical(path)
                        if not self._below(path, self.skipped) and not self._below(real, self.skipped):
                            yield self._file(path, real, opened)

    def _file(self, path: str, real: str, opened: dict) -> dict:
        row = {"path": real, "kind": "file", "linked": real != path}
        try:
            system, inner = _open(real, opened)
            info = system.get_file_info(inner)
            if info.type != fs.FileType.File:
                raise FileNotFoundError(real)
            row["size"] = info.size
            if self.content:
                with system.open_input_stream(inner) as stream:
                    row["raw"] = stream.read()
        except OSError as error:
            row |= {"size": None, "raw": None, "error": type(error).__name__}
        return row


def scan_table(spark: SparkSession, paths: Sequence[str], ignore: Sequence[str] = (), content: bool = True) -> DataFrame:
    """``path, kind, linked, size, content, error`` of the source files below ``paths``, each file once.

    Inputs may overlap, be single files, or be missing; links to files count as their target, links to folders are not
    entered. Without ``content`` no file is opened. Content is decoded, with line feeds only.
    """
    spark.dataSource.register(CorpusSource)
    found = spark.read.format("corpus").options(
        paths=json.dumps(list(paths)), ignore=json.dumps(list(ignore)), content=str(content).lower()
    ).load()
    # A file may be found by itself and by links; which row of its own stays is told by the smallest.
    once = found.groupBy("path").agg(F.min(F.struct("linked", "kind", "size", "raw", "error")).alias("row"))
    return once.select("path", "row.kind", "row.linked", "row.size", decode(F.col("row.raw")).alias("content"), "row.error")
