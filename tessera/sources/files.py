"""Corpus scan: source files below input folders, listed and read by Spark tasks.

Spark's own file reader leaves out names that begin with ``_`` or ``.``, and with them every ``__init__.py``. The scan
therefore lists folders itself, one Spark job per tree level over all folders of that level, and reads the files found
in tasks of even size. Works on any file system that Arrow can open.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import path_ancestors
from tessera.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUFFIX = ".py"
LISTED = "path string, is_dir boolean, linked boolean, size bigint"
READ_BYTES = 64 << 20
_FLUSH_BYTES = 8 << 20
_FLUSH_ROWS = 10_000
_LITERAL_IGNORES = 100


@dataclass(frozen=True)
class Scan:
    """``found(path, size)`` and ``errors(path, stage, reason)``; ``files()`` reads the contents."""

    found: DataFrame
    errors: DataFrame

    def files(self) -> DataFrame:
        return read_files(self.found)


def _open(path: str, opened: dict) -> tuple[fs.FileSystem, str]:
    """File system and its own path of a URI or an absolute path.

    ``opened`` keeps one client per scheme and authority, with what it puts before the rest of a path.
    """
    scheme, mark, rest = path.partition("://")
    host, slash, tail = rest.partition("/") if mark else ("", "", path)
    key, tail = (scheme if mark else "", host), slash + tail
    plain = not mark or not set("%?#") & set(tail)
    if plain and key in opened:
        system, before = opened[key]
        return system, before + tail
    system, inner = fs.FileSystem.from_uri(path)
    if plain and inner.endswith(tail):
        opened[key] = system, inner.removesuffix(tail)
    return system, inner


def _canonical(path: str) -> str:
    """Resolve links of a local path; other file systems have none."""
    if "://" in path and not path.startswith("file:"):
        return path.rstrip("/")
    return os.path.realpath(path.removeprefix("file://"))


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of each folder: sub-folders that are no links, and source files under their resolved path."""
    kinds = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("linked", pa.bool_()), ("size", pa.int64())])
    fresh = lambda: {name: [] for name in kinds.names}
    opened = {}
    for batch in batches:
        rows = fresh()
        for folder in batch.column(0).to_pylist():
            system, inner = _open(folder, opened)
            base = folder.rstrip("/")
            for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                path = f"{base}/{info.base_name}"
                is_dir = info.type == fs.FileType.Directory
                if not is_dir and not (info.type == fs.FileType.File and info.base_name.endswith(SUFFIX)):
                    continue
                real = _canonical(path)
                linked = real != path
                if is_dir and linked:
                    continue
                for name, value in zip(rows, (real, is_dir, linked, info.size or 0)):
                    rows[name].append(value)
            if len(rows["path"]) >= _FLUSH_ROWS:
                yield pa.RecordBatch.from_pydict(rows, kinds)
                rows = fresh()
        yield pa.RecordBatch.from_pydict(rows, kinds)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of the paths; null for a file that cannot be read, which extraction turns into an error row."""
    def pack(paths, contents):
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "raw"])

    opened = {}
    paths, contents, held = [], [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                system, inner = _open(path, opened)
                with system.open_input_stream(inner) as stream:
                    contents.append(stream.read())
            except OSError:
                contents.append(None)
            paths.append(path)
            held += len(contents[-1] or b"")
            if held > _FLUSH_BYTES:
                yield pack(paths, contents)
                paths, contents, held = [], [], 0
    if paths:
        yield pack(paths, contents)


def decode(raw: Column) -> Column:
    """UTF-8 with replacement of bad bytes, and all line ends as ``\\n``."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\\r\\n?", "\n")


def read_files(found: DataFrame, task_bytes: int = READ_BYTES) -> DataFrame:
    """``found(path, size)`` to ``files(path, content)``, about ``task_bytes`` of files per task."""
    size = found.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n")).first()
    cores = found.sparkSession.sparkContext.defaultParallelism
    tasks = max(int(size["total"] // task_bytes) + 1, min(cores, size["n"]), 1)
    raw = found.select("path").repartition(tasks, "path").mapInArrow(_read_batches, "path string, raw binary")
    return raw.select("path", decode(F.col("raw")).alias("content"))


def drop_ignored(files: DataFrame, ignored_files: Sequence[str], ignored_dirs: Sequence[str]) -> DataFrame:
    """Without the files that are ignored themselves or lie below an ignored folder.

    A short list is a literal, tested per row against the path's ancestors. A long one is a table joined to the
    exploded ancestors; it is as large as the list in the call and so may be broadcast.
    """
    exact, above = list(ignored_files) + list(ignored_dirs), list(ignored_dirs)
    if not exact:
        return files
    path = F.col("path")
    if len(exact) <= _LITERAL_IGNORES:
        kept = files.filter(~path.isin(exact))
        if above:
            dirs = F.array(*[F.lit(d) for d in above])
            kept = kept.filter(~F.arrays_overlap(path_ancestors(path), dirs))
        return kept
    spark = files.sparkSession
    rows = [(p, True) for p in above] + [(p, False) for p in ignored_files]
    ignores = spark.createDataFrame(rows, "ignored string, is_dir boolean")
    steps = files.select("path", F.explode(F.array_append(path_ancestors(path), path)).alias("ignored"))
    hits = steps.join(ignores, "ignored").filter(F.col("is_dir") | (F.col("ignored") == path))
    return files.join(hits.select("path").distinct(), "path", "left_anti")


def merge_inputs(inputs: Iterable[DataFrame]) -> DataFrame:
    """Union of overlapping inputs, each path once."""
    merged = None
    for rows in inputs:
        merged = rows if merged is None else merged.unionByName(rows)
    return merged.dropDuplicates(["path"])


def scan_corpus(spark: SparkSession, paths: Sequence[str], ignore: Sequence[str] = ()) -> Scan:
    """Find the source files below ``paths``, without those below ``ignore``.

    Inputs may overlap and may be single files. Links to files count as their target, links to folders are not
    followed, ignored folders are not entered. Inputs that are neither a folder nor a source file, and ignores that
    do not exist, become rows of ``errors``.
    """
    problems, folders, singles = [], [], []
    ignored_files, ignored_dirs = [], []
    for raw in ignore:
        path = _canonical(raw)
        kind = _kind(path)
        if kind == fs.FileType.NotFound:
            problems.append((path, "ignore", "does not exist"))
        else:
            (ignored_dirs if kind == fs.FileType.Directory else ignored_files).append(path)
    for raw in paths:
        path = _canonical(raw)
        kind = _kind(path)
        if kind == fs.FileType.Directory:
            folders.append(path)
        elif kind == fs.FileType.File and path.endswith(SUFFIX):
            system, inner = _open(path, {})
            singles.append((path, False, False, system.get_file_info(inner).size or 0))
        elif path not in ignored_files and not any(path == d or path.startswith(f"{d}/") for d in ignored_dirs):
            problems.append((path, "scan", "neither a folder nor a source file"))

    levels = [spark.createDataFrame(singles, LISTED)]
    frontier = drop_ignored(spark.createDataFrame([(p,) for p in sorted(set(folders))], "path string"), [], ignored_dirs)
    while not frontier.isEmpty():
        tasks = spark.sparkContext.defaultParallelism
        listed = stage(frontier.repartition(tasks).mapInArrow(_list_folders, LISTED), "listing")
        levels.append(listed.filter(~F.col("is_dir")))
        frontier = drop_ignored(listed.filter("is_dir").select("path"), [], ignored_dirs)
    found = drop_ignored(merge_inputs(levels), ignored_files, ignored_dirs).select("path", "size")
    return Scan(found, spark.createDataFrame(problems, "path string, stage string, reason string"))


def _kind(path: str) -> fs.FileType:
    system, inner = _open(path, {})
    return system.get_file_info(inner).type


def plan_scan(scan: Scan) -> DataFrame:
    """Dry run: the paths that would be analysed; nothing is read or parsed."""
    return scan.found.select("path")
