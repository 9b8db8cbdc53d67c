"""JSON documents of any size as rows of nodes: a structural index over byte ranges.

A range is read by one task, which cannot know whether it begins inside a string, nor what is open there. So it tells
for each way of beginning how it ends, what it closes and what it leaves open. These few facts, combined in order, give
every range its true beginning; read once more, it yields the objects that stand in arrays, and the outermost one, each
as the text of its own fields. An object that goes over a border comes in parts and is put together by its position.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import stage
from tessera.sources.files import _open

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 8 << 20
#: How a range may begin: outside of strings, inside of one, inside of one behind a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_OPENER = {ord("}"): ord("{"), ord("]"): ord("[")}
_RANGE = "file string, range int, start long, size long"
_FACTS = (
    f"{_RANGE}, ways array<struct<ends: int, bad: long, closed: binary, closed_at: array<long>, opened: binary, opened_at: array<long>>>"
)
_STARTS = f"{_RANGE}, begins int, kinds binary, places array<long>, error string, at long"
_PARTS = "file string, node long, parent long, range int, whole boolean, text binary, error string, at long"


def _brackets(data: np.ndarray, begins: int) -> tuple[np.ndarray, int]:
    """Places of the brackets outside of strings, and how the range ends."""
    slash = data == ord("\\")
    quotes = np.flatnonzero(data == ord('"'))
    if slash.any() or begins == ESCAPED:
        last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data), dtype=np.int64)))
        before = np.concatenate(([-1], last))  # last place before each that is no backslash
        run = quotes - 1 - before[quotes] + np.where(before[quotes] < 0, begins == ESCAPED, 0)
        quotes = quotes[run % 2 == 0]
        tail = len(data) - 1 - before[-1] + (before[-1] < 0) * (begins == ESCAPED)
    else:
        tail = 0
    inside = begins != OUTSIDE
    places = np.flatnonzero((data == ord("{")) | (data == ord("}")) | (data == ord("[")) | (data == ord("]")))
    places = places[(np.searchsorted(quotes, places) + inside) % 2 == 0]
    ends = (len(quotes) + inside) % 2
    return places, ESCAPED if ends and tail % 2 else ends


def _read(file: str, start: int, size: int, opened: dict) -> np.ndarray:
    system, inner = _open(file, opened)
    with system.open_input_file(inner) as stream:
        stream.seek(start)
        return np.frombuffer(stream.read(size), np.uint8)


def _facts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    clients: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            data = _read(row["file"], row["start"], row["size"], clients)
            ways = [_way(data, row["start"], begins) for begins in (OUTSIDE, INSIDE, ESCAPED)]
            yield pa.RecordBatch.from_pylist([row | {"ways": ways}], schema)


def _way(data: np.ndarray, start: int, begins: int) -> dict:
    """How a range ends that begins so: what it closes of before, what it leaves open, the first bracket that fits none."""
    places, ends = _brackets(data, begins)
    closed, opened, bad = [], [], None
    for at, kind in zip(places.tolist(), data[places].tolist()):
        if kind not in _OPENER:
            opened.append((start + at, kind))
        elif not opened:
            closed.append((start + at, kind))
        elif opened[-1][1] == _OPENER[kind]:
            opened.pop()
        else:
            bad = start + at
            break
    return {
        "ends": ends, "bad": bad, "closed": bytes(k for _, k in closed), "closed_at": [a for a, _ in closed],
        "opened": bytes(k for _, k in opened), "opened_at": [a for a, _ in opened],
    }


def _begun(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """How each range really begins, from the facts of a file's ranges in order; or where the file goes wrong."""
    file, state, stack, over = None, OUTSIDE, [], False

    def ended(end: int) -> list[dict]:
        if file is None or over or (state == OUTSIDE and not stack):
            return []
        return [{"file": file, "error": "ends inside a value", "at": end}]

    end = 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["file"] != file:
                out += ended(end)
                file, state, stack, over = row["file"], OUTSIDE, [], False
            end = row["start"] + row["size"]
            if over:
                continue
            way = row["ways"][state]
            out.append({k: row[k] for k in ("file", "range", "start", "size")} | {
                "begins": state, "kinds": bytes(k for _, k in stack), "places": [a for a, _ in stack],
            })
            bad = None
            for at, kind in zip(way["closed_at"], way["closed"]):
                if not stack or stack[-1][1] != _OPENER[kind]:
                    bad = at
                    break
                stack.pop()
            bad = way["bad"] if bad is None else bad
            if bad is not None:
                out.append({"file": file, "error": "bracket that closes nothing", "at": bad})
                over = True
                continue
            stack += zip(way["opened_at"], way["opened"])
            state = way["ends"]
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist(ended(end), schema)


class _Nodes:
    """Nodes of one range: their own bytes without those of the nodes inside them, and what cannot be right."""

    def __init__(self, row: dict, data: np.ndarray):
        self.row, self.raw, self.start = row, data.tobytes(), row["start"]
        self.pieces: dict[int, list[bytes]] = {}
        self.parents: dict[int, int | None] = {}
        self.whole: set[int] = set()
        self.errors: list[tuple[str, int]] = []
        self.stack: list[tuple[int, int | None]] = []  # kind, owning node
        for kind, place in zip(row["kinds"], row["places"]):
            self.stack.append((kind, place if self._is_node(kind) else self._owner()))
        places, _ = _brackets(data, row["begins"])
        self._walk(places.tolist())

    def _owner(self) -> int | None:
        return self.stack[-1][1] if self.stack else None

    def _is_node(self, kind: int) -> bool:
        return kind == ord("{") and (not self.stack or self.stack[-1][0] == ord("["))

    def _take(self, low: int, high: int, allowed: tuple[bytes, ...]) -> None:
        """Bytes up to the next bracket: a node's own, or what may stand between nodes."""
        part = self.raw[low:high]
        if self.stack and self.stack[-1][0] == ord("{"):
            if part:
                self.pieces.setdefault(self._owner(), []).append(part)
        elif part.strip(b" \t\n\r") not in (allowed if self.stack else (b"",)):
            self.errors.append(("not a node", self.start + low))

    def _walk(self, places: list[int]) -> None:
        low, before = 0, None  # the bracket before, if it is in this range
        any_ = (b"", b",")
        for at in places:
            kind = self.raw[at]
            if kind == ord("{"):
                self._take(low, at, any_ if before is None else (b",",) if before == ord("}") else (b"",))
                if self._is_node(kind):
                    node = self.start + at
                    self.parents[node], self.pieces[node] = self._owner(), []
                    self.stack.append((kind, node))
                else:
                    self.stack.append((kind, self._owner()))
                low = at
            elif kind == ord("["):
                self._take(low, at, any_)
                if self.stack and self._owner() is not None:
                    self.pieces.setdefault(self._owner(), []).append(b"[")
                self.stack.append((kind, self._owner()))
                low = at + 1
            elif kind == ord("}"):
                self._take(low, at + 1, ())
                _, owner = self.stack.pop()
                if owner is not None and (not self.stack or self.stack[-1][0] == ord("[")):
                    self.whole.add(owner)
                low = at + 1
            else:
                self._take(low, at, any_ if before is None else (b"",))
                self.stack.pop()
                low = at
                if not self.stack or self.stack[-1][0] != ord("{"):
                    low = at + 1
            before = kind
        self._take(low, len(self.raw), any_)

    def rows(self) -> Iterator[dict]:
        own = {"file": self.row["file"], "range": self.row["range"]}
        for node, pieces in self.pieces.items():
            if node is not None:
                inside = node in self.parents
                yield own | {"node": node, "parent": self.parents.get(node), "whole": inside and node in self.whole, "text": b"".join(pieces)}
        for error, at in self.errors[:1]:
            yield own | {"error": error, "at": at}


def _nodes(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    clients: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            rows = list(_Nodes(row, _read(row["file"], row["start"], row["size"], clients)).rows())
            for low in range(0, len(rows), 2_000):
                yield pa.RecordBatch.from_pylist(rows[low : low + 2_000], schema)


def _arrow(spark: SparkSession, fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], fields).schema)


def json_nodes(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Nodes and errors of the JSON documents at ``path``: a file, a folder of them, or a pattern.

    Nodes are ``file, node, parent, json``: place of the node's first byte and of its parent's, and the node's own text,
    in which arrays are empty. A node is the outermost object, or an object in an array; arrays hold nothing else.
    Errors are ``file, error, at`` with a byte place, the first of each file; a file with an error has no nodes. Commas
    between two objects are counted where a range holds both. Files of no bytes are passed over.

    A task holds one range and the nodes in it; a node that goes over a border is put together from its parts. Of a
    file only its ranges' facts meet, some bytes for each level that is open at a border.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("file"), "length")
    at = F.col("range").cast("long") * range_bytes
    count = F.greatest(F.ceil(F.col("length") / range_bytes), F.lit(1)).cast("int")
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0), count - 1)).alias("range")).select(
        "file", "range", at.alias("start"), F.least(F.lit(range_bytes), F.col("length") - at).alias("size")
    )
    ranges = stage(ranges, "json-ranges")
    n, cores = ranges.count(), spark.sparkContext.defaultParallelism
    tasks = max(1, min(n, 4 * cores), n // 8)
    facts_, starts_, parts_ = (_arrow(spark, x) for x in (_FACTS, _STARTS, _PARTS))
    facts = stage(ranges.repartition(tasks, "file", "range").mapInArrow(lambda b: _facts(b, facts_), _FACTS), "json-facts")
    in_order = facts.repartition("file").sortWithinPartitions("file", "range")
    starts = stage(in_order.mapInArrow(lambda b: _begun(b, starts_), _STARTS), "json-starts")
    good = starts.filter("error is null").join(starts.filter("error is not null").select("file"), "file", "left_anti")
    parts = stage(good.repartition(tasks, "file", "range").mapInArrow(lambda b: _nodes(b, parts_), _PARTS), "json-parts")

    text = F.aggregate(F.sort_array(F.collect_list(F.struct("range", "text"))), F.lit(b""), lambda done, x: F.concat(done, x["text"]))
    whole = parts.filter("whole").select("file", "node", "parent", "text")
    split = parts.filter("node is not null and not whole").groupBy("file", "node").agg(F.max("parent").alias("parent"), text.alias("text"))
    nodes = stage(
        whole.unionByName(split).select("file", "node", "parent", F.col("text").cast("string").alias("json")).withColumn(
            "valid", F.try_parse_json("json").isNotNull()
        ),
        "json-nodes",
    )
    roots = files.select("file", "length").join(
        nodes.filter("parent is null").groupBy("file").agg(F.count(F.lit(1)).alias("roots"), F.max("node").alias("last")), "file", "left"
    )
    wrong = [
        starts.filter("error is not null").select("file", "error", "at"),
        parts.filter("error is not null").select("file", "error", "at"),
        nodes.filter("not valid").select("file", F.lit("invalid JSON").alias("error"), F.col("node").alias("at")),
        roots.filter("coalesce(roots, 0) <> 1").select(
            "file", F.when(F.col("roots").isNull(), "no node").otherwise("more than one document").alias("error"),
            F.coalesce("last", F.lit(0)).cast("long").alias("at"),
        ),
    ]
    # How many outermost nodes there are means something only where all else is right.
    late = [w.withColumn("late", F.lit(w is wrong[3])) for w in wrong]
    every = late[0].unionAll(late[1]).unionAll(late[2]).unionAll(late[3])
    first = every.groupBy("file").agg(F.min(F.struct("late", "at", "error")).alias("e"))
    errors = stage(first.select("file", "e.error", "e.at"), "json-errors")
    return nodes.join(errors.select("file"), "file", "left_anti").select("file", "node", "parent", "json"), errors
