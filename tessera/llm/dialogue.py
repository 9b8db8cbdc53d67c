"""Conversation structure repair: cheapest edits to ``(s?(ua)+)?`` by a run-length dynamic programme.

A row is one of nine symbols: who speaks, and whether the row must go or is cut off. Equal consecutive symbols are a
run. A symbol's transition over the four states of the pattern is a min-plus matrix; its binary powers are cached, so a
run of any length costs a few products. The programme goes from the end to the start, run by run; the edits are then
unrolled forward, at each step the first in ASCII order that keeps the cost.

Rows are range-sorted by conversation and turn. A conversation that begins and ends inside a range is repaired where it
lies. Those at the borders of ranges, and long ones, which may fill many, go on as bounded segments: their symbols meet
as runs, their texts never do.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS
from tessera.operators.skew import lookup_join
from tessera.session import stage

# Costs of the edits, and of a cut-off row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NEVER = 1 << 60
#: States: nothing yet, after a system row, after a user row, after an assistant row. The first and last may end.
NEXT = (2, 2, 3, 2)
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {2: "user", 3: "assistant"}
GOOD_PAIRS = ("su", "ua", "au")
#: Symbol 0 must go; the others are 1 + 2 * place in this string + (1 if cut off).
SPEAKERS = "suax"
#: Cost of ending, by state.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: A conversation of more rows or characters is handed on in segments; rows of a segment, characters of a piece.
LONG_ROWS, LONG_CHARS = 20_000, 8 << 20
PIECE_CHARS = 4 << 20
UNROLLED = 4096

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def symbol(role: str, must_go: bool, cut: bool) -> int:
    speaker = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return 0 if must_go else 1 + 2 * SPEAKERS.index(speaker) + cut


def _edits(sym: int) -> list[tuple[str, int, tuple]]:
    """Edits of a row in ASCII order: name, cost, and for each state the state after (None where it is not possible)."""
    out = [("D", DELETE, (0, 1, 2, 3))]
    if sym:
        more = TRUNCATED * ((sym - 1) % 2)
        out.append(("K", more, tuple(k.get(SPEAKERS[(sym - 1) // 2]) for k in KEEP)))
        out.append(("R", REROLE + more, NEXT))
    return out


EDITS = [_edits(s) for s in range(1 + 2 * len(SPEAKERS))]


def _transition(sym: int) -> Matrix:
    """Cheapest way from each state to each by one row, with what is inserted before it."""
    rows = []
    for state in range(4):
        row = [NEVER] * 4
        at, inserted = state, 0
        for _ in range(3):
            for _, cost, to in EDITS[sym]:
                if to[at] is not None:
                    row[to[at]] = min(row[to[at]], inserted + cost)
            at, inserted = NEXT[at], inserted + INSERT
        rows.append(tuple(row))
    return tuple(rows)


@lru_cache(maxsize=None)
def power(sym: int, bit: int) -> Matrix:
    """The transition of ``2 ** bit`` equal rows."""
    if bit == 0:
        return _transition(sym)
    half = power(sym, bit - 1)
    return tuple(tuple(min(half[s][m] + half[m][t] for m in range(4)) for t in range(4)) for s in range(4))


def advance(sym: int, length: int, after: Vector) -> Vector:
    """Costs to the end before a run, from those after it."""
    bit = 0
    while length:
        if length & 1:
            after = tuple(min(a + b for a, b in zip(row, after)) for row in power(sym, bit))
        length, bit = length >> 1, bit + 1
    return after


def solve(runs: list[tuple[int, int]]) -> tuple[int, Iterator[tuple[int, str]]]:
    """Least cost, and the edits: for each row the state before it and the names of its inserts and its own edit.

    After the last row come the state and the inserts at the end.
    """
    after = [AT_END]
    for sym, length in reversed(runs):
        after.append(advance(sym, length, after[-1]))
    return after[-1][0], _unrolled(runs, after)


def _unrolled(runs, after) -> Iterator[tuple[int, str]]:
    state = 0
    for k, (sym, length) in enumerate(runs):
        end = after[len(runs) - 1 - k]
        for low in range(0, length, UNROLLED):
            size = min(UNROLLED, length - low)
            costs = [advance(sym, length - low - size, end)]
            for _ in range(size):
                costs.append(advance(sym, 1, costs[-1]))
            for i in range(size, 0, -1):
                begun, names = state, ""
                while True:
                    here, later = costs[i][state], costs[i - 1]
                    step = next(((n, to[state]) for n, c, to in EDITS[sym] if to[state] is not None and c + later[to[state]] == here), None)
                    if INSERT + costs[i][NEXT[state]] == here and (step is None or step[0] > "I"):
                        names, state = names + "I", NEXT[state]
                        continue
                    names, state = names + step[0], step[1]
                    break
                yield begun, names
    yield state, "I" * (AT_END[state] // INSERT)


def runs_of(symbols: Iterable[int]) -> list[tuple[int, int]]:
    return [(s, sum(1 for _ in same)) for s, same in itertools.groupby(symbols)]


@lru_cache(maxsize=50_000)
def _short(symbols: tuple[int, ...]) -> tuple[int, tuple[tuple[int, str], ...]]:
    cost, edits = solve(runs_of(symbols))
    return cost, tuple(edits)


def repaired_lines(edits: Iterable[tuple[int, str]], rows: Iterable[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of the repaired rows; ``edits`` may have one entry more than there are rows."""
    rows = iter(rows)
    for state, names in edits:
        for name in names:
            if name == "I":
                state = NEXT[state]
                yield f"{ROLES[state]}:"
            else:
                role, text = next(rows)
                if name == "K":
                    yield f"{role}:{text}"
                elif name == "R":
                    yield f"{ROLES[NEXT[state]]}:{text}"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults by the hash of ``conv:turn``: dropped, emptied, cut, repeated, spoken by the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name(conv), F.lit(":"), name(turn)).cast("binary")) % 20
    whole = F.coalesce(text, F.lit(" "))
    damaged = rows.select(
        conv, turn, F.when(kind == 4, "user").otherwise(F.coalesce(role, F.lit(" "))).alias(role),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(whole, "[.!?]", "")).otherwise(whole).alias(text),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return damaged.drop("copy")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of a sorted stream by their first ``keys`` columns."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    return itertools.groupby(rows, key=lambda r: r[:keys])


FAULTS = "blank long, duplicate long, truncated long, illegal long"
DONE = f"gaps long, {FAULTS}, cost long, audit string, repaired string"
OPENED = ("range", "n", "turn", "role", "text", "blank", "cut", "body")
OPEN = "range int, n long, turn long, role string, text string, blank boolean, cut boolean, body binary"


def _gaps(least, most, distinct: int) -> int:
    return most - least + 1 - distinct if distinct else 0


def _inside(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Repair conversations that end where they began; hand on the first, the last and long ones of a range as rows.

    Rows are ``conv, turn, role, text, blank, cut, body``, sorted. Each row of the result has ``done`` or ``open``.
    """
    place, out, held = TaskContext.get().partitionId(), [], 0

    def flush():
        nonlocal out, held
        full, out, held = out, [], 0
        return pa.RecordBatch.from_pylist(full, schema)

    waiting = None  # a conversation is known to be whole when the next one begins
    n = 0
    for at, ((conv,), rows) in enumerate(_groups(batches, 1)):
        if waiting:
            done = _whole(waiting[1])
            out.append({"conv": waiting[0], "done": done, "open": None})
            held += len(done["repaired"])
            waiting = None
        kept, chars, whole = [], 0, at > 0
        for row in rows:
            kept.append(row)
            chars += len(row[3])
            if not whole or len(kept) > LONG_ROWS or chars > LONG_CHARS:
                whole = False
                for r in kept:
                    out.append({"conv": conv, "done": None, "open": dict(zip(OPENED, (place, n, *r[1:])))})
                    n, held = n + 1, held + len(r[3])
                kept, chars = [], 0
                if held > PIECE_CHARS or len(out) > 10_000:
                    yield flush()
        if whole:
            waiting = conv, kept
        if held > PIECE_CHARS or len(out) > 10_000:
            yield flush()
    if waiting:
        conv, kept = waiting
        for r in kept:
            out.append({"conv": conv, "done": None, "open": dict(zip(OPENED, (place, n, *r[1:])))})
            n += 1
    yield flush()


def _whole(rows: list[tuple]) -> dict:
    """All there is to say about one conversation's rows ``conv, turn, role, text, blank, cut, body``."""
    seen, symbols, faults = set(), [], [0, 0, 0]
    for _, _, role, _, blank, cut, body in rows:
        again = body in seen
        seen.add(body)
        kind = 0 if blank else 1 if again else 2 if cut else None
        if kind is not None:
            faults[kind] += 1
        symbols.append(symbol(role, blank or again, cut))
    turns = {r[1] for r in rows} - {None}
    cost, edits = _short(tuple(symbols)) if len(symbols) <= 64 else solve(runs_of(symbols))
    edits = list(edits)
    return {
        "gaps": _gaps(min(turns, default=0), max(turns, default=0), len(turns)),
        "blank": faults[0], "duplicate": faults[1], "truncated": faults[2],
        "illegal": sum(a[2][:1] + b[2][:1] not in GOOD_PAIRS for a, b in itertools.pairwise(rows)),
        "cost": cost, "audit": "".join(names for _, names in edits),
        "repaired": "\n".join(repaired_lines(edits, ((r[2], r[3]) for r in rows))),
    }


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs, faults and border speakers of each segment, from rows ``conv, range, block, n, role, must_go, cut``."""
    for (conv, place, block), rows in _groups(batches, 3):
        runs, illegal, first, last = [], 0, None, None
        for _, _, _, _, speaker, must_go, cut in rows:
            s = symbol(speaker, must_go, cut)
            if runs and runs[-1]["sym"] == s:
                runs[-1]["length"] += 1
            else:
                runs.append({"sym": s, "length": 1})
            if last is not None:
                illegal += last + speaker not in GOOD_PAIRS
            first, last = speaker if first is None else first, speaker
        yield pa.RecordBatch.from_pylist([{
            "conv": conv, "range": place, "block": block, "runs": runs, "illegal": illegal, "first": first, "last": last,
        }])


def _joined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each conversation: cost and border faults once, and for each segment its part of the edits and its first state.

    Rows are a conversation's segments in order. Only symbols and edits meet here, a few bytes a row; they are as long
    as the audit, which is one value of the result.
    """
    for (conv,), rows in _groups(batches, 1):
        rows = list(rows)
        sizes = [sum(r["length"] for r in row[3]) for row in rows]
        runs: list[tuple[int, int]] = []
        for r in itertools.chain.from_iterable(row[3] for row in rows):
            if runs and runs[-1][0] == r["sym"]:
                runs[-1] = r["sym"], runs[-1][1] + r["length"]
            else:
                runs.append((r["sym"], r["length"]))
        illegal = sum(row[4] for row in rows) + sum(a[6] + b[5] not in GOOD_PAIRS for a, b in itertools.pairwise(rows))
        cost, edits = solve(runs)
        for k, row in enumerate(rows):
            own = itertools.islice(edits, sizes[k] + (k == len(rows) - 1))
            states, names = zip(*own)
            yield pa.RecordBatch.from_pylist([{
                "conv": conv, "range": row[1], "block": row[2], "state": states[0], "audit": "".join(names),
                "cost": cost if k == 0 else 0, "illegal": illegal if k == 0 else 0,
            }], schema)


def _replayed(state: int, audit: str, speakers: Iterator[tuple[str, str]]) -> Iterator[str]:
    """Repaired lines of a segment, from the state it begins in."""
    for name in audit:
        if name == "I":
            state = NEXT[state]
            yield f"{ROLES[state]}:"
            continue
        role, text = next(speakers)
        if name == "K":
            state = KEEP[state][role[:1]]
            yield f"{role}:{text}"
        elif name == "R":
            state = NEXT[state]
            yield f"{ROLES[state]}:{text}"


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Repaired text of each segment in pieces; a segment's first row has its state and edits, the others are its rows."""
    for (conv, place, block), rows in _groups(batches, 3):
        _, _, _, _, state, audit, _, _ = next(rows)
        piece, lines, chars = 0, [], 0
        for line in itertools.chain(_replayed(state, audit, ((r[6], r[7]) for r in rows)), [None]):
            if line is not None:
                lines.append(line)
                chars += len(line)
            if lines and (line is None or chars > PIECE_CHARS):
                row = {"conv": conv, "range": place, "block": block, "piece": piece, "repaired": "\n".join(lines)}
                yield pa.RecordBatch.from_pylist([row], schema)
                piece, lines, chars = piece + 1, [], 0


@dataclass(frozen=True)
class Repaired:
    """``conversations``: a row each, with faults, cost, audit and repaired text, null for those that are in ``pieces``.

    ``pieces``: ``range, block, piece`` is their order inside a conversation; joined by line feeds they are its text.
    """

    conversations: DataFrame
    pieces: DataFrame
    conv: str

    def digests(self) -> DataFrame:
        """The conversations with ``sha256`` of the repaired text; pieces go through a hash one after the other."""
        conv = F.col(self.conv)
        near = self.conversations.filter(F.col("repaired").isNotNull()).withColumn("sha256", F.sha2("repaired", 256))
        far = self.conversations.filter(F.col("repaired").isNull())
        order = [conv.alias("conv"), "range", "block", "piece", "repaired"]
        schema = far.select(conv.alias("conv"), F.lit("").alias("sha256")).schema
        sorted_ = self.pieces.select(*order).repartition("conv").sortWithinPartitions("conv", "range", "block", "piece")
        hashed = sorted_.mapInArrow(lambda b: _hashed(b, _arrow(schema)), schema)
        joined = far.join(hashed, conv.eqNullSafe(hashed["conv"]), "left").drop("conv")
        empty = hashlib.sha256().hexdigest()
        return near.unionByName(joined.withColumn("sha256", F.coalesce("sha256", F.lit(empty)))).drop("repaired")


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (conv,), rows in _groups(batches, 1):
        sha = hashlib.sha256()
        for k, row in enumerate(rows):
            sha.update((b"\n" if k else b"") + row[4].encode())
        yield pa.RecordBatch.from_pylist([{"conv": conv, "sha256": sha.hexdigest()}], schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _faults(text: Column) -> tuple[Column, Column]:
    stripped = F.rtrim(text, F.lit(BLANKS))
    return stripped == "", ~F.substring(stripped, -1, 1).isin(".", "!", "?")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Faults and cheapest repair of each conversation in ``rows``.

    Rows of a conversation go by turn, null ones first, those of one turn by the MD5 of role and text. A null role or text is one blank. Rows
    without a conversation id are one conversation; an id without rows is not in the result. Rows that repeat are
    duplicates but the first. ``gaps`` counts missing whole numbers between the least and the greatest turn. Empty
    tables give no rows; columns other than the four are not read.

    A range or segment holds a bounded number of rows, whatever the conversation; a text of many rows in one role is
    told from earlier ones by a salted join. Per conversation only its runs and its audit meet in one task.
    """
    spark = rows.sparkSession
    kind = rows.schema[conv].dataType.simpleString()
    value = lambda c: F.coalesce(F.col(c), F.lit(" "))
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), value(role).alias("role"), value(text).alias("text"))
    blank, cut = _faults(F.col("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows may stand in any order; a number from the scan lets them fill more than one range.
    body = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    marked = plain.select("*", blank.alias("blank"), cut.alias("cut"), body.alias("body"), F.monotonically_increasing_id().alias("id"))
    order = ["conv", "turn", "body", "id"]
    ranged = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("id")
    result = f"conv {kind}, done struct<{_colons(DONE)}>, open struct<{_colons(OPEN)}>"
    schema = spark.createDataFrame([], result).schema
    passed = stage(ranged.mapInArrow(lambda b: _inside(b, _arrow(schema)), result), "conversations")
    done = passed.filter(F.col("done").isNotNull()).select(F.col("conv").alias(conv), "done.*")
    opened = passed.filter(F.col("open").isNotNull()).select(F.struct("conv").alias("c"), "open.*")

    # Border and long conversations: first rows of each role and text, then runs, then edits, then texts.
    hashed = stage(opened.select("c", "range", "n", "turn", F.substring("role", 1, 1).alias("speaker"), "body", "blank", "cut"), "open-rows")
    firsts = stage(
        hashed.groupBy("c", "body").agg(F.min(F.struct("range", "n")).alias("first"), F.count(F.lit(1)).alias("rows")), "first-rows"
    )
    flagged = lookup_join(hashed, firsts, ["c", "body"], "rows", "n").withColumn("again", F.col("first") < F.struct("range", "n"))
    block = F.floor(F.col("n") / LONG_ROWS).alias("block")
    marked = stage(
        flagged.select("c", "range", block, "n", "turn", "speaker", "blank", "again", "cut", (F.col("blank") | F.col("again")).alias("must_go")), "marked-rows"
    )
    key = ["c", "range", "block"]
    narrow = marked.repartition(*key).sortWithinPartitions(*key, "n").select("c.conv", "range", "block", "n", "speaker", "must_go", "cut")
    runs = f"conv {kind}, range int, block long, runs array<struct<sym:int,length:long>>, illegal long, first string, last string"
    runs_schema = spark.createDataFrame([], runs).schema
    segments = stage(narrow.mapInArrow(lambda b: _recast(_segments(b), _arrow(runs_schema)), runs), "segments")
    edits = f"conv {kind}, range int, block long, state int, audit string, cost long, illegal long"
    edits_schema = spark.createDataFrame([], edits).schema
    in_order = segments.repartition("conv").sortWithinPartitions("conv", "range", "block")
    edited = stage(in_order.mapInArrow(lambda b: _joined(b, _arrow(edits_schema)), edits), "segment-edits")

    yes = lambda c: F.sum(c.cast("long"))
    fault = marked.groupBy("c").agg(
        yes(F.col("blank")).alias("blank"), yes(~F.col("blank") & F.col("again")).alias("duplicate"),
        yes(~F.col("must_go") & F.col("cut")).alias("truncated"), F.min("turn").alias("least"), F.max("turn").alias("most"),
    )
    turns = marked.select("c", "turn").filter(F.col("turn").isNotNull()).distinct().groupBy("c").agg(F.count(F.lit(1)).alias("turns"))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long")
    audits = edited.groupBy(F.struct("conv").alias("c")).agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    far = fault.join(turns, "c", "left").join(audits, "c").select(
        F.col("c.conv").alias(conv), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.lit(None).cast("string").alias("repaired"),
    )
    blocked = opened.select("c", "range", block, "n", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("audit"), "role", "text")
    heads = edited.select(
        F.struct("conv").alias("c"), "range", "block", F.lit(-1).cast("long").alias("n"), "state", "audit",
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
    )
    both = blocked.unionByName(heads).repartition(*key).sortWithinPartitions(*key, "n")
    both = both.select("c.conv", "range", "block", "n", "state", "audit", "role", "text")
    made = f"conv {kind}, range int, block long, piece long, repaired string"
    made_schema = spark.createDataFrame([], made).schema
    pieces = both.mapInArrow(lambda b: _pieces(b, _arrow(made_schema)), made).withColumnRenamed("conv", conv)
    return Repaired(done.unionByName(far), pieces, conv)


def _recast(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist(batch.to_pylist(), schema)


def _colons(fields: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in fields.split(", ")))
