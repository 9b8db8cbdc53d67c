"""Near-duplicate documents by MinHash with tensored banding.

Two collections of partial keys, each made of a few minhashes, are computed per document; the keys of the hash tables
are all pairs of one key of either collection. With c partial keys a side there are c * c tables for 2 * c partial keys:
about the square root of the minhashes that as many independent tables would cost. Documents that meet in a table are
candidates; a link is confirmed on the full shingle sets of both texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import over_cores, slices
from tessera.llm.components import components
from tessera.operators.skew import lookup_join
from tessera.session import stage

#: Partial keys a side and minhashes in each: at similarity 0.8 a pair misses all tables once in 2,800, at 0.85 once in 45,000.
COLLECTION = 12
KEY_HASHES = 3
BINS = 64
#: 64-bit words of the bitmap that rules out pairs of members of one table.
MAP_WORDS = 16
#: Rows of one crowded table key, or pairs of one document, that a task compares.
SHARE = 2000
CHUNK = 256
WORDS_REMEMBERED = 400_000
_MASK = (1 << 64) - 1


def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and masks of ``n`` hash functions, from a seed."""
    draw = [xxhash.xxh3_64_intdigest(f"{seed}:{i}") for i in range(2 * n)]
    return np.array(draw[:n], np.uint64) | np.uint64(1), np.array(draw[n:], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased; bytes split at just the six ASCII white-space characters."""
    return text.encode().lower().split()


def shingles(text: str, k: int) -> frozenset[tuple[bytes, ...]]:
    w = tokens(text)
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset({tuple(w)} if w else ())


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Signer:
    """Shingle hashes, partial keys and bin counts of a text."""

    def __init__(self, k: int, collection: int = COLLECTION, key_hashes: int = KEY_HASHES):
        self.k, self.collection, self.key_hashes = k, collection, key_hashes
        self.multiply, self.flip = _family(2 * collection * key_hashes, 1)
        self.place = _family(max(k, 1), 2)[0]
        self.weights = _family(key_hashes, 3)[0]
        self.salt = _family(2 * collection, 4)[1]
        self.words = _Words()

    def hashes(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        w = tokens(text)
        if not w:
            return np.zeros(0, np.uint64)
        if len(w) < self.k:
            return np.array([xxhash.xxh3_64_intdigest(b"\x20".join(w), seed=len(w) + 1)], np.uint64)
        h = np.fromiter(map(self.words.__getitem__, w), np.uint64, len(w))
        n = len(w) - self.k + 1
        total = np.zeros(n, np.uint64)
        for i in range(self.k):
            total += _mixed(h[i : i + n] + np.uint64(i)) * self.place[i]
        return np.unique(_mixed(total))

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The partial keys of both collections, the first one's first."""
        least = np.full(len(self.multiply), _MASK, np.uint64)
        for low in range(0, len(hashes), 4096):
            part = hashes[low : low + 4096]
            np.minimum(least, ((part ^ self.flip[:, None]) * self.multiply[:, None]).min(1), out=least)
        rows = _mixed(least.reshape(-1, self.key_hashes)) * self.weights
        return _mixed(rows.sum(1, dtype=np.uint64) ^ self.salt).view(np.int64)

    def bitmap(self, hashes: np.ndarray) -> np.ndarray:
        """One bit for each place that a hash falls on."""
        bits = np.zeros(64 * MAP_WORDS, np.uint8)
        bits[hashes & np.uint64(64 * MAP_WORDS - 1)] = 1
        return np.packbits(bits).view(np.int64)

    def bins(self, hashes: np.ndarray) -> bytes:
        """How many hashes fall into each bin."""
        return np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=BINS).astype(np.uint32).tobytes()


def sign(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """``id, t, n, digest, left, right, bins`` per row: ``t`` hashes the text, ``digest`` names the shingle set."""
    rows = over_cores(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id").select(
        "id", F.xxhash64("text").alias("t"), "text"
    )

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(k)
        half = signer.collection
        for batch in slices(batches, "text"):
            n, digest, keys, bins = [], [], [], []
            for value in batch.column(2):
                h = signer.hashes(value.as_py() or "")
                n.append(len(h))
                digest.append(hashlib.md5(h.tobytes()).digest())
                keys.append(signer.keys(h))
                bins.append(signer.bins(h))
            both = np.array(keys, np.int64).reshape(-1, 2 * half)
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * half)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(both[:, :half].ravel())),
                    pa.ListArray.from_arrays(offsets, pa.array(both[:, half:].ravel())), pa.array(bins, pa.binary()),
                ],
                ["id", "t", "n", "digest", "left", "right", "bins"],
            )

    kind = "id long, t long, n long, digest binary, left array<long>, right array<long>, bins binary"
    return rows.mapInArrow(signed, kind)


def _table_keys(classes: DataFrame) -> DataFrame:
    """``key, i, j, rep`` of each table in which a class can meet another one.

    A table key needs both of its partial keys, so only partial keys that two classes share are combined.
    """
    sides = [
        classes.select("rep", F.lit(side).alias("side"), F.posexplode(column).alias("at", "part"))
        for side, column in ((0, "left"), (1, "right"))
    ]
    parts = stage(sides[0].unionAll(sides[1]), "partial-keys")
    shared = stage(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "shared-parts")
    met = lookup_join(parts, shared, ["part"], "n", "rep")
    place = F.struct("at", "part")
    per_class = met.groupBy("rep").agg(
        F.collect_list(F.when(F.col("side") == 0, place)).alias("l"), F.collect_list(F.when(F.col("side") == 1, place)).alias("r")
    )
    return (
        per_class.select("rep", F.explode("l").alias("l"), "r")
        .select("rep", "l", F.explode("r").alias("r"))
        .select(
            F.xxhash64("l.part", "r.part").alias("key"), F.col("l.at").alias("i"), F.col("r.at").alias("j"), "rep"
        )
    )


def _possible(a_n: Column, b_n: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity at all."""
    return 100 * F.least(a_n, b_n) >= percent * F.greatest(a_n, b_n)


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes and bin counts allow the similarity; no linked pair is lost."""
    per_a = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("of_a")), "pairs-of-a")
    info = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"{c}_n"), F.col("bins").alias(f"{c}_bins"))
    left = stage(per_a.join(info("a"), "a"), "pairs-left")
    whole = lookup_join(pairs, left, ["a"], "of_a", "b").join(info("b"), "b").filter(_possible(F.col("a_n"), F.col("b_n"), percent))

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_n, b_n = (batch.column(i).to_numpy() for i in (2, 4))
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, BINS) for i in (3, 5))
            most = np.minimum(a, b).sum(1, dtype=np.int64)
            yield batch.filter(pa.array(100 * most >= percent * (a_n + b_n - most))).select(["a", "b"])

    columns = whole.select("a", "b", "a_n", "a_bins", "b_n", "b_bins")
    return columns.mapInArrow(allowed, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets have the similarity.

    The texts that one document is compared with come in chunks, each led by that document's text, and stream past it.
    """
    pairs = stage(pairs, "candidate-pairs")
    per_a = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("of_a")), "candidates-of-a")
    salts = F.ceil(F.col("of_a") / CHUNK).cast("int")
    salted = lookup_join(pairs, per_a, ["a"], "of_a", "b").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    leads = per_a.select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    text = texts.select(F.col("rep").alias("b"), "text")
    members = salted.join(text, "b").select("a", "salt", "b", "text")
    heads = leads.join(text.withColumnRenamed("b", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    streams = heads.unionAll(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, frozenset()
        for batch in slices(batches, "text"):
            found = []
            for a, b, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if b is None:
                    head, own = a, shingles(value.as_py(), k)
                    continue
                assert a == head
                other = shingles(value.as_py(), k)
                both = len(own & other)
                if 100 * both >= percent * (len(own) + len(other) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return streams.mapInArrow(linked, "a long, b long")


def _alone(texts: DataFrame, k: int) -> DataFrame:
    """``rep, alone``: how many of a text's shingles no other one of these texts has, for those that have any.

    Equal hashes of different shingles only make the count smaller, and so the bound drawn from it weaker.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(k)
        for batch in slices(batches, "text", 1 << 20):
            found = [signer.hashes(value.as_py()) for value in batch.column(1)]
            count = np.fromiter(map(len, found), np.int64, len(found))
            values = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), count)), pa.array(values.view(np.int64))], ["rep", "h"]
            )

    posted = texts.select("rep", "text").mapInArrow(hashed, "rep long, h long")
    single = posted.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep")).filter(F.col("n") == 1)
    return single.groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))


def _maps(texts: DataFrame, k: int) -> DataFrame:
    """``rep, map, surplus``: a bitmap of a text's shingles, and how many more shingles it has than places in it.

    Two texts share at most as many shingles as their maps share places, plus the smaller surplus.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(k)
        for batch in slices(batches, "text", 1 << 20):
            found = [signer.hashes(value.as_py()) for value in batch.column(1)]
            maps = np.array([signer.bitmap(h) for h in found], np.int64).reshape(-1, MAP_WORDS)
            surplus = np.array([len(h) for h in found]) - np.bitwise_count(maps.view(np.uint64)).sum(1, dtype=np.int64)
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * MAP_WORDS)
            lists = pa.ListArray.from_arrays(offsets, pa.array(maps.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(surplus, pa.int64())], ["rep", "map", "surplus"])

    return texts.select("rep", "text").mapInArrow(mapped, "rep long, map array<long>, surplus long")


def _apart(member: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a < b`` of one table key and different components that no bound rules out, each at its first table.

    A key's members are cut into blocks of about SHARE. All members of the key stream past each block, a few at a time,
    so a task holds one block whatever the key's size.
    """
    blocks = F.ceil(F.col("n") / SHARE).cast("int")
    own = member.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("side", F.lit(0))
    every = member.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(1))
    single = ["key", "block", "side", "rep", "component", "size", "common", "surplus", "i", "j"]
    lists = ["left", "right", "map"]
    streams = own.select(*single, *lists).unionAll(every.select(*single, *lists))
    streams = streams.repartition("key", "block").sortWithinPartitions("key", "block", "side")

    def allowed(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        # No two sets share more than the smaller count of common shingles, nor than what their bitmaps allow.
        needed = percent * (a["size"][:, None] + b["size"])
        shared = np.minimum(a["common"][:, None], b["common"])
        ok = (a["rep"][:, None] < b["rep"]) & (a["component"][:, None] != b["component"]) & ((100 + percent) * shared >= needed)
        x, y = np.nonzero(ok)
        places = np.bitwise_count((a["map"][x] & b["map"][y]).view(np.uint64)).sum(1, dtype=np.int64)
        ok = (100 + percent) * (places + np.minimum(a["surplus"][x], b["surplus"][y])) >= needed[x, y]
        x, y = x[ok], y[ok]
        for side, at in (("left", "i"), ("right", "j")):
            equal = a[side][x] == b[side][y]
            ok = equal.any(1) & (equal.argmax(1) == a[at][x])
            x, y = x[ok], y[ok]
        return a["rep"][x], b["rep"][y]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block = None, {}
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in single}
            rows |= {c: batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in lists}
            changed = np.zeros(max(0, batch.num_rows - 1), bool)
            for c in ("key", "block", "side"):
                changed |= rows[c][1:] != rows[c][:-1]
            edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                if (of := (rows["key"][low], rows["block"][low])) != group:
                    group, block = of, {c: v[:0] for c, v in rows.items()}
                if rows["side"][low] == 0:
                    block = {c: np.concatenate((block[c], v[low:high])) for c, v in rows.items()}
                    continue
                for start in range(low, high, 128):
                    stop = min(start + 128, high)
                    found.append(allowed(block, {c: v[start:stop] for c, v in rows.items()}))
            a, b = (np.concatenate([f[at] for f in found]) for at in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return streams.mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, n_shingles, component_id, kept, text_hash, leads`` of each row of ``docs``.

    Documents are linked when their sets of ``k``-word shingles have a Jaccard similarity of at least ``percent`` per
    cent; components are what links reach, named by the smallest key. A text of fewer words is one shingle; a null or
    empty one has none and links with nothing. Equal sets are folded into a class first, so copies cost nothing
    further. Other columns are not read. Keys are whole numbers; rows that repeat a key are compared each with its own
    text, a null key links with nothing and has a null component.

    ``text_hash`` tells rows of one key apart, and ``leads`` is true for the smallest key and text hash of each group,
    so for one row of a group unless rows repeat in both; a row that links with nothing leads itself.

    First each class is compared with one other: of the classes it meets, that which meets most others. This joins
    large groups of near-copies around their least edited member. Then pairs that meet in a table and are still apart
    are compared, each at the first table they share; crowded tables are split into blocks. Shingles that a class shares
    with no other class left, bitmaps, sizes and bin counts rule out pairs that cannot be linked; these bounds lose no link.
    """
    signed = stage(sign(docs, k, key, text), "signatures")
    # Rows with equal digests have equal keys and bins, so any of them serves; the smallest (id, t) names a text. A
    # class has a number of its own, since an id may stand on rows with different texts.
    classes = stage(
        signed.filter((F.col("n") > 0) & F.col("id").isNotNull())
        .groupBy("digest")
        .agg(
            F.min(F.struct("id", "t")).alias("named"), F.count(F.lit(1)).alias("copies"),
            F.first(F.struct("n", "left", "right", "bins")).alias("of"),
        )
        .select("digest", F.monotonically_increasing_id().alias("rep"), "named.id", "named.t", "copies", "of.*"),
        "classes",
    )
    tables = stage(_table_keys(classes), "tables")
    met = stage(tables.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "met")
    meeting = stage(lookup_join(tables, met, ["key"], "n", "rep"), "meeting")
    # The member that meets most others is the least edited one of a group of near-copies: its natural centre.
    popular = meeting.groupBy("rep").agg(F.sum("n").alias("meets"))
    centres = stage(
        meeting.join(popular, "rep").groupBy("key")
        .agg(F.max(F.struct("meets", (-F.col("rep")).alias("minus"))).alias("top"), F.first("n").alias("n")),
        "centres",
    )
    wanted = meeting.select("rep").distinct().join(classes.select("rep", "id", "t"), "rep")
    texts = stage(
        docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
        .join(wanted, ["id", "t"]).dropDuplicates(["rep"]).select("rep", "text"),
        "candidate-texts",
    )
    chosen = (
        lookup_join(meeting.select("key", "rep"), centres, ["key"], "n", "rep")
        .groupBy("rep").agg((-F.max("top")["minus"]).alias("centre")).filter(F.col("centre") != F.col("rep"))
    )
    first = _bounded(stage(chosen.select(F.col("centre").alias("a"), F.col("rep").alias("b")), "first-pairs"), classes, percent)
    linked = stage(_confirmed(first, texts, k, percent), "first-links")
    group = stage(components(linked), "first-groups")

    # Tables whose members are not all in one component yet.
    placed = meeting.drop("n").join(group, meeting["rep"] == group["node"], "left").select(
        "key", "i", "j", "rep", F.coalesce("component", "rep").alias("component")
    )
    placed = stage(placed, "placed")
    mixed = stage(
        placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("c0") != F.col("c1")).select("key", "n"),
        "mixed",
    )
    apart_yet = stage(lookup_join(placed, mixed, ["key"], "n", "rep"), "apart")
    still = stage(texts.join(apart_yet.select("rep").distinct(), "rep"), "mixed-texts")
    alone = _alone(still, k)
    sides = (
        classes.select("rep", F.col("n").alias("size"), "left", "right").join(alone, "rep", "left")
        .withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0))).drop("alone")
        .filter(100 * F.col("common") >= percent * F.col("size"))
    )
    sides = stage(sides.join(_maps(still, k), "rep"), "mixed-sides")
    member = stage(apart_yet.join(sides, "rep"), "mixed-members")
    second = _apart(member, percent)
    more = _confirmed(_bounded(stage(second, "second-pairs"), classes, percent), texts, k, percent)
    reached = stage(components(linked.unionAll(more)), "components")
    grouped = classes.join(reached, classes["rep"] == reached["node"], "left").select(
        "digest", "copies", F.struct("id", "t").alias("own"), F.coalesce("component", "rep").alias("group")
    )
    grouped = stage(grouped, "grouped")
    least = grouped.groupBy("group").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("classes"))
    named = stage(lookup_join(grouped, stage(least, "group-least"), ["group"], "classes", "digest").drop("own", "classes"), "named")
    full = lookup_join(signed.filter((F.col("n") > 0) & F.col("id").isNotNull()), named, ["digest"], "copies", "t")
    empty = signed.filter((F.col("n") == 0) | F.col("id").isNull()).withColumn("least", F.struct("id", "t"))
    out = ["id", "t", "n", "least"]
    return full.select(*out).unionAll(empty.select(*out)).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("least.id")).alias("kept"), F.col("t").alias("text_hash"),
        F.struct("id", "t").eqNullSafe(F.col("least")).alias("leads"),
    )
