"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. A batch counts in how many of its documents each line key stands, drops the keys that the
runs already settle (a merge anti-join), and adds the rest as a new sorted run. Runs of one level are merged into one
of the next when there are ``fanout`` of them, so a key stands in few runs and each run is rewritten a few times only.
A run is a table in buckets of the hash, each bucket sorted: batches and compactions meet it without moving it. Runs
stay in their folder, so a later session can add its documents to them. Native DataFrame operations throughout.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, ascii_lower
from tessera.operators.skew import lookup_join
from tessera.session import stage, stage_path

#: A key in at least so many documents loses all its lines.
MIN_DOCUMENTS = 10
#: Keys of fewer code points are never dropped.
MIN_CHARS = 1
BATCHES = 4
FANOUT = 3


def line_keys(text: Column) -> Column:
    """The lines' keys: stripped of white space at both ends, A-Z lower-cased. A null text is one empty line."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.trim(x, F.lit(BLANKS)))


def line_places(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Array of ``h1, h2, at, first``: 128 bits of each line's key, its place, and whether no earlier line has the key.

    Keys of fewer than ``min_chars`` code points are left out. The lines are sorted by hash, so that a text of very many
    lines takes little more than one of few for each of them.
    """
    hashed = F.transform(
        line_keys(text),
        lambda key, i: F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), i.alias("at"))),
    )
    named = F.array(F.sort_array(F.filter(hashed, lambda x: x.isNotNull())))

    def firsts(sorted_: Column) -> Column:
        def flagged(x: Column, i: Column) -> Column:
            before = F.get(sorted_, i - 1)
            again = (before["h1"] == x["h1"]) & (before["h2"] == x["h2"])
            return F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["at"].alias("at"), F.coalesce(~again, F.lit(True)).alias("first"))

        return F.transform(sorted_, flagged)

    return F.transform(named, firsts)[0]


class LineRuns:
    """Sorted runs ``h1, h2, n, n_lines``, by level: in how many documents and lines of the run's batches a key stands.

    ``folder`` holds the runs and a list of them for each state; a folder with runs is gone on with, in its own number
    of buckets. What settled keys gain later is kept apart, so that ``frequent`` has their true weight.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, min_documents: int = MIN_DOCUMENTS, fanout: int = FANOUT):
        self.spark, self.min_documents, self.fanout = spark, min_documents, fanout
        self.folder = (folder or stage_path(spark, "line-runs")).rstrip("/")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.levels, self.gained = 0, [[]], []
        if folder and (listed := self._listed()):
            self.version, self.buckets = listed[0]["version"], listed[0]["buckets"]
            self.levels = [[r["name"] for r in listed if r["level"] == k] for k in range(max(r["level"] for r in listed) + 1)]
            self.gained = [r["name"] for r in listed if r["level"] < 0]

    def _listed(self) -> list:
        """The newest list of runs; none for a folder without."""
        lists = self.spark.read.schema("version int, level int, name string, buckets int").option("pathGlobFilter", "*.json")
        try:
            rows = lists.json(f"{self.folder}/lists/*").collect()
        except Exception as error:  # noqa: BLE001 - a folder that is not there yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        newest = max((r["version"] for r in rows), default=0)
        return sorted((r for r in rows if r["version"] == newest), key=lambda r: r["name"])

    def _list(self) -> None:
        """Write down the runs of now: what was there before stays valid until the list is whole."""
        self.version += 1
        rows = [(self.version, k, name, self.buckets) for k, names in [*enumerate(self.levels), (-1, self.gained)] for name in names]
        frame = self.spark.createDataFrame(rows, "version int, level int, name string, buckets int").coalesce(1)
        frame.write.json(f"{self.folder}/lists/{self.version:08d}")

    def _write(self, run: DataFrame, kind: str) -> str:
        """A run's folder: one file in each bucket, sorted by hash. Its rows come by hash already, from an aggregate."""
        name = f"{kind}_{len(self.gained) + sum(map(len, self.levels)):04d}_{uuid.uuid4().hex}"
        run.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option(
            "path", f"{self.folder}/{name}"
        ).saveAsTable(name)
        return name

    def _read(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, n BIGINT, n_lines BIGINT) USING parquet "
                f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'"
            )
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [self._read(name) for level in self.levels for name in level]

    def settled(self) -> list[DataFrame]:
        return [run.filter(F.col("n") >= self.min_documents) for run in self.runs()]

    def add(self, keys: DataFrame) -> None:
        """Add a batch: rows ``h1, h2, first``, one for each line, ``first`` in one of them for each document and key."""
        counted = keys.groupBy("h1", "h2").agg(F.sum(F.col("first").cast("long")).alias("n"), F.count(F.lit(1)).alias("n_lines"))
        if settled := self.settled():
            counted, known = stage(counted, "line-batch"), self._merged(settled).select("h1", "h2")
            self.gained.append(self._write(counted.join(known, ["h1", "h2"], "left_semi"), "gained"))
            counted = counted.join(known, ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(counted, "run"))
        level = 0
        while len(self.levels[level]) == self.fanout:
            merged = self._merged([self._read(name) for name in self.levels[level]])
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged, "run"))
            self.levels[level] = []
            level += 1
        self._list()

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs side by side, bucket by bucket: each holds a key once, so that an outer join adds them up."""
        def added(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnsRenamed({"n": "_n", "n_lines": "_lines"}), ["h1", "h2"], "full_outer")
            plus = lambda x, y: (F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))).alias(x)
            return both.select("h1", "h2", plus("n", "_n"), plus("n_lines", "_lines"))

        return reduce(added, runs)

    def frequent(self) -> DataFrame:
        """``h1, h2, n, n_lines`` of the keys that stand in at least ``min_documents`` documents."""
        known = self._merged(self.runs()).filter(F.col("n") >= self.min_documents)
        return self._merged([known, *map(self._read, self.gained)])


def drop_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, folder: str | None = None,
) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), ``n_lines`` (long, before dropping), ``kept`` (the lines that stay).

    A null or empty text is one empty line, whose empty key never drops. Each row counts as a document; rows that
    repeat are documents of their own and lose the same lines. ``key`` may be null or repeat: rows are told apart by
    it and a hash of the text, and rows equal in both have the same lines. A very long text is one row of work, in time
    that grows with its lines. With a ``folder`` of earlier runs their documents count as well, and these join them.

    The lines' hashes and places are staged once; batches and the last join read that table. The list of keys that drop
    is joined, never broadcast whole, with keys of many lines split (``lookup_join``). Texts move once, to meet the
    places of the lines that they lose.
    """
    spark = docs.sparkSession
    places = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.explode(line_places(F.col(text), min_chars)).alias("x"))
    occurs = stage(places.select("k", "t", "x.h1", "x.h2", "x.at", "x.first"), "line-hashes")
    runs = LineRuns(spark, folder, min_documents, fanout)
    for batch in range(batches):
        runs.add(occurs.filter(F.pmod("t", F.lit(batches)) == batch).select("h1", "h2", "first"))
    frequent = stage(runs.frequent(), "line-frequent")
    hits = lookup_join(occurs.select("k", "t", "h1", "h2", "at"), frequent, ["h1", "h2"], "n_lines", "t")
    drops = stage(hits.groupBy("k", "t").agg(F.collect_set("at").alias("dropped")), "line-drops")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    own, same_text = F.col(f"row.{key}"), F.xxhash64(F.col(f"row.{text}"))
    joined = rows.join(drops, own.eqNullSafe(F.col("k")) & (same_text == F.col("t")), "left")
    lines = F.split(F.coalesce(F.col(f"row.{text}"), F.lit("")), "\n")

    def stay(x: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("dropped"))
        return F.transform(places, lambda i: F.get(x, i))

    some = F.transform(F.array(lines), stay)[0]
    kept = F.when(F.col("dropped").isNull(), lines).otherwise(some)
    return joined.select("row", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
