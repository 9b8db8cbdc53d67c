"""A folder tree of source files that Spark tasks write from the documents, for the queries on the scan."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import spread, stage_path
from tessera.sources.files import _open

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes that are no UTF-8 and how many replacement characters each sequence makes: a lone byte, a cut
# three-byte and four-byte character, an overlong slash, a surrogate, a number beyond the last character.
BAD_BYTES = (("FF", 1), ("E282", 1), ("F09F98", 1), ("C0AF", 2), ("EDA080", 3), ("F4908080", 4))


def rendered_rows(documents: DataFrame) -> DataFrame:
    """``place, raw, target``: a file's place below the root and its bytes, or the place that a link points to.

    By ``doc_id``: one document in three is no source file; one in eleven lies in an ignored folder, one in thirteen in
    a folder that is an input by itself; some names begin with ``_`` or ``.``; line ends and bad bytes vary; one in
    nineteen has a link to its file, one in twenty-three a link to nothing.
    """
    doc = F.col("doc_id")
    name = F.concat(
        F.when(doc % 5 == 1, "_").when(doc % 5 == 2, ".").otherwise(""), F.lit("f"), doc.cast("string"),
        F.when(doc % 3 == 0, ".txt").otherwise(".py"),
    )
    folder = F.when(doc % 11 == 4, "src/skip").when(doc % 13 == 5, "more").otherwise(
        F.concat(F.lit("src/a"), (doc % 4).cast("string"), F.lit("/b"), (doc % 7).cast("string"))
    )
    place = F.concat(folder, F.lit("/"), name)
    ends = F.when(doc % 4 == 1, "\r\n").when(doc % 4 == 2, "\r").otherwise("\n")
    bad = F.lit("")
    for k, (raw, _) in enumerate(BAD_BYTES):
        bad = F.when(doc % 17 == k, raw).otherwise(bad)
    raw = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), ends).cast("binary"), F.unhex(bad))
    files = documents.select(place.alias("place"), raw.alias("raw"), F.lit(None).cast("string").alias("target"))
    links = documents.filter((doc % 19 == 3) | (doc % 23 == 6)).select(
        F.concat(F.lit("src/links/l"), doc.cast("string"), F.lit(".py")), F.lit(None).cast("binary"),
        F.when(doc % 23 == 6, "gone.py").otherwise(place),
    )
    return files.union(links)


def _write(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    opened, made = {}, set()
    for batch in batches:
        for row in batch.to_pylist():
            path = f"{root}/{row['place']}"
            system, inner = _open(path, opened)
            folder = inner.rpartition("/")[0]
            if folder not in made:
                system.create_dir(folder)
                made.add(folder)
            if row["target"] is not None:
                if isinstance(system, fs.LocalFileSystem) and not os.path.islink(inner):
                    os.symlink(_open(f"{root}/{row['target']}", opened)[1], inner)
                continue
            with system.open_output_stream(inner) as stream:
                stream.write(row["raw"])
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})


def render_files(documents: DataFrame) -> str:
    """Write the files; the root they lie in. A repeated task writes the same files again."""
    root = stage_path(documents.sparkSession, "tree").removeprefix("file://").removeprefix("file:")
    rows = spread(rendered_rows(documents.select("doc_id", "text")))
    rows.mapInArrow(lambda b: _write(b, root), "n long").agg(F.sum("n")).collect()
    return root
