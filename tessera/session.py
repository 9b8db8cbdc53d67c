"""Session helpers: where intermediate tables live and how input is spread over the cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a folder of its own. On a cluster a
    machine-local folder would be lost with its executor, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches read one expensive result, or where a generated value (an id, a partition
    number) must stay the same in all of them. Parquet keeps column pruning and filter pushdown for the readers.
    A table stays until the session ends or ``discard``, so it is packed tighter than by default; what was shuffled for it
    goes as soon as it is written, and does not wait for the driver to collect its garbage.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` returned, once all that is made of them is staged itself."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(conf).delete(path, True)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a small scan over all cores before per-row heavy work.

    A big input has many splits per core and is left alone; only an input with few splits (or a file with one
    row group) is worth the exchange. Pass a plain scan with just the needed columns, the key first: rows go by its
    hash, which a retried task repeats exactly and which needs no sort of the rows.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= 4 * cores:
        return scan
    return scan.repartition(cores, scan.columns[0])
