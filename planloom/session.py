"""Session settings the operators rely on, and the one place lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only: they can be set on a session somebody else made.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A project may hold a third of the rows. Joins on project_id are split at
    # run time, even where the split costs one more shuffle downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows dealt out by project_id are not dealt out again for a join on project_id and more: what is
    # read off one table of tasks meets where it lies. A join that was split for skew is dealt out anew.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # What is shuffled is keys and numbers; texts are made after it. So a task takes in little.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Rows are dealt out finely and put together to that size, so that what a task holds does not grow
    # with the tables as it would by a fixed number of partitions.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
}


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, whatever folder they were
    started in. Where executors cannot see that folder, ship the package with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def tune(spark: SparkSession) -> SparkSession:
    importable(spark)
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    Only a local master, where driver and executors are one process, may do without: it gets a
    temporary folder. A cluster that names no shared folder is an error, because a folder of
    one machine loses data with that machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="planloom-checkpoint-")
    context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise to the reliable checkpoint folder, so a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A folder every executor can reach, for tables written between jobs."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables"


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back: later stages neither
    recompute it nor depend on the executors that made it."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    frame = df.sparkSession.read.schema(df.schema).parquet(path)
    frame.stored_at = path
    return frame


def discard(frame: DataFrame) -> None:
    """Delete what stored() wrote, once nothing lazy reads it any more: a loop's last round, after the
    next one has been written."""
    spark = frame.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored_bucketed(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Like stored(), dealt out and sorted by the keys for good: joins by them do not shuffle this side.
    What lies by the keys in so many parts already is not moved to be written."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"planloom_{uuid.uuid4().hex}", f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.repartition(parts, *keys).write.format("parquet").bucketBy(parts, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    frame = spark.table(name)
    frame.stored_at, frame.stored_as = path, name
    return frame


def drop_bucketed(frame: DataFrame) -> None:
    frame.sparkSession.sql(f"DROP TABLE IF EXISTS {frame.stored_as}")
    discard(frame)
