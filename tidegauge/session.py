"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session options that suit these jobs; a cluster's own settings win where it has them.
OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lets Spark limit each key to its last rows on the map side, up to the largest request.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def build(app: str = "tidegauge", master: str | None = None, **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given, own = spark.sparkContext.getConf(), spark.conf.getAll
    for key, value in OPTIONS.items():
        if not given.contains(key) and key not in own:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tidegauge-")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Folders made by this process, in order.
_made: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the intermediate copies made so far; frames that stand on them can no longer be read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        count += path.getFileSystem(conf).delete(path, True)
    return count


def cut(df: DataFrame, label: str = "cut", codec: str | None = None) -> DataFrame:
    """Write a frame once to the shared folder and go on from there.

    Later branches then all see the same rows, read only the columns they need, and a lost
    executor costs a re-read and not the work so far. The copy stays until ``release``. ``codec`` is
    the session's unless it is named.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, label)
    _made.append(folder)
    df.write.parquet(folder, compression=codec)
    return spark.read.schema(df.schema).parquet(folder)
