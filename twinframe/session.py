"""Session settings, and the shared folder in which long lineages are cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(app: str = "twinframe", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library relies on; cluster settings win when present."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own: on a cluster a machine-local
    path would be lost together with the executor that wrote it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="twinframe-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, tasks: int = 0) -> DataFrame:
    """The rows dealt out evenly over so many tasks, or as many as a shuffle has.

    For narrow rows, which lie in few files, before each of them becomes much work or a wide row.
    """
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for tables that one step writes and the next reads."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def written(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """The table written to the shared folder and read back: lineage cut, statistics and pruning kept.

    A `schema` may read stored structs as what they hold, such as vectors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Removes the scratch tables of this driver; call it once what reads them has been written."""
    hadoop, removed = spark.sparkContext._jvm.org.apache.hadoop.fs, 0
    while _SCRATCH:
        path = hadoop.Path(_SCRATCH.pop())
        removed += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return removed
