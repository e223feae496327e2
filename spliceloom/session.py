"""Session settings and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session that this package creates itself.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, app: str = "spliceloom", **conf: str) -> SparkSession:
    """A session with this package's defaults; ``conf`` overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return b.config(map=DEFAULTS | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none and runs in this process alone (tests, one machine), a local
    folder is set; elsewhere executors would write to disks of their own, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{master} needs spark.checkpoint.dir, a folder that driver and executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"spliceloom-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This session's own folder inside the shared one."""
    if not (name := spark.conf.get("spliceloom.session", None)):
        name = uuid.uuid4().hex
        spark.conf.set("spliceloom.session", name)
    return f"{shared_dir(spark)}/spliceloom/{name}"


def written(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs inside hands rows to Python in batches of ``most`` bytes, about."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a plain scan of files, of which ``_metadata`` tells file and row."""
    plan = getattr(df, "_jdf", None)
    return plan is not None and "_metadata" not in df.columns and plan.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def remove_written(spark: SparkSession) -> None:
    """Delete every table that this session left in the shared folder."""
    _delete(spark, work_dir(spark))
