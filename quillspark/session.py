"""Session settings and staging of intermediate tables.

``staged`` cuts lineage by writing Parquet under the folder named in
``spark.checkpoint.dir``, which every executor and the driver share, so that a
lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASES: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(name: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; ``conf`` overrides."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where unset, a temporary one, in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_BASES:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _LOCAL_BASES[app] = tempfile.TemporaryDirectory(prefix="quillspark-", ignore_cleanup_errors=True)
    return f"file://{_LOCAL_BASES[app].name}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system, quietly if the session has ended."""
    with contextlib.suppress(Exception):
        context = spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_base(spark)}/quillspark-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows and bytes that one Arrow batch holds, for columns of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
