"""Session helpers: one place for the settings every job here relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "textlab", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``.  Only a local master, whose
    one machine shares everything, may do without: it gets a scratch folder."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="textlab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def tables_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


#: The setting that removes a query's shuffle files when it ends.  A written table does not need those of its own making.
_SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffle_files_removed(spark: SparkSession):
    before = spark.conf.get(_SHUFFLE_FILES)
    spark.conf.set(_SHUFFLE_FILES, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_FILES, before)


def cut_lineage(df, **options):
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and
    continue from it.  Like a reliable checkpoint it cuts the lineage and
    survives lost executors; unlike an RDD checkpoint it computes ``df`` only
    once (no second pass to write) and reads back columnar, with pruning.
    The shuffle files of its making go at once.  :func:`drop_table` deletes a table
    that no later step reads, :func:`drop_tables` all; it also runs when the program
    ends.  ``options`` are the writer's."""
    path = table_path(df.sparkSession)
    with _shuffle_files_removed(df.sparkSession):
        df.write.mode("overwrite").options(**options).parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._table = path
    return out


def drop_table(df) -> None:
    """Delete the table that :func:`cut_lineage` returned as ``df``; nothing may be read from it after."""
    _delete(df.sparkSession, df._table)


def table_path(spark: SparkSession) -> str:
    """A new path for an intermediate table, deleted as those of :func:`cut_lineage`."""
    if spark.sparkContext.applicationId not in _registered:
        _registered.add(spark.sparkContext.applicationId)
        atexit.register(_drop_at_exit, spark)
    return f"{tables_dir(spark)}/{uuid.uuid4().hex}"


_registered: set[str] = set()


def drop_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application.  Call it when the
    results of its queries have been written or collected."""
    _delete(spark, tables_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _drop_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        drop_tables(spark)
