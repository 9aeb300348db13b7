"""Session settings for local runs; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# size-independent settings that the operators profit from on any cluster
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # do not record the Python stack of every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: str | int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("apexgrid")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        # small tables: keep all cores busy
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application; its files are a few dozen kilobytes."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the cluster's ``spark.checkpoint.dir``.

    Inside :func:`temporary_tables` it is the folder of the block. Only a session whose executors are threads of the driver may go without that setting; it gets a temporary folder.
    On a cluster a machine-local folder would lose rows, so there the missing setting is an error.
    """
    if (scope := _scope.get()) is not None:
        return scope
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set; on {master} it has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[str]:
    """Tables and archives that are written inside the block go when it ends. Results have to be written out before that.

    ``with temporary_tables(spark): query(spark, path).write.parquet(out)``
    """
    base = shared_folder(spark)
    folder = f"{base}/scope-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialised(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows written once as Parquet and read back, for results that several later steps use.

    The table goes below ``shared_folder``, so it survives lost executors and its real size is known to the optimizer.
    The shuffle files of the step are dropped as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=list(partition_by) or None)
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
