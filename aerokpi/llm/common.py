"""Shared helpers: written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without that
    setting gets a folder of its own; on a cluster its absence is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="aerokpi-llm-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


#: Deletes a query's shuffle files when it ends; otherwise they lie until the driver collects garbage.
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """`df` as a table in the shared folder: computed once, lineage cut. `tidy` deletes the
    shuffle files of the write as soon as the table is there."""
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_FILE_CLEANUP, "false")
    if tidy:
        conf.set(_FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            conf.set(_FILE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by `written` that no later plan reads."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            jvm = spark._jvm
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts that are in flight between Spark and a Python worker at once.
BATCH_ROWS = "4000"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path
    (a session started elsewhere; a cluster job that ships the package itself needs no
    copy), and lower Arrow's rows a batch from Spark's default, unless the session set them."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, BATCH_ROWS)
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="aerokpi-py-")) / "aerokpi.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.joinpath("aerokpi").rglob("*.py")):
            z.write(file, file.relative_to(root))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
