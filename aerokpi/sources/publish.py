"""Publishing a dataset as one step: readers see the old version or the new one.

Data is written beside its place first. A folder is then exchanged by two renames, the old
one being put back if the second fails; a catalog table is pointed at its new folder by one
change of its location. A write that fails leaves what was published untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"can't rename {source} to {target}")


def publish_folder(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), **options) -> None:
    """Replace the dataset at ``path``. The new files are complete before the old ones move;
    the folders beside it that this takes begin with ``_`` and are gone afterwards."""
    spark, path = df.sparkSession, path.rstrip("/")
    fs, place = _files(spark, path)
    mark = uuid.uuid4().hex[:12]
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    staged = jvm_path(place.getParent(), f"_staged-{place.getName()}-{mark}")
    old = jvm_path(place.getParent(), f"_old-{place.getName()}-{mark}")
    writer = df.write.format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.save(staged.toString())
    except BaseException:
        fs.delete(staged, True)
        raise
    had = fs.exists(place)
    if had:
        _rename(fs, place, old)
    try:
        _rename(fs, staged, place)
    except BaseException:
        if had:
            _rename(fs, old, place)
        fs.delete(staged, True)
        raise
    if had:
        fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def publish_table(df: DataFrame, table: str, fmt: str = "parquet") -> str:
    """Replace the catalog table ``database.table`` with ``df`` and return its folder.

    Each version is a folder of its own below the database's; the table is created over the
    first and then moved from one to the next. The version before the last is kept, so that
    queries under way can end; older ones are deleted. A session that has read the table
    keeps to its version until it refreshes the table. A change of columns replaces the
    table's entry (its data being complete by then)."""
    spark = df.sparkSession
    database, name = table.split(".")
    root = f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{name}-versions"
    fs, folder = _files(spark, root)
    known = {str(f.getPath().getName()): f.getModificationTime() for f in fs.listStatus(folder)} if fs.exists(folder) else {}
    version = f"{root}/{max([int(v.split('-')[0]) for v in known], default=0) + 1:08d}-{uuid.uuid4().hex[:8]}"
    try:
        df.write.format(fmt).save(version)
    except BaseException:
        fs.delete(_files(spark, version)[1], True)
        raise
    exists = spark.catalog.tableExists(table)
    if exists and spark.table(table).schema.simpleString() == spark.read.format(fmt).load(version).schema.simpleString():
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{version}'")
    else:
        if exists:
            spark.sql(f"DROP TABLE {table}")
        spark.catalog.createTable(table, path=version, source=fmt)
    spark.catalog.refreshTable(table)
    for old in sorted(known)[:-1]:
        fs.delete(_files(spark, f"{root}/{old}")[1], True)
    return version
