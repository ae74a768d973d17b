"""Session helpers: the shared folder for tables that cut lineage, and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset a local session gets a temporary one.

    On a cluster a machine's own folder isn't seen by the other executors, so the setting must be there.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pricemill-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The result's lineage starts at replicated/shared files, so a lost executor costs only its running
    tasks. The table lies under the application's id; drop_stored() removes all of them. The shuffle files of
    the write go with it, as nothing reads them again; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pricemill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete every table that stored() has written in this application."""
    sc = spark.sparkContext
    base = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pricemill-{sc.applicationId}")
    base.getFileSystem(sc._jsc.hadoopConfiguration()).delete(base, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors once an application, so that they need no installed copy."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pricemill-code-"), "pricemill.zip")  # the driver serves it from here
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
