"""Import manifest: which files are new or changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import upsert

ENTRY = "supplier string, path string, size long, mtime double, content_hash string, imported_at string"
#: Bytes up to which a file is hashed as one value; a larger one by its lines, in any number of tasks.
ONE_VALUE = 1 << 28


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime, content_hash) of the files under a path; contents are hashed where they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    about = lambda h: ("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), h.alias("content_hash"))
    small = files.where(F.col("length") <= ONE_VALUE).select(*about(F.sha2("content", 256)))
    large = files.where(F.col("length") > ONE_VALUE).select(*about(F.lit(None).cast("string")))  # the content isn't read
    for r in large.select("path").collect():  # a handful of files, of a gigabyte or more each
        lines = spark.read.text(r.path).select(F.xxhash64("value").alias("h"), F.xxhash64("value", F.lit(1)).alias("g"))
        total = lines.agg(F.concat_ws("-", F.lit("lines"), F.count("*"), F.hex(F.bit_xor("h")), F.sum(F.col("g").cast("decimal(38,0)")).cast("string"))).scalar()
        large = large.withColumn("content_hash", F.when(F.col("path") == r.path, F.lit(total)).otherwise(F.col("content_hash")))
    return small.unionAll(large)


def known_files(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's latest entry of each supplier and path; entries are only ever appended."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], ENTRY)
    rows = spark.read.schema(ENTRY).parquet(path)
    last = rows.groupBy("supplier", "path").agg(F.max_by(F.struct("size", "mtime", "content_hash", "imported_at"), "imported_at").alias("x"))
    return last.select("supplier", "path", "x.*")


def register(files: DataFrame, path: str) -> None:
    """Append the entries of imported files (supplier, path, size, mtime, content_hash), with the time."""
    rows = files.withColumn("imported_at", F.current_timestamp().cast("string"))
    rows.select(*(c.split()[0] for c in ENTRY.split(", "))).coalesce(1).write.mode("append").parquet(path)


def to_import(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest doesn't hold with equal size, time and content."""
    keys = ["supplier", "path", "size", "mtime", "content_hash"]
    return files.join(manifest.select(*keys), keys, "left_anti")


def registered(manifest: DataFrame, imported: DataFrame) -> DataFrame:
    """The manifest with the imported files in place of their older entries."""
    return upsert(manifest, imported, ["supplier", "path"])
