"""Places within groups of any size: no group is ever held or sorted by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def places(df: DataFrame, group: str, order: list[Column], out: str = "place", name: str = "ranged") -> DataFrame:
    """df with the row's place (from 1) in its group by `order`, which must tell all rows of a group apart.

    Rows are range-partitioned by group and order, so a large group lies in several partitions; each partition
    counts its own rows and the counts of earlier partitions of a group are added. What a group's offsets are
    taken from is one row for each partition that it lies in. Null is a group of its own.
    """
    ranged = stored(df.repartitionByRange(F.col(group), *order).withColumn("__part", F.spark_partition_id()), name)
    here = Window.partitionBy("__part", group).orderBy(*order)
    counts = ranged.groupBy("__part", group).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("__part").alias("__p"), F.col(group).alias("__g"), before.alias("__before"))
    rows = ranged.withColumn("__here", F.row_number().over(here)).join(offsets, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return rows.withColumn(out, (F.col("__here") + F.col("__before")).cast("int")).drop("__part", "__p", "__g", "__here", "__before")
