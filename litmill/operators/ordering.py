"""Row numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litmill.session import materialize


def numbered(df: DataFrame, by: str, order: str, name: str = "n") -> DataFrame:
    """df with the number from 1 of each row within `by` in the order of `order`, which has to be unique there.

    A window over `by` alone would sort a hot key in one task. Here rows are range-partitioned by
    (by, order), numbered within their partition, and shifted by the counts of the partitions before.
    """
    parts = materialize(df.repartitionByRange(F.col(by), F.col(order)).withColumn("_part", F.spark_partition_id()))
    count = parts.groupBy(by, "_part").agg(F.count("*").alias("_count"))
    before = F.sum("_count").over(W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    shift = count.select(F.col(by).alias("_by"), F.col("_part").alias("_at"), F.coalesce(before, F.lit(0)).alias("_shift"))
    local = parts.withColumn("_local", F.row_number().over(W.partitionBy(by, "_part").orderBy(order)))
    j = local.join(shift, local[by].eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")))
    return j.withColumn(name, (F.col("_local") + F.col("_shift")).cast("int")).drop("_part", "_local", "_by", "_at", "_shift")
