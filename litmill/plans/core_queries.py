"""Queries over packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litmill.operators.packed_values import split_packed
from litmill.plans.catalog import query
from litmill.session import table


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "papers"), "paper_id", "tags", "tag_pos", "tag").drop("flag").distinct()


@query()
def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    """How many values were read with each flag, and how many places were empty."""
    v = split_packed(table(spark, d, "papers"), "paper_id", "tags", empties=True)
    return v.groupBy("flag").count()
