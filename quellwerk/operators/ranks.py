"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.session import cut_lineage


def salted_rank(df: DataFrame, group: str, key: str, width: int = 1024) -> DataFrame:
    """df with rank from 0 by an integer key within each group, without a task per group.

    Keys fall into ranges of `width`; a rank is the count of all lower ranges of the
    group and the place within the own range. Equal keys get different ranks.
    """
    ranged = df.withColumn("_range", F.floor(F.col(key) / F.lit(width)))
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(key)) - 1
    return ranged.withColumn("_within", within).join(bases, [group, "_range"]).withColumn("rank", F.col("_base") + F.col("_within")).drop("_range", "_within", "_base")


def ranged_rank(df: DataFrame, group: str, order: list[Column], into: str = "rank") -> DataFrame:
    """df with rank from 0 in any order within each group, without a task per group.

    Rows are split into ranges of group and order, so that a group of many rows lies in
    several; a rank is the count of the group's rows in lower ranges and the place
    within the own one.
    """
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    placed = cut_lineage(df.select("*", *keys).repartitionByRange(group, *names).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"))  # a row a group and range
    bases = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base_rank"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*names)) - 1
    return placed.withColumn("_within", within).join(bases, [group, "_range"]).withColumn(into, F.col("_base_rank") + F.col("_within")).drop("_range", "_within", "_base_rank", *names)
