"""Splits that keep related records together.

Records and entities form a bipartite graph. Every entity starts with itself as
label; in each round a record takes the least label of its entities, an entity the
least of its records, and labels are shortened by following label to label, until
nothing changes. Groups are then assigned to splits: the few groups that hold more
than a fixed part of all records one by one, least deviation first; all others by
position on a line per stratum that is cut in proportion to what each split still
needs there, positions being computed from bucket sums.

Defined cases: records or entities that are null join nothing; repeated edges count
once; an empty edge table gives no labels; records of no group stay unassigned;
strata beyond the STRATA most frequent count as one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quellwerk.session import cut_lineage, read_table

HEAVY_PART = 1 / 1000
BUCKETS = 128
#: Strata whose distribution is kept apart; it bounds what the driver plans with.
STRATA = 256


def propagate_labels(edges: DataFrame, record: str = "record", entity: str = "entity") -> DataFrame:
    """(entity, label): the least entity reachable over shared records, for entities that share any.

    Records with one entity change no label, so only records with several take part;
    entities absent from the result are groups of their own.
    """
    edges = edges.select(F.col(record).alias("record"), F.col(entity).alias("entity")).where(F.col("record").isNotNull() & F.col("entity").isNotNull())
    ends = edges.groupBy("record").agg(F.min("entity").alias("low"), F.max("entity").alias("high")).where(F.col("low") < F.col("high"))
    shared = cut_lineage(edges.join(ends.select("record"), "record", "left_semi").distinct())
    labels = shared.groupBy("entity").agg(F.min("entity").alias("label"))
    while True:
        least = shared.join(labels, "entity").groupBy("record").agg(F.min("label").alias("label"))
        offered = shared.join(least, "record").groupBy("entity").agg(F.min("label").alias("offered"))
        stepped = labels.join(offered, "entity").select("entity", F.col("label").alias("old"), F.least("label", "offered").alias("label"))
        target = stepped.select(F.col("entity").alias("label"), F.col("label").alias("further"))
        jumped = stepped.join(target, "label", "left").select("entity", "old", F.coalesce("further", "label").alias("label"))
        jumped = cut_lineage(jumped)
        labels = jumped.select("entity", "label")
        if jumped.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def patient_number(column: Column | str) -> Column:
    """The number in a spelling of a patient id; null without digits."""
    return F.regexp_replace(column, "[^0-9]", "").try_cast("bigint")


def patient_name(number: Column | str) -> Column:
    return F.concat(F.lit("P"), F.lpad(F.col(number).cast("string") if isinstance(number, str) else number.cast("string"), 7, "0"))


def report_key(column: Column | str) -> Column:
    return F.lower(F.trim(column))


def clinical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_kind, record_key, entity BIGINT, stratum): reports and QA items with their patient; repeated rows once."""
    reports = read_table(spark, sf_dir, "reports").select(
        report_key("report_id").alias("record_key"), patient_number("patient_id").alias("entity"), F.coalesce(F.lower(F.trim("report_type")), F.lit("")).alias("stratum")
    )
    reports = reports.where(F.col("record_key").isNotNull()).groupBy("record_key").agg(F.min("entity").alias("entity"), F.max("stratum").alias("stratum"))
    items = read_table(spark, sf_dir, "qa_items").select(F.col("qa_id").cast("string").alias("qa_key"), report_key("report_id").alias("record_key"))
    items = items.where(F.col("record_key").isNotNull()).distinct().join(reports, "record_key")
    kinds = [reports.select(F.lit("report").alias("record_kind"), "record_key", "entity", "stratum"), items.select(F.lit("qa"), F.col("qa_key"), "entity", F.concat(F.lit("qa "), "stratum"))]
    return kinds[0].unionAll(kinds[1]).where(F.col("entity").isNotNull())


def patient_edges(spark: SparkSession, sf_dir: str, records: DataFrame) -> DataFrame:
    """(record, entity): a record for every report and item, and one for every active link with both patients."""
    links = read_table(spark, sf_dir, "patient_links").where(F.lower(F.trim("link_status")) == "active")
    links = links.select(patient_number("patient_id").alias("a"), patient_number("other_patient_id").alias("b"))
    links = links.select(F.concat_ws(" ", F.lit("link"), "a", "b").alias("record"), F.explode(F.array("a", "b")).alias("entity"))
    return records.select(F.concat_ws(" ", "record_kind", "record_key").alias("record"), "entity").unionAll(links)


def grouped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clinical_records with label BIGINT: the least patient number of the record's group."""
    records = cut_lineage(clinical_records(spark, sf_dir))  # the graph and the result both read it
    labels = propagate_labels(patient_edges(spark, sf_dir, records))
    return records.join(labels, "entity", "left").withColumn("label", F.coalesce("label", "entity"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    draft = read_table(spark, sf_dir, "split_draft").where(F.col("split_name").isNotNull())
    key = F.when(F.col("record_kind") == "report", report_key("record_key")).otherwise(F.trim("record_key"))
    draft = draft.select("record_kind", key.alias("record_key"), "split_name").groupBy("record_kind", "record_key").agg(F.min("split_name").alias("low"), F.max("split_name").alias("high"))
    spans = draft.join(grouped_records(spark, sf_dir), ["record_kind", "record_key"]).groupBy("label").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return spans.where(F.col("low") != F.col("high")).select(patient_name("label").alias("group_id"))


def place_heavy(sizes: dict[object, dict[str, int]], need: dict[str, dict[str, float]]) -> dict[object, str]:
    """Split of each heavy group, largest first: the one whose squared relative deviation ends least. Reduces need."""
    placed = {}
    for group, parts in sorted(sizes.items(), key=lambda x: (-sum(x[1].values()), str(x[0]))):

        def worse(split: str, parts: dict[str, int] = parts) -> float:
            return sum(((need[split][s] - n) ** 2 - need[split][s] ** 2) / max(1.0, sum(need[x][s] for x in need)) for s, n in parts.items())

        split = min(sorted(need), key=worse)
        for s, n in parts.items():
            need[split][s] -= n
        placed[group] = split
    return placed


def assign_groups(records: DataFrame, plan: dict[str, float], group: str = "label", stratum: str = "stratum") -> DataFrame:
    """(group, records BIGINT, split_name): every group in one split, shares and strata as near the plan as groups allow.

    The driver sees sums by stratum and by bucket, and at most 1 / HEAVY_PART heavy groups.
    """
    spark = records.sparkSession
    parts = cut_lineage(records.groupBy(F.col(group).alias("group"), F.col(stratum).alias("stratum")).agg(F.count("*").alias("n")))
    frequent = parts.groupBy("stratum").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "stratum").limit(STRATA)
    named = frequent.select("stratum", F.col("stratum").alias("own"))
    parts = parts.join(F.broadcast(named), "stratum", "left").groupBy("group", F.coalesce("own", F.lit("")).alias("stratum")).agg(F.sum("n").alias("n"))
    groups = parts.groupBy("group").agg(F.sum("n").alias("records"), F.max_by("stratum", F.struct("n", "stratum")).alias("stratum"))
    groups = cut_lineage(groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(BUCKETS)).cast("int")))
    strata = {r["stratum"]: r["n"] for r in parts.groupBy("stratum").agg(F.sum("n").alias("n")).collect()}
    total, share = sum(strata.values()), sum(plan.values()) or 1.0
    need = {split: {s: n * part / share for s, n in strata.items()} for split, part in plan.items()}
    heavy = groups.where(F.col("records") > F.lit(total * HEAVY_PART))
    sizes: dict[object, dict[str, int]] = {}
    for r in parts.join(F.broadcast(heavy.select("group")), "group", "left_semi").collect():
        sizes.setdefault(r["group"], {})[r["stratum"]] = r["n"]
    placed = place_heavy(sizes, need)
    light = groups.where(F.col("records") <= F.lit(total * HEAVY_PART))
    sums = light.groupBy("stratum", "bucket").agg(F.sum("records").alias("n")).toPandas().sort_values(["stratum", "bucket"])
    rows, splits = [], sorted(plan)
    for s, own in sums.groupby("stratum"):
        cuts = np.cumsum([max(0.0, need[x][s]) for x in splits])
        cuts = cuts / cuts[-1] * own["n"].sum() if cuts[-1] > 0 else np.full(len(splits), own["n"].sum())
        base = own["n"].cumsum() - own["n"]
        rows += [(s, int(b), int(at), [float(c) for c in cuts]) for b, at in zip(own["bucket"], base)]
    shape = "stratum string, bucket int, base bigint, cuts array<double>"
    line = spark.createDataFrame(rows, shape)
    order = Window.partitionBy("stratum", "bucket").orderBy(F.xxhash64("group"), "group")
    light = light.withColumn("middle", F.sum("records").over(order) - F.col("records") / 2).join(F.broadcast(line), ["stratum", "bucket"])
    nth = F.size(F.filter("cuts", lambda c: c <= F.col("middle") + F.col("base")))
    light = light.select("group", "records", F.get(F.array(*map(F.lit, splits)), F.least(nth, F.lit(len(splits) - 1))).alias("split_name"))
    chosen = spark.createDataFrame(list(placed.items()), f"group {groups.schema['group'].dataType.simpleString()}, split_name string")
    return light.unionByName(heavy.join(F.broadcast(chosen), "group").select("group", "records", "split_name"))


def split_plan(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Share by split: a handful of rows."""
    return {r["split_name"]: r["share"] for r in read_table(spark, sf_dir, "split_plan").where("split_name is not null and share > 0").collect()}


def p4_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, records, split_name) under the shares of split_plan."""
    return assign_groups(grouped_records(spark, sf_dir), split_plan(spark, sf_dir)).select(patient_name("group").alias("group_id"), "records", "split_name")


def p4_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split_name, stratum, records, share, deviation): how far the assignment's share of each stratum is from the plan's."""
    records, plan = cut_lineage(grouped_records(spark, sf_dir)), split_plan(spark, sf_dir)
    placed = records.join(assign_groups(records, plan).select(F.col("group").alias("label"), "split_name"), "label")
    counts = placed.groupBy("stratum", "split_name").agg(F.count("*").alias("records"))
    totals = counts.groupBy("stratum").agg(F.sum("records").alias("total"))
    shares = spark.createDataFrame([(k, v / sum(plan.values())) for k, v in plan.items()], "split_name string, planned double")
    share = F.col("records") / F.col("total")
    return counts.join(totals, "stratum").join(F.broadcast(shares), "split_name").select("split_name", "stratum", "records", F.round(share, 6).alias("share"), F.round(share - F.col("planned"), 6).alias("deviation"))
