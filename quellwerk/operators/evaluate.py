"""Evaluation of rankings: hit rate, reciprocal rank, discounted gain, section routing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 5, 10, 20)


def judged(ranking: DataFrame, queries: DataFrame, kmax: int = 20) -> DataFrame:
    """One row per query: (query columns, first_rank from 0 or null, relevant ranks ARRAY).

    ranking: (query_id, rank from 1, relevant BOOLEAN); queries without a ranked row stay as misses.
    """
    hits = ranking.where((F.col("rank") <= kmax) & F.col("relevant")).groupBy("query_id")
    found = hits.agg((F.min("rank") - 1).alias("first_rank"), F.array_sort(F.collect_list("rank")).alias("ranks"))
    return queries.join(found, "query_id", "left")


def recall_at(k: int) -> Column:
    return F.avg(F.coalesce((F.col("first_rank") < k).cast("int"), F.lit(0)))


def reciprocal_rank() -> Column:
    return F.avg(F.coalesce(1 / (F.col("first_rank") + 1), F.lit(0.0)))


def ndcg_at(k: int, kmax: int = 20) -> Column:
    """Binary gains; the ideal list holds the relevant items among the first kmax that were retrieved."""
    ranks = F.coalesce("ranks", F.array().cast("array<int>"))
    gain = F.aggregate(F.filter(ranks, lambda r: r <= k), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    ideals = [0.0]
    for i in range(k):
        ideals.append(ideals[-1] + 1 / math.log2(i + 2))
    ideal = F.get(F.array(*map(F.lit, ideals)), F.least(F.size(ranks), F.lit(k)))
    return F.avg(F.when(ideal > 0, gain / ideal).otherwise(0.0))


def metrics(per_query: DataFrame, by: tuple[str, ...] = (), cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Metrics over all queries, or per group; a query without a hit counts as a miss."""
    columns = [F.count("*").alias("queries"), F.count("first_rank").alias("queries_with_hit")]
    columns += [F.round(recall_at(k), 6).alias(f"recall_{k}") for k in cuts] + [F.round(ndcg_at(k), 6).alias(f"ndcg_{k}") for k in cuts]
    return per_query.groupBy(*by).agg(*columns, F.round(reciprocal_rank(), 6).alias("mrr"))


def improvement(score: str, chance: str) -> Column:
    """A metric relative to that of chance; null where chance is 0."""
    return F.when(F.col(chance) > 0, F.round(F.col(score) / F.col(chance), 6))


def routing_accuracy(ranking: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of all queries whose first result has the gold section's name, in any case."""
    first = ranking.where("rank = 1").select("query_id", F.upper("section_name").alias("found"))
    joined = queries.join(first, "query_id", "left")
    return joined.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce((F.col("found") == F.upper("gold_name")).cast("int"), F.lit(0))), 6).alias("accuracy"))
