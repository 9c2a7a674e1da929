"""Comparisons: models of one kind against another, against chance, sections before and after merging, items per owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.functions.text import word_count
from quellwerk.operators import evaluate, retrieval
from quellwerk.operators.sections import extract_sections, merge_small
from quellwerk.plans.corpus import _MERGED
from quellwerk.plans.registry import ORACLE_SQL, query
from quellwerk.plans.search import _sql_metrics, eval_bm25_metrics, random_baseline
from quellwerk.plans.tables import SQL_ITEMS, SQL_REPORTS, SQL_SECTIONS, qa_items, reports, sections, sql_word_count
from quellwerk.session import read_table
from quellwerk.sources.files import embeddings_long

_MASKED_VECTORS = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id AND q.label = v.label WHERE q.vec_id % 20 = 0)"""


@query(f"WITH {_MASKED_VECTORS} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs QUALIFY rank <= 20")
def dense_topk_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search among the vectors of the query's own subject (its label)."""
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return retrieval.dense_topk(vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id"), vectors, 20, mask="label")


_MODELS = """vecs AS (SELECT vec_id, label, 'full' AS model, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT vec_id, label, 'half', embedding[1:32]::DOUBLE[] FROM embeddings),
    pairs AS (SELECT q.model, q.vec_id AS query_id, v.vec_id AS id, q.label AS ql, v.label AS vl, round(list_dot_product(q.e, v.e), 6) AS score FROM vecs q JOIN vecs v ON q.vec_id <> v.vec_id AND q.model = v.model WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, id) AS rank FROM pairs QUALIFY rank <= 20),
    hits AS (SELECT model, query_id, min(rank) - 1 AS first_rank, list_sort(list(rank)) AS ranks FROM ranked WHERE ql = vl GROUP BY ALL),
    judged AS (SELECT v.model, v.vec_id AS query_id, first_rank, coalesce(ranks, []) AS ranks FROM vecs v LEFT JOIN hits h ON v.vec_id = h.query_id AND v.model = h.model WHERE v.vec_id % 20 = 0)"""


@query(f"SELECT * FROM (WITH {_MODELS} SELECT model, {_sql_metrics()} FROM judged GROUP BY model) UNION ALL SELECT 'bm25_char3' AS model, * FROM ({ORACLE_SQL['eval_bm25_metrics']}) ORDER BY recall_10 DESC, model")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of metrics for each embedding model, in one job, and one for BM25; best recall at 10 first."""
    table = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("embedding_full"), F.slice("embedding", 1, 32).alias("embedding_half"))
    labels = table.select(F.col("vec_id").alias("id"), "label")
    long = embeddings_long(table, "vec_id").select(F.col("section_id").alias("id"), "model", "embedding")
    asked = long.where("id % 20 = 0").select(F.concat_ws("|", "model", "id").alias("query_id"), "id", "model", "embedding")
    found = retrieval.dense_topk(asked.drop("id"), long, 20, mask="model", same=lambda q: int(q.split("|")[1]))
    owners = asked.select("query_id", "model", F.col("id").alias("vec_id")).join(labels.select(F.col("id").alias("vec_id"), F.col("label").alias("wanted")), "vec_id")
    judged = found.join(labels, "id").join(owners, "query_id").withColumn("relevant", F.col("label") == F.col("wanted"))
    dense = evaluate.metrics(evaluate.judged(judged, owners), ("model",))
    return dense.unionByName(eval_bm25_metrics(spark, sf_dir).withColumn("model", F.lit("bm25_char3"))).orderBy(F.desc("recall_10"), "model")


@query(f"SELECT b.recall_10, r.recall_10_mean AS random_recall_10, CASE WHEN r.recall_10_mean > 0 THEN round(b.recall_10 / r.recall_10_mean, 6) END AS improvement FROM ({ORACLE_SQL['eval_bm25_metrics']}) b, ({ORACLE_SQL['random_baseline']}) r")
def improvement_over_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many times better than chance; null where chance finds nothing."""
    both = eval_bm25_metrics(spark, sf_dir).select("recall_10").join(F.broadcast(random_baseline(spark, sf_dir).select(F.col("recall_10_mean").alias("random_recall_10"))))  # two frames of one row
    return both.withColumn("improvement", evaluate.improvement("recall_10", "random_recall_10"))


_PER = "count(*) AS units, round(avg(n), 6) AS mean_n, max(n)::BIGINT AS max_n, median(n) AS median_n, min(n)::BIGINT AS min_n, sum(n)::BIGINT AS total"


@query(
    f"""WITH {SQL_ITEMS}, {SQL_REPORTS}, owned AS (SELECT qa_id, r.report_id, r.patient_id FROM items JOIN reps r ON items.report_key = lower(trim(r.report_id))),
    by_patient AS (SELECT count(*) AS n FROM owned WHERE patient_id IS NOT NULL GROUP BY patient_id), by_report AS (SELECT count(*) AS n FROM owned GROUP BY report_id)
    SELECT 'patient' AS unit, {_PER} FROM by_patient UNION ALL SELECT 'report', {_PER} FROM by_report"""
)
def item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA items per patient and per report."""
    owner = reports(spark, sf_dir, "patient_id").select(F.lower(F.trim("report_id")).alias("report_key"), "report_id", "patient_id")
    per = qa_items(spark, sf_dir, "report_id").select("report_key").join(owner, "report_key").groupBy("patient_id", "report_id").agg(F.count("*").alias("n"))
    return owner_stats(per)


def owner_stats(per: DataFrame) -> DataFrame:
    """(unit, units, mean_n, max_n, median_n, min_n, total) of counts n per patient_id and report_id."""
    out = []
    for unit in ("patient", "report"):
        counts = per.where(F.col(f"{unit}_id").isNotNull()).groupBy(f"{unit}_id").agg(F.sum("n").alias("n"))
        numbers = [F.count("*").alias("units"), F.round(F.avg("n"), 6).alias("mean_n"), F.max("n").alias("max_n"), F.median("n").alias("median_n"), F.min("n").alias("min_n"), F.sum("n").alias("total")]
        out.append(counts.agg(*numbers).select(F.lit(unit).alias("unit"), "*"))
    return out[0].unionAll(out[1])


@query(
    f"""WITH RECURSIVE {SQL_REPORTS}, {_MERGED}, both_stages AS (SELECT 'original' AS stage, upper(name) AS section_name, n AS words FROM parts_n UNION ALL SELECT 'merged', upper(name), {sql_word_count('body')} FROM merged),
    per AS (SELECT section_name, count(*) FILTER (stage = 'original') AS before, count(*) FILTER (stage = 'merged') AS after, coalesce(avg(words) FILTER (stage = 'original'), 0) AS words_before, coalesce(avg(words) FILTER (stage = 'merged'), 0) AS words_after FROM both_stages GROUP BY 1)
    SELECT section_name, before, after, after - before AS delta, round(words_before, 6) AS words_before, round(words_after, 6) AS words_after FROM per ORDER BY before DESC, section_name LIMIT 20"""
)
def merge_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent section names: how many there are, and their words, before and after merging."""
    df = reports(spark, sf_dir, "content").select(extract_sections("content").alias("a")).select("a", merge_small(F.col("a")).alias("b"))
    sides = [df.select(F.lit(name).alias("stage"), F.explode(c).alias("s")) for name, c in (("original", "a"), ("merged", "b"))]
    flat = sides[0].unionAll(sides[1]).select("stage", F.upper("s.name").alias("section_name"), word_count("s.body").alias("words"))
    of = lambda stage, value: F.when(F.col("stage") == stage, value)
    per = flat.groupBy("section_name").agg(
        F.count(of("original", F.lit(1))).alias("before"), F.count(of("merged", F.lit(1))).alias("after"), F.round(F.coalesce(F.avg(of("original", F.col("words"))), F.lit(0.0)), 6).alias("words_before"), F.round(F.coalesce(F.avg(of("merged", F.col("words"))), F.lit(0.0)), 6).alias("words_after")
    )
    return per.withColumn("delta", F.col("after") - F.col("before")).orderBy(F.desc("before"), "section_name").limit(20)


@query(f"WITH {SQL_SECTIONS} SELECT upper(trim(section_name)) AS section_name, count(*) AS n FROM secs WHERE section_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, section_name LIMIT 20")
def most_common_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report of section names; the limit is the feature."""
    return sections(spark, sf_dir, "section_name").where("section_name is not null").groupBy(F.upper(F.trim("section_name")).alias("section_name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section_name").limit(20)


@query("SELECT section_id, model, len(embedding) AS dims FROM (SELECT vec_id AS section_id, 'full' AS model, embedding FROM embeddings UNION ALL SELECT vec_id, 'half', embedding[1:32] FROM embeddings) WHERE len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0")
def embedding_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a column per model as one long table, vectors that are not finite left out."""
    table = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("section_id"), F.col("embedding").alias("embedding_full"), F.slice("embedding", 1, 32).alias("embedding_half"))
    return embeddings_long(table).select("section_id", "model", F.size("embedding").alias("dims"))
