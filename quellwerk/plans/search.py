"""Retrieval over sections, reports and vectors, and its evaluation.

Searches take every QA item (or vector) whose id is divisible by 20 as a query,
against all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.functions.text import fts_terms
from quellwerk.operators import evaluate, retrieval
from quellwerk.plans.registry import query
from quellwerk.plans.stems import sql_stems
from quellwerk.plans.tables import SQL_ITEMS, SQL_PATIENTS, SQL_REPORTS, SQL_SECTIONS, patients, qa_items, reports, sections
from quellwerk.session import cut_lineage, read_table, spread

_NORM = "replace(trim(regexp_replace(lower(coalesce({0}, '')), '[^0-9a-zA-ZäöüÄÖÜß]+', ' ', 'g')), ' ', '_')"
_GRAMS = "CASE WHEN t = '' THEN 0 ELSE greatest(length(t) - 2, 1) END"


def _sql_grams(source: str, keep: str) -> str:
    return f"SELECT {keep}, {_GRAMS} AS dl, CASE WHEN length(t) >= 3 THEN substr(t, i, 3) ELSE t END AS term FROM (SELECT *, unnest(range(1, {_GRAMS} + 1)) AS i FROM {source})"


_POSTINGS = f"""docs AS (SELECT section_id AS id, patient_id, section_name, {_NORM.format('section_content')} AS t FROM secs),
    dg AS ({_sql_grams('docs', 'id, patient_id')}),
    post AS MATERIALIZED (SELECT id, patient_id, dl, term, count(*) AS tf FROM dg GROUP BY ALL),
    asked AS MATERIALIZED (SELECT qa_id AS query_id, items.section_id AS gold_id, question, items.section_name AS gold_name, phenomena, secs.patient_id FROM items LEFT JOIN secs USING (section_id) WHERE qa_id % 20 = 0),
    qg AS MATERIALIZED (SELECT DISTINCT query_id, patient_id, term FROM ({_sql_grams("(SELECT query_id, patient_id, " + _NORM.format('question') + " AS t FROM asked)", "query_id, patient_id")}))"""
_WEIGHT = "ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
_GLOBAL = f"""{_POSTINGS}, lens AS (SELECT DISTINCT id, dl FROM post), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
    dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def _section_index(spark: SparkSession, sf_dir: str, *columns: str, cut=retrieval.cut_grams, asked: DataFrame | None = None) -> DataFrame:
    """Terms of all sections (of `asked`, with text, only theirs), written once and read by the counting and the scoring pass."""
    only = None if asked is None else retrieval.asked_terms(asked, "text", cut)
    return cut_lineage(retrieval.search_index(sections(spark, sf_dir, "section_content", *columns, even=True), "section_id", "section_content", cut, columns, only))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, question) of the stated query set, for searches that need no owner."""
    return qa_items(spark, sf_dir, "question").where("qa_id % 20 = 0").select(F.col("qa_id").alias("query_id"), "question")


def asked_items(spark: SparkSession, sf_dir: str, owner_col: str = "patient_id") -> DataFrame:
    """(query_id, gold_id, question, gold_name, phenomena, patient_id) of the stated query set; the patient (or report) is that of the gold section."""
    items = qa_items(spark, sf_dir, "section_id", "question", "section_name", "phenomena").where("qa_id % 20 = 0")
    owner = sections(spark, sf_dir, owner_col).select("section_id", owner_col)
    return items.join(owner, "section_id", "left").select(F.col("qa_id").alias("query_id"), F.col("section_id").alias("gold_id"), "question", F.col("section_name").alias("gold_name"), "phenomena", owner_col)


_ALL = f"""WITH {SQL_SECTIONS}, {SQL_ITEMS}, {_GLOBAL}, positive AS MATERIALIZED (SELECT query_id, id, round(sum({_WEIGHT}), 6) AS score FROM (SELECT query_id, term FROM qg) JOIN post USING (term) JOIN dfs USING (term), tot GROUP BY ALL),
    scored AS (SELECT query_id, id, coalesce(score, 0) AS score FROM (SELECT asked.query_id, docs.id FROM asked, docs) LEFT JOIN positive USING (query_id, id))"""


@query(f"{_ALL} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character-gram BM25 over all sections, ten best a question; sections that score 0 rank last."""
    asked = cut_lineage(_questions(spark, sf_dir).withColumnRenamed("question", "text"))
    index = _section_index(spark, sf_dir, asked=asked)
    return retrieval.with_zero_scores(cut_lineage(retrieval.bm25_search(index, asked, 10)), asked.select("query_id"), index.select("id"), 10)


_MASKED = f"""positive AS MATERIALIZED (SELECT query_id, id, round(sum({_WEIGHT}), 6) AS score FROM qg JOIN post USING (term, patient_id) JOIN dfs USING (term), tot GROUP BY ALL),
    scored AS MATERIALIZED (SELECT query_id, id, coalesce(score, 0) AS score FROM (SELECT asked.query_id, docs.id FROM asked JOIN docs USING (patient_id)) LEFT JOIN positive USING (query_id, id)),
    ranked AS MATERIALIZED (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 20),
    hits AS (SELECT query_id, min(rank) - 1 AS first_rank, list_sort(list(rank)) AS ranks FROM ranked JOIN asked USING (query_id) WHERE id = gold_id GROUP BY query_id),
    judged AS (SELECT asked.*, first_rank, coalesce(ranks, []) AS ranks FROM asked LEFT JOIN hits USING (query_id))"""


def _sql_metrics() -> str:
    parts = ["count(*) AS queries", "count(first_rank) AS queries_with_hit"]
    for k in evaluate.CUTS:
        parts.append(f"round(avg(coalesce(CAST(first_rank < {k} AS INT), 0)), 6) AS recall_{k}")
        gain = f"list_sum(list_transform(list_filter(ranks, lambda r: r <= {k}), lambda r: 1 / log2(r + 1)))"
        ideal = f"list_sum(list_transform(range(least(len(ranks), {k})), lambda i: 1 / log2(i + 2)))"
        parts.append(f"round(avg(CASE WHEN len(ranks) > 0 THEN coalesce({gain}, 0) / {ideal} ELSE 0 END), 6) AS ndcg_{k}")
    return ", ".join([*parts, "round(avg(coalesce(1 / (first_rank + 1), 0)), 6) AS mrr"])


def _patient_ranking(spark: SparkSession, sf_dir: str, k: int = 20, mask: str = "patient_id") -> tuple[DataFrame, DataFrame]:
    """The questions, and the k best sections of each one's patient (or report); statistics of the whole collection, sections that score 0 rank last."""
    asked = cut_lineage(asked_items(spark, sf_dir, mask))
    queries = asked.select("query_id", F.col("question").alias("text"), mask)
    index = _section_index(spark, sf_dir, mask)
    ranking = cut_lineage(retrieval.bm25_search(index, queries, k, mask=mask))
    ranking = retrieval.with_zero_scores(ranking, queries, index.select("id", mask).where(F.col(mask).isNotNull()), k, mask)
    return asked, ranking.join(asked.select("query_id", "gold_id"), "query_id").withColumn("relevant", F.col("id") == F.col("gold_id"))


@query(f"WITH {SQL_SECTIONS}, {SQL_ITEMS}, {_GLOBAL}, {_MASKED} SELECT {_sql_metrics()} FROM judged")
def eval_bm25_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the question's patient, statistics of the whole collection."""
    asked, ranking = _patient_ranking(spark, sf_dir)
    return evaluate.metrics(evaluate.judged(ranking, asked))


@query(f"WITH {SQL_SECTIONS}, {SQL_ITEMS}, {_GLOBAL.replace('patient_id', 'report_id')}, {_MASKED.replace('patient_id', 'report_id')} SELECT {_sql_metrics()} FROM judged")
def eval_bm25_same_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the gold section's report, statistics of the whole collection."""
    asked, ranking = _patient_ranking(spark, sf_dir, mask="report_id")
    return evaluate.metrics(evaluate.judged(ranking, asked))


@query(f"WITH {SQL_SECTIONS}, {SQL_ITEMS}, {_GLOBAL}, {_MASKED} SELECT upper(trim(gold_name)) AS section_name, count(*) AS queries, round(avg(coalesce(CAST(first_rank < 10 AS INT), 0)), 6) AS recall_10 FROM judged GROUP BY 1")
def eval_recall_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, ranking = _patient_ranking(spark, sf_dir)
    per = evaluate.judged(ranking, asked)
    return per.groupBy(F.upper(F.trim("gold_name")).alias("section_name")).agg(F.count("*").alias("queries"), F.round(evaluate.recall_at(10), 6).alias("recall_10"))


@query(
    f"""WITH {SQL_SECTIONS}, {SQL_ITEMS}, {_GLOBAL}, {_MASKED}, tagged AS (SELECT first_rank, unnest(CASE WHEN coalesce(len(phenomena), 0) = 0 THEN ['NONE'] ELSE list_transform(phenomena, lambda p: upper(p)) END) AS phenomenon FROM judged)
    SELECT phenomenon, count(*) AS queries, round(avg(coalesce(CAST(first_rank < 10 AS INT), 0)), 6) AS recall_10 FROM tagged GROUP BY 1"""
)
def eval_recall_by_phenomenon(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, ranking = _patient_ranking(spark, sf_dir)
    tags = F.when(F.coalesce(F.size("phenomena"), F.lit(0)) <= 0, F.array(F.lit("NONE"))).otherwise(F.transform("phenomena", lambda p: F.upper(p)))
    per = evaluate.judged(ranking, asked).withColumn("phenomenon", F.explode(tags))
    return per.groupBy("phenomenon").agg(F.count("*").alias("queries"), F.round(evaluate.recall_at(10), 6).alias("recall_10"))


@query(
    f"""WITH {SQL_SECTIONS}, {SQL_ITEMS}, {_GLOBAL}, {_MASKED}, tops AS (SELECT query_id, upper(trim(section_name)) AS found FROM ranked JOIN docs USING (id) WHERE rank = 1)
    SELECT count(*) AS queries, round(avg(coalesce(CAST(found = upper(trim(gold_name)) AS INT), 0)), 6) AS accuracy FROM asked LEFT JOIN tops USING (query_id)"""
)
def section_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, ranking = _patient_ranking(spark, sf_dir, 1)
    names = sections(spark, sf_dir, "section_name").select(F.col("section_id").alias("id"), F.trim("section_name").alias("section_name"))
    return evaluate.routing_accuracy(ranking.join(names, "id"), asked.withColumn("gold_name", F.trim("gold_name")))


@query(
    f"""WITH {SQL_SECTIONS}, {SQL_ITEMS}, {_POSTINGS.replace('FROM secs)', 'FROM secs WHERE length(section_content) > 50)', 1)}, lens AS (SELECT DISTINCT id, patient_id, dl FROM post),
    tot AS (SELECT patient_id, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY 1), dfs AS MATERIALIZED (SELECT patient_id, term, count(*) AS df FROM post GROUP BY ALL),
    positive AS MATERIALIZED (SELECT query_id, id, round(sum({_WEIGHT}), 6) AS score FROM qg JOIN post USING (term, patient_id) JOIN dfs USING (term, patient_id) JOIN tot USING (patient_id) GROUP BY ALL),
    scored AS (SELECT query_id, id, coalesce(score, 0) AS score FROM (SELECT asked.query_id, docs.id FROM asked JOIN docs USING (patient_id)) LEFT JOIN positive USING (query_id, id))
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 5"""
)
def bm25_per_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the patient's own sections of over 50 characters; five best."""
    asked = cut_lineage(asked_items(spark, sf_dir))
    long = sections(spark, sf_dir, "patient_id", "section_content").where(F.length("section_content") > 50)
    index = cut_lineage(retrieval.search_index(spread(long), "section_id", "section_content", keep=("patient_id",)))
    queries = asked.select("query_id", F.col("question").alias("text"), "patient_id")
    ranking = cut_lineage(retrieval.bm25_search(index, queries, 5, mask="patient_id", own=True))
    return retrieval.with_zero_scores(ranking, queries, index.select("id", "patient_id").where("patient_id is not null"), 5, "patient_id")


_VEC = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label AS ql, v.label AS vl, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs QUALIFY rank <= 20)"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.dense_topk(vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id"), vectors, 20)


@query(f"WITH {_VEC} SELECT query_id, id, score, rank FROM ranked")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


@query(
    f"""WITH {_VEC}, hits AS (SELECT query_id, min(rank) - 1 AS first_rank, list_sort(list(rank)) AS ranks FROM ranked WHERE ql = vl GROUP BY 1),
    judged AS (SELECT vec_id AS query_id, first_rank, coalesce(ranks, []) AS ranks FROM embeddings LEFT JOIN hits ON vec_id = query_id WHERE vec_id % 20 = 0) SELECT {_sql_metrics()} FROM judged"""
)
def eval_dense_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant: vectors of the query's label."""
    labels = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = labels.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    ranking = _dense(spark, sf_dir).join(labels, "id").join(asked, "query_id").withColumn("relevant", F.col("label") == F.col("wanted"))
    return evaluate.metrics(evaluate.judged(ranking, asked))


@query("SELECT vec_id, len(embedding) AS dims, label FROM embeddings WHERE len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0")
def embeddings_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").where(retrieval.finite("embedding")).select("vec_id", F.size("embedding").alias("dims"), "label")


_TRIALS = f"""WITH {SQL_SECTIONS}, {SQL_ITEMS}, asked AS (SELECT qa_id AS query_id, section_id AS gold_id, patient_id FROM items JOIN secs USING (section_id) WHERE qa_id % 20 = 0 AND patient_id IS NOT NULL),
    pool AS (SELECT query_id, section_id AS id, gold_id FROM asked JOIN secs USING (patient_id)),
    ranked AS (SELECT seed, query_id, id, gold_id, row_number() OVER (PARTITION BY seed, query_id ORDER BY md5(query_id || '|' || id || '|' || seed), id) AS rank FROM pool, (SELECT unnest(range(42, 47)) AS seed)),
    firsts AS (SELECT seed, query_id, max(CASE WHEN id = gold_id THEN rank END) AS r FROM ranked GROUP BY ALL),
    trials AS (SELECT seed, avg(coalesce(CAST(r <= 10 AS INT), 0)) AS recall_10, avg(CASE WHEN r <= 20 THEN 1 / r ELSE 0 END) AS mrr FROM firsts GROUP BY seed)
    SELECT round(avg(recall_10), 6) AS recall_10_mean, round(stddev_pop(recall_10), 6) AS recall_10_std, round(avg(mrr), 6) AS mrr_mean, round(stddev_pop(mrr), 6) AS mrr_std FROM trials"""


@query(_TRIALS)
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five seeded permutations of each question's own patient's sections: mean and deviation over the trials."""
    asked = asked_items(spark, sf_dir).where("patient_id is not null").select("query_id", "gold_id", "patient_id")
    pool = asked.join(sections(spark, sf_dir, "patient_id").select(F.col("section_id").alias("id"), "patient_id"), "patient_id")
    firsts = retrieval.random_gold_ranks(pool, list(range(42, 47)))
    trials = firsts.groupBy("seed").agg(F.avg(F.coalesce((F.col("r") <= 10).cast("int"), F.lit(0))).alias("recall_10"), F.avg(F.when(F.col("r") <= 20, 1 / F.col("r")).otherwise(0.0)).alias("mrr"))
    both = [(m, f) for m in ("recall_10", "mrr") for f in ("mean", "std")]
    return trials.agg(*(F.round(F.avg(m) if f == "mean" else F.stddev_pop(m), 6).alias(f"{m}_{f}") for m, f in both))


SEARCH_TEXT = "Raumforderung im Bereich der Milz"
SEARCH_TERMS = [w.lower() for w in fts_terms(SEARCH_TEXT)]


def _sql_words_search(table: str, key: str, body: str, extra: str, where: str, out: str) -> str:
    terms = ", ".join(f"'{t}'" for t in SEARCH_TERMS)
    return f"""{out}_d AS (SELECT {key} AS id, {extra}, list_filter(regexp_split_to_array(lower(coalesce({body}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS t FROM {table}),
    {sql_stems(f"SELECT DISTINCT unnest(t) AS w FROM {out}_d", f"{out}_st")},
    {out}_tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {out}_d WHERE len(t) > 0),
    {out}_p AS (SELECT id, len(t) AS dl, stem AS term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS w FROM {out}_d) JOIN {out}_st USING (w) WHERE stem IN (SELECT stem FROM {out}_st WHERE w IN ({terms})) GROUP BY ALL),
    {out}_df AS (SELECT term, count(*) AS df FROM {out}_p GROUP BY 1),
    {out} AS (SELECT id, {extra}, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM {out}_p JOIN {out}_df USING (term) JOIN {out}_d USING (id), {out}_tot WHERE {where} GROUP BY ALL)"""


def _word_search(docs: DataFrame, key: str, body: str, keep: tuple[str, ...], where, cut=retrieval.cut_stems) -> DataFrame:
    """Any-of search of stemmed words: statistics over all documents, filters before ranking. Only the question's terms leave the batches."""
    text = " ".join(SEARCH_TERMS)
    only = np.unique(cut([text])[1])
    filters = tuple(c for c in ("patient_id", "report_type", "report_date") if c in docs.columns)
    index = cut_lineage(retrieval.search_index(spread(docs), key, body, cut, filters, only))
    asked = docs.sparkSession.createDataFrame([(0, text)], "query_id int, text string")
    return retrieval.bm25_search(index, asked, None, cut, floor=True, where=where, keep=keep).select("id", *keep, "score")


_SEC_WHERE = "lower(trim(report_type)) IN ('rad', 'arztbrief') AND report_date >= DATE '2008-01-01' AND report_date <= DATE '2022-12-31'"
_SEC_SQL = _sql_words_search("secs", "section_id", "section_content", "patient_id, report_type, report_date", _SEC_WHERE, "found")


@query(f"WITH {SQL_SECTIONS}, {_SEC_SQL} SELECT id, patient_id, score FROM found ORDER BY score DESC, id LIMIT 20")
def word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed word BM25 with type and date filters (null dates fail them); a top-20 report."""
    docs = sections(spark, sf_dir, "patient_id", "section_content", "report_type", "report_date")
    found = _word_search(docs, "section_id", "section_content", ("patient_id",), F.expr(_SEC_WHERE))
    return found.orderBy(F.desc("score"), "id").limit(20)


_ASKED_TERMS = """raw AS (SELECT qa_id AS query_id, list_filter(string_split_regex(translate(coalesce(question, ''), chr(39) || '"*(){}[]', '         '), '[\\s\\p{Z}]+'), lambda w: w <> '') AS ws FROM items WHERE qa_id % 20 = 0),
    kept AS (SELECT query_id, CASE WHEN len(list_filter(ws, lambda w: length(w) > 2)) > 0 THEN list_filter(ws, lambda w: length(w) > 2) ELSE ws END AS ws FROM raw),
    qw AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(array_to_string(ws, ' ')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM kept)"""


@query(
    f"""WITH {SQL_SECTIONS}, {SQL_ITEMS}, {_ASKED_TERMS}, d AS (SELECT section_id AS id, report_type, report_date, list_filter(regexp_split_to_array(lower(coalesce(section_content, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS t FROM secs),
    {sql_stems("SELECT DISTINCT unnest(t) AS w FROM d UNION SELECT w FROM qw", "st")}, qs AS MATERIALIZED (SELECT DISTINCT query_id, stem AS term FROM qw JOIN st USING (w)),
    tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d WHERE len(t) > 0),
    post AS MATERIALIZED (SELECT id, len(t) AS dl, stem AS term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS w FROM d) JOIN st USING (w) WHERE stem IN (SELECT term FROM qs) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    scored AS (SELECT query_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qs JOIN post USING (term) JOIN dfs USING (term), tot WHERE id IN (SELECT id FROM d WHERE {_SEC_WHERE}) GROUP BY ALL)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 20"""
)
def word_search_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed word BM25 of every question of the stated query set, filters as in word_search; twenty best a question."""
    terms = F.udf(lambda q: " ".join(fts_terms(q or "")), "string")
    asked = cut_lineage(_questions(spark, sf_dir).select("query_id", terms("question").alias("text")))
    index = _section_index(spark, sf_dir, "report_type", "report_date", cut=retrieval.cut_stems, asked=asked)
    return retrieval.bm25_search(index, asked, 20, retrieval.cut_stems, floor=True, where=F.expr(_SEC_WHERE))


@query(f"WITH {SQL_SECTIONS}, {_SEC_SQL} SELECT patient_id, count(*) AS hits, max(score) AS best FROM found WHERE patient_id IS NOT NULL GROUP BY 1")
def hits_per_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sections(spark, sf_dir, "patient_id", "section_content", "report_type", "report_date")
    found = _word_search(docs, "section_id", "section_content", ("patient_id",), F.expr(_SEC_WHERE))
    return found.where("patient_id is not null").groupBy("patient_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"))


@query(f"WITH {SQL_SECTIONS}, {_SEC_SQL} SELECT patient_id, id, score, row_number() OVER (PARTITION BY patient_id ORDER BY score DESC, id) AS rank FROM found WHERE patient_id IS NOT NULL QUALIFY rank <= 3")
def group_topk_per_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sections(spark, sf_dir, "patient_id", "section_content", "report_type", "report_date")
    found = _word_search(docs, "section_id", "section_content", ("patient_id",), F.expr(_SEC_WHERE)).where("patient_id is not null")
    return retrieval.top_k(found, ["patient_id"], 3).select("patient_id", "id", "score", "rank")


@query(f"WITH {SQL_REPORTS}, {_sql_words_search('reps', 'report_id', 'content', 'patient_id', 'true', 'found')} SELECT id, patient_id, score FROM found ORDER BY score DESC, id LIMIT 20")
def report_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed word BM25 over whole reports; a top-20 report."""
    found = _word_search(reports(spark, sf_dir, "patient_id", "content"), "report_id", "content", ("patient_id",), F.lit(True))
    return found.orderBy(F.desc("score"), "id").limit(20)


_COMBINED = f"""WITH {SQL_SECTIONS}, {SQL_REPORTS}, {_sql_words_search("secs", "section_id", "section_content", "patient_id", "true", "fs")}, {_sql_words_search("reps", "report_id", "content", "patient_id", "true", "fr")},
    both_lists AS ((SELECT 'section' AS level, id, patient_id, score FROM fs ORDER BY score DESC, id LIMIT 10) UNION ALL (SELECT 'report', id, patient_id, score FROM fr ORDER BY score DESC, id LIMIT 10))"""


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _word_search(sections(spark, sf_dir, "patient_id", "section_content"), "section_id", "section_content", ("patient_id",), F.lit(True))
    right = _word_search(reports(spark, sf_dir, "patient_id", "content"), "report_id", "content", ("patient_id",), F.lit(True))
    return retrieval.combine(left.withColumn("level", F.lit("section")), right.withColumn("level", F.lit("report")), 20)


@query(f"{_COMBINED} SELECT level, id, patient_id, score FROM both_lists ORDER BY score DESC, id LIMIT 20")
def combined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half sections, half reports, by score: a top-20 report."""
    return _combined(spark, sf_dir).select("level", "id", "patient_id", "score")


@query(f"{_COMBINED} SELECT string_agg('[' || r || '] ' || level || ' ' || id, chr(10) ORDER BY r) AS context, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'insufficient' END AS status FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM both_lists)")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits as one numbered context, with the answer status that their number gives."""
    rows = _combined(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "level"))).alias("hits"))  # at most 20 rows
    lines = F.transform("hits", lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["level"], F.lit(" "), h["id"]))
    return rows.select(F.array_join(lines, "\n").alias("context"), F.when(F.size("hits") > 0, "ok").otherwise("insufficient").alias("status"))


@query(
    f"""WITH {SQL_PATIENTS}, m AS (SELECT patient_id, fullname, coalesce(strftime(CASE WHEN regexp_matches(dob, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(dob AS DATE) END, '%d.%m.%Y'), dob) AS shown,
    CASE WHEN starts_with(lower(patient_id), 'holl') THEN 1 WHEN starts_with(lower(fullname), 'holl') THEN 2 WHEN starts_with(lower(firstname), 'holl') OR starts_with(lower(lastname), 'holl') THEN 3 ELSE 4 END AS priority FROM pats
    WHERE contains(lower(fullname), 'holl') OR contains(lower(firstname), 'holl') OR contains(lower(lastname), 'holl') OR contains(lower(patient_id), 'holl') OR contains(lower(dob), 'holl'))
    SELECT patient_id, fullname, shown, priority FROM m ORDER BY priority, fullname NULLS FIRST, patient_id LIMIT 50"""
)
def directory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quellwerk.plans.engine import search_directory

    return search_directory(patients(spark, sf_dir), "holl", 50).select("patient_id", "fullname", "shown", "priority")


@query(f"WITH {SQL_REPORTS} SELECT report_id, filename, content FROM reps WHERE report_id = (SELECT min(report_id) FROM reports)")
def report_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read_table(spark, sf_dir, "reports").agg(F.min("report_id").alias("report_id"))
    return reports(spark, sf_dir, "filename", "content").join(F.broadcast(wanted), "report_id", "left_semi").select("report_id", "filename", "content")
