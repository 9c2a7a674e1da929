"""Question-answer items, training pairs and roster linkage over the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.functions import text as tx
from quellwerk.functions.dates import birth_date
from quellwerk.functions.names import fold
from quellwerk.operators import evaluate, items, linkage, retrieval
from quellwerk.operators.sections import overlap_windows
from quellwerk.plans.registry import query
from quellwerk.plans.search import _GLOBAL, _MASKED, _patient_ranking, _sql_metrics
from quellwerk.plans.tables import SQL_ITEMS, SQL_REPORTS, SQL_SECTIONS, patients, qa_items, reports, sections, sql_word_count, sql_words
from quellwerk.plans.values import _NEG
from quellwerk.session import read_table, spread

_WINDOWS = f"""w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, s // 300 AS chunk_index FROM (SELECT doc_id, unnest(CASE WHEN len(w) <= 350 THEN [0] ELSE list_filter(range(0, len(w), 300), lambda s: s = 0 OR s < len(w) - 50) END) AS s FROM w))"""


@query(
    f"""WITH {_WINDOWS} SELECT doc_id || '_' || chunk_index AS section_id, CASE WHEN lag(chunk_index) OVER p = chunk_index - 1 THEN doc_id || '_' || lag(chunk_index) OVER p END AS prev_id,
    CASE WHEN lead(chunk_index) OVER p = chunk_index + 1 THEN doc_id || '_' || lead(chunk_index) OVER p END AS next_id FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY chunk_index)"""
)
def neighbour_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of documents with the window before and after."""
    df = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"))
    chunks = df.select(F.col("doc_id").alias("report_id"), F.lit("text").alias("section_name"), F.posexplode(overlap_windows(F.col("text"))).alias("chunk_index", "section_content"))
    chunks = chunks.withColumn("section_id", F.concat(F.col("report_id").cast("string"), F.lit("_"), F.col("chunk_index").cast("string")))
    return items.with_neighbours(chunks).select("section_id", "prev_id", "next_id")


@query(f"WITH {SQL_SECTIONS} SELECT section_id, upper(trim(section_name)) AS section_name FROM secs QUALIFY row_number() OVER (PARTITION BY upper(trim(section_name)) ORDER BY md5(section_id || '|42'), section_id) <= 10")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten sections of each name by seeded hash: a sampling operator."""
    df = sections(spark, sf_dir, "section_name").select("section_id", F.upper(F.trim("section_name")).alias("section_name"))
    return items.stratified_sample(df, "section_name", 10, 42)


_NUMERIC_NEG = f"(regexp_matches(a, '{_NEG}') OR regexp_matches(c, '{_NEG}'))"
_RULES = f"""j AS (SELECT qa_id, section_id, trim(coalesce(question, '')) AS q, lower(trim(coalesce(question, ''))) AS ql, coalesce(answer_text, '') AS a, trim(coalesce(answer_type, '')) AS k, coalesce(section_content, '') AS c, lower(coalesce(items.section_name, '')) AS s,
    start_char AS x, end_char AS y, list_transform(coalesce(phenomena, []), lambda t: lower(t)) AS tags, {sql_word_count('question')} AS n FROM items LEFT JOIN (SELECT section_id, section_content FROM secs) USING (section_id)),
    o AS (SELECT *, x IS NULL OR y IS NULL AS malformed, coalesce(x < 0 OR y <= x OR y > length(c), false) AS outside FROM j),
    v AS (SELECT *, list_filter([CASE WHEN q = '' THEN 'empty_question' END, CASE WHEN k NOT IN ('span', 'boolean', 'numeric', 'classification', 'list') THEN 'invalid_answer_type' END,
    CASE WHEN n < 8 OR {' OR '.join(f"contains(ql, '{p}')" for p in tx.TRIVIAL)} OR contains(ql, 'was ist ' || s) OR contains(ql, 'was steht in ' || s) THEN 'trivial_question' END,
    CASE WHEN malformed THEN 'invalid_offset_format' END, CASE WHEN outside THEN 'offset_out_of_bounds' END,
    CASE WHEN NOT malformed AND NOT outside AND substr(c, x + 1, y - x) <> a THEN 'substring_mismatch' END,
    CASE WHEN length(a) < 3 THEN 'answer_too_short' END, CASE WHEN length(a) > 320 THEN 'answer_too_long' END,
    CASE WHEN k = 'numeric' AND NOT regexp_matches(a, '\\d') THEN 'numeric_type_no_numbers' END,
    CASE WHEN list_contains(tags, 'negation') AND NOT {_NUMERIC_NEG} THEN 'negation_tag_without_negation' END,
    CASE WHEN n < 8 THEN 'question_too_short' END], lambda e: e IS NOT NULL) AS errors FROM o)"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = qa_items(spark, sf_dir, "section_id", "question", "answer_text", "answer_type", "start_char", "end_char", "phenomena", "section_name").drop("created_at")
    return items.validate(asked.join(sections(spark, sf_dir, "section_content").select("section_id", "section_content"), "section_id", "left"))


@query(f"WITH {SQL_ITEMS}, {SQL_SECTIONS}, {_RULES} SELECT qa_id, array_to_string(errors, ',') AS errors, CASE WHEN len(errors) > 0 THEN 'invalid' ELSE 'valid' END AS status FROM v")
def qa_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule validator on every stored item, apart from its stored status."""
    return _validated(spark, sf_dir).select("qa_id", F.array_join("errors", ",").alias("errors"), "status")


@query(f"WITH {SQL_ITEMS}, {SQL_SECTIONS}, {_RULES} SELECT count(*) AS items, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid FROM v")
def validity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).agg(F.count("*").alias("items"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") == "invalid").alias("invalid"))


_NEXT = """nb AS (SELECT section_id, lag(section_id) OVER w AS prev_id, lag(section_content) OVER w AS prev_text, lead(section_id) OVER w AS next_id, lead(section_content) OVER w AS next_text FROM secs WINDOW w AS (PARTITION BY report_id ORDER BY section_order, section_id))"""


@query(
    f"""WITH {SQL_ITEMS}, {SQL_SECTIONS}, {_RULES}, {_NEXT}, g AS (SELECT qa_id, v.section_id, unnest(list_filter([v.section_id, CASE WHEN contains(prev_text, a) THEN prev_id END, CASE WHEN contains(next_text, a) THEN next_id END], lambda z: z IS NOT NULL)) AS gold FROM v LEFT JOIN nb USING (section_id) WHERE len(errors) = 0)
    SELECT DISTINCT qa_id, gold AS section_id FROM g"""
)
def gold_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold sections of valid items: the own section, and those before and after in the report that hold the answer too."""
    from pyspark.sql import Window

    place = Window.partitionBy("report_id").orderBy("section_order", "section_id")
    around = sections(spark, sf_dir, "report_id", "section_order", "section_content").select(
        "section_id", *(f("section_" + c).over(place).alias(f"{side}_{n}") for side, f in (("prev", F.lag), ("next", F.lead)) for c, n in (("id", "id"), ("content", "text")))
    )
    return items.gold_bridge(_validated(spark, sf_dir).join(around, "section_id", "left"))


# The pool of the method: the fifty best within the patient that are not gold.
_POOL = f"""{_MASKED.replace('rank <= 20', 'rank <= 51', 1)},
    wrong AS (SELECT query_id, id FROM ranked JOIN asked USING (query_id) WHERE id IS DISTINCT FROM gold_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 50),
    drawn AS (SELECT query_id, id FROM wrong QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || '|' || id || '|42'), id) <= 4)"""


def _negatives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked, ranking = _patient_ranking(spark, sf_dir, 51)
    pool = retrieval.top_k(ranking.where(~F.coalesce("relevant", F.lit(False))).select("query_id", "id", "score"), ["query_id"], 50)
    return asked, items.hard_negatives(pool, asked.select("query_id", "gold_id"))


@query(f"WITH {SQL_SECTIONS}, {SQL_ITEMS}, {_GLOBAL}, {_POOL} SELECT query_id, id FROM drawn")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negatives(spark, sf_dir)[1].select("query_id", "id")


@query(
    f"""WITH {SQL_SECTIONS}, {SQL_ITEMS}, {_GLOBAL}, {_POOL}, ok AS (SELECT DISTINCT query_id FROM drawn JOIN asked USING (query_id) JOIN secs ON gold_id = section_id)
    SELECT query_id, id, label FROM (SELECT query_id, gold_id AS id, 1.0 AS label FROM asked UNION ALL SELECT query_id, id, 0.0 FROM drawn) JOIN ok USING (query_id)"""
)
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, negatives = _negatives(spark, sf_dir)
    texts = sections(spark, sf_dir, "section_content").select(F.col("section_id").alias("id"), F.col("section_content").alias("d"))
    pairs = items.training_pairs(asked.select("query_id", F.col("question").alias("q")), asked.select("query_id", "gold_id").where("gold_id is not null"), negatives, texts)
    return pairs.select("query_id", "id", F.col("label").cast("double").alias("label"))


@query(
    f"WITH {SQL_REPORTS}, p AS (SELECT DISTINCT patient_id FROM reps WHERE patient_id IS NOT NULL) SELECT patient_id, row_number() OVER (ORDER BY md5(patient_id || '|42'), patient_id) <= greatest(1, floor(count(*) OVER () * 0.2)) AS is_dev FROM p"
)
def patient_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the patients held out by seeded hash; one function for training and evaluation."""
    return items.held_out(reports(spark, sf_dir, "patient_id"), "patient_id")


def shared_words(left: pd.Series, right: pd.Series) -> pd.Series:
    """A stand-in for a reranking model: share of the question's words that the text holds."""
    sets = [(set(a.lower().split()), set(b.lower().split())) for a, b in zip(left.fillna(""), right.fillna(""))]
    return pd.Series([round(len(a & b) / max(1, len(a)), 6) for a, b in sets])


_Q_WORDS, _D_WORDS = (f"list_distinct({sql_words(f'lower({c})')})" for c in ("question", "section_content"))
_RERANKED = f"""{_MASKED.replace('rank <= 20', 'rank <= 100', 1)},
    modelled AS (SELECT query_id, id, gold_id, round(len(list_filter({_Q_WORDS}, lambda x: list_contains({_D_WORDS}, x))) / greatest(1, len({_Q_WORDS})), 6) AS model_score FROM ranked JOIN asked USING (query_id) JOIN secs ON id = section_id),
    reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY model_score DESC, id) AS rank FROM modelled QUALIFY rank <= 20)"""


def _reranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked, ranking = _patient_ranking(spark, sf_dir, 100)
    texts = sections(spark, sf_dir, "section_content").select(F.col("section_id").alias("id"), F.col("section_content").alias("d"))
    both = ranking.select("query_id", "id").join(asked.select("query_id", F.col("question").alias("q")), "query_id").join(texts, "id")
    return asked, items.rerank(both, shared_words, 20)


@query(f"WITH {SQL_SECTIONS}, {SQL_ITEMS}, {_GLOBAL}, {_RERANKED} SELECT query_id, id, model_score, rank FROM reranked")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages: the hundred best by BM25, scored again by a supplied model, twenty kept."""
    return _reranked(spark, sf_dir)[1]


@query(
    f"""WITH {SQL_SECTIONS}, {SQL_ITEMS}, {_GLOBAL}, {_RERANKED}, firsts AS (SELECT query_id, min(rank) - 1 AS first_rank, list_sort(list(rank)) AS ranks FROM reranked WHERE id = gold_id GROUP BY query_id),
    final AS (SELECT asked.query_id, first_rank, coalesce(firsts.ranks, []) AS ranks FROM asked LEFT JOIN firsts USING (query_id)) SELECT {_sql_metrics()} FROM final"""
)
def eval_rerank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the list after the second stage."""
    asked, ranking = _reranked(spark, sf_dir)
    judged = ranking.join(asked.select("query_id", "gold_id"), "query_id").withColumn("relevant", F.col("id") == F.col("gold_id"))
    return evaluate.metrics(evaluate.judged(judged, asked))


def _roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = patients(spark, sf_dir)
    return people.select("patient_id", fold(F.coalesce("firstname", F.lit(""))).alias("first"), fold(F.coalesce("lastname", F.lit(""))).alias("last"), birth_date("dob").alias("dob"))


@query()
def linkage_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patient of the roster that each report's folder, file name and text point to."""
    files = reports(spark, sf_dir, "filename", "content").withColumn("folder", F.regexp_replace("source_path", r"/?[^/]*$", ""))
    return linkage.best_matches(spread(files), _roster(spark, sf_dir), "report_id", "content", ("folder", "filename"))


@query()
def linkage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by score bucket with percentages, and how many reach the threshold of acceptance."""
    best = linkage_best(spark, sf_dir)
    counted = best.groupBy(linkage.score_bucket().alias("bucket")).agg(F.count("*").alias("files"), F.count_if(F.col("score") >= 1.3).alias("accepted"))
    total = counted.agg(F.sum("files").alias("total"))
    return counted.join(F.broadcast(total), F.lit(True)).select("bucket", "files", F.round(F.col("files") * 100 / F.col("total"), 6).alias("percent"), "accepted")


@query(
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, count(DISTINCT user_id) AS users, count(*) FILTER (value > 10) AS large FROM events GROUP BY 1"
)
def event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "events")
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 10).alias("large"))
