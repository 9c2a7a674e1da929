"""From hits to answers: fallback search, shaped hits, contexts, citations, samples for generation, pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.functions import text as tx
from quellwerk.functions.dates import best_date, german_date, german_text
from quellwerk.operators import items, retrieval, rows
from quellwerk.plans import engine
from quellwerk.plans.registry import query
from quellwerk.plans.search import _COMBINED, _combined, _section_index, asked_items, bm25_per_patient
from quellwerk.plans.tables import SQL_ITEMS, SQL_REPORTS, SQL_SECTIONS, qa_items, reports, sections
from quellwerk.session import cut_lineage, read_table


@query()
def search_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best a question within its patient, and how they were found: by character grams, else by stemmed words.

    Questions whose patient has no section for the first way go the second one, over the patient's sections of any length.
    """
    asked = cut_lineage(asked_items(spark, sf_dir))
    first = cut_lineage(bm25_per_patient(spark, sf_dir))
    missed = asked.join(first.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.col("question").alias("text"), "patient_id")
    words = retrieval.bm25_search(_section_index(spark, sf_dir, "patient_id", cut=retrieval.cut_stems), missed, 5, retrieval.cut_stems, mask="patient_id", floor=True)
    label = lambda df, method: df.select("query_id", "id", "score", "rank", F.lit(method).alias("method"))
    return label(first, "bm25_char3gram").unionByName(label(words, "full_text_search"))


# Places of hits in the two result lists, joined with what is shown of them.
_HITS = f"""{_COMBINED}, numbered AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM both_lists),
    shown AS (SELECT r, n.id, n.level, n.patient_id, n.score, coalesce(s.report_id, n.id) AS report_id, coalesce(s.report_type, p.report_type) AS report_type, s.section_name, coalesce(s.report_date, p.report_date) AS report_date, coalesce(s.section_content, p.content) AS text, coalesce(s.source_path, p.source_path) AS path,
        '#/document/' || coalesce(s.report_id, n.id) || CASE WHEN n.level = 'section' THEN '/section/' || n.id ELSE '' END AS url
        FROM numbered n LEFT JOIN secs s ON n.level = 'section' AND s.section_id = n.id LEFT JOIN reps p ON n.level = 'report' AND p.report_id = n.id)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty hits of the combined search, numbered, with what is shown of them."""
    found = cut_lineage(_combined(spark, sf_dir).select("id", "level", "patient_id", "score"))
    best = found.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "level", "patient_id", "score"))).alias("h")).select(F.posexplode("h").alias("r", "h"))  # at most 20 rows
    best = best.select((F.col("r") + 1).alias("r"), "h.id", "h.level", "h.patient_id", "h.score")
    secs = sections(spark, sf_dir, "report_id", "report_type", "section_name", "report_date", "section_content", "source_path")
    reps = reports(spark, sf_dir, "report_type", "report_date", "content", "source_path")
    left = best.where("level = 'section'").join(secs.withColumnRenamed("section_id", "id").withColumnRenamed("section_content", "text"), "id", "left")
    right = best.where("level = 'report'").join(reps.select(F.col("report_id").alias("id"), "report_id", "report_type", F.lit(None).cast("string").alias("section_name"), "report_date", F.col("content").alias("text"), "source_path"), "id", "left")
    columns = ["r", "id", "level", "patient_id", "score", "report_id", "report_type", "section_name", "report_date", "text", F.col("source_path").alias("path")]
    return left.select(*columns).unionByName(right.select(*columns)).withColumn("url", engine.document_url(F.col("report_id"), F.when(F.col("level") == "section", F.col("id"))))


@query(f"{_HITS} SELECT r, id, report_id, report_type, section_name, CAST(report_date AS VARCHAR) AS report_date, url, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM shown")
def document_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of both levels in one shape: coalesced ids, a link, a preview."""
    return _hits(spark, sf_dir).select("r", "id", "report_id", "report_type", "section_name", F.col("report_date").cast("string").alias("report_date"), "url", tx.preview("text").alias("snippet"))


@query(
    rf"""{_HITS}, dated AS (SELECT *, coalesce(nullif(regexp_extract(path, '\d{{1,2}}\.\d{{1,2}}\.20\d{{2}}'), ''), CAST(report_date AS VARCHAR), 'Unbekanntes Datum') AS shown_date FROM shown)
    SELECT string_agg('[' || r || '] Bericht: ' || report_id || ' | Abschnitt: ' || coalesce(section_name, '') || ' | Datum: ' || shown_date || ' | ' || CASE WHEN score > 0 THEN 'BM25: ' || printf('%.3f', score) ELSE 'Score: N/A' END || chr(10) || regexp_replace(coalesce(text, ''), '^[\s\x0b\x85\p{{Z}}]+|[\s\x0b\x85\p{{Z}}]+$', '', 'g'), chr(10) || chr(10) ORDER BY r) AS context FROM dated"""
)
def context_with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits as header blocks with their texts, for a prompt."""
    hits = _hits(spark, sf_dir).select("r", engine.context_block(F.col("r"), F.col("report_id"), F.col("section_name"), F.col("report_date"), F.col("path"), F.col("score"), F.col("text")).alias("block"))
    return hits.agg(F.array_sort(F.collect_list(F.struct("r", "block"))).alias("b")).select(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))  # at most 20 rows


@query(
    f"""{_HITS} SELECT string_agg('[' || coalesce(report_type, '') || CASE WHEN section_name IS NOT NULL THEN ' - ' || section_name ELSE '' END || ' • ' || coalesce(strftime(report_date, '%d.%m.%Y'), '') || ']', '; ' ORDER BY r) AS citations, count(*) AS hits FROM shown"""
)
def citation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).select("r", engine.citation(F.col("report_type"), F.col("section_name"), F.col("report_date")).alias("c"))
    return hits.agg(F.array_sort(F.collect_list(F.struct("r", "c"))).alias("b"), F.count("*").alias("hits")).select(F.array_join(F.transform("b", lambda x: x["c"]), "; ").alias("citations"), "hits")


_SAMPLE = """names AS (SELECT greatest(1, 200 // greatest(1, count(DISTINCT upper(trim(section_name))))) AS quota FROM secs WHERE length(section_content) BETWEEN 60 AND 3000),
    free AS (SELECT s.*, upper(trim(section_name)) AS name FROM secs s ANTI JOIN (SELECT section_id FROM qa_items) q USING (section_id) WHERE length(section_content) BETWEEN 60 AND 3000 AND section_name IS NOT NULL),
    drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY md5(section_id || '|42'), section_id) AS nth FROM free), names WHERE nth <= quota),
    kept AS (SELECT * FROM drawn QUALIFY row_number() OVER (ORDER BY md5(section_id || '|42'), section_id) <= 200)"""


@query(f"WITH {SQL_SECTIONS}, {_SAMPLE} SELECT section_id, name AS section_name FROM kept")
def generation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred sections without an item, of 60 to 3,000 characters, by a quota for each section name: a sampling operator."""
    asked = read_table(spark, sf_dir, "qa_items").select("section_id")
    fit = sections(spark, sf_dir, "section_name", "section_content").where(F.length("section_content").between(60, 3000)).select("section_id", F.upper(F.trim("section_name")).alias("section_name"))
    return items.generation_sample(fit.where("section_name is not null"), asked, "section_name", 200, 42).select("section_id", "section_name")


@query(f"WITH {SQL_REPORTS} SELECT report_id FROM reps WHERE report_id NOT IN (SELECT record_key FROM split_draft WHERE record_kind = 'report' AND split_name = 'train' AND record_key IS NOT NULL) AND report_id NOT IN (SELECT record_key FROM split_draft WHERE record_kind = 'report' AND split_name = 'test' AND record_key IS NOT NULL)")
def pending_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports less those accepted and those set aside (the splits train and test stand for the two lists)."""
    draft = read_table(spark, sf_dir, "split_draft").where("record_kind = 'report'").select(F.col("record_key").alias("report_id"), "split_name")
    return rows.pending(reports(spark, sf_dir).select("report_id"), draft.where("split_name = 'train'"), draft.where("split_name = 'test'"), "report_id")


@query(
    f"""WITH {SQL_REPORTS} SELECT report_id FROM reps WHERE length(content) >= 500 AND (regexp_matches(lower(filename), 'rad.*20(1|2)') OR regexp_matches(lower(source_path), 'rad.*20(1|2)') OR regexp_matches(lower(report_type), 'rad.*20(1|2)') OR regexp_matches(lower(left(content, 200)), 'rad.*20(1|2)'))
    AND contains(lower(patient_id), 'p00')"""
)
def filtered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters of a review list: least score (here the size), a pattern over four columns, a part of a name, no rows done already."""
    df = reports(spark, sf_dir, "filename", "report_type", "content", "patient_id").withColumns({"size": F.length("content"), "start": F.substring("content", 1, 200)})
    return rows.review_filter(df, "size", 500, "RAD.*20(1|2)", ["filename", "source_path", "report_type", "start"], "patient_id", "P00").select("report_id")


@query(
    rf"""WITH {SQL_REPORTS}, found AS (SELECT report_id, created_at, list_transform(regexp_extract_all(coalesce(content, ''), '\b[0-3]?\d[.][0-1]?\d[.](?:19|20)\d{{2}}\b'), lambda d: try_cast(try_strptime(d, '%d.%m.%Y') AS DATE)) AS ds FROM reps)
    SELECT report_id, CAST(coalesce(list_max(list_filter(ds, lambda d: d IS NOT NULL)), CAST(created_at AS DATE)) AS VARCHAR) AS best FROM found"""
)
def best_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest date written in a report, else the day it was delivered."""
    found = F.regexp_extract_all("content", F.lit(r"\b[0-3]?\d[.][0-1]?\d[.](?:19|20)\d{2}\b"), F.lit(0))
    dates = F.array_compact(F.transform(F.coalesce(found, F.array().cast("array<string>")), german_date))
    return reports(spark, sf_dir, "content").select("report_id", best_date(dates, F.col("created_at")).cast("string").alias("best"))


@query(f"WITH {SQL_REPORTS} SELECT report_id, patient_id, CAST(report_date AS VARCHAR) AS report_date FROM reps ORDER BY patient_id NULLS FIRST, report_date NULLS FIRST, report_id")
def reports_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by patient and date, unknown ones first."""
    return reports(spark, sf_dir, "patient_id", "report_date").orderBy("patient_id", "report_date", "report_id").select("report_id", "patient_id", F.col("report_date").cast("string").alias("report_date"))


@query(f"WITH {SQL_SECTIONS} SELECT section_id, patient_id, chunk_index FROM secs WHERE patient_id = 'P0000001' ORDER BY created_at, section_id, chunk_index")
def patient_sections_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patient's sections as a client lists them."""
    return sections(spark, sf_dir, "patient_id", "chunk_index").where("patient_id = 'P0000001'").orderBy("created_at", "section_id", "chunk_index").select("section_id", "patient_id", "chunk_index")


@query("SELECT 'P0000001' AS patient_id, EXISTS (SELECT 1 FROM reports WHERE patient_id = 'P0000001') AS known UNION ALL SELECT 'none', EXISTS (SELECT 1 FROM reports WHERE patient_id = 'none')")
def patient_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "reports")
    return spark.createDataFrame([(p, rows.exists(df, F.col("patient_id") == p)) for p in ("P0000001", "none")], "patient_id string, known boolean")


@query("SELECT report_type, count(*) AS n FROM reports GROUP BY report_type ORDER BY n DESC, report_type NULLS FIRST LIMIT 1000")
def browsed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table browser's statement over named tables, at most 1,000 rows: the limit is the browser's feature."""
    from quellwerk.sources.files import browse

    return browse(spark, "SELECT report_type, count(*) AS n FROM {reports} GROUP BY report_type ORDER BY n DESC, report_type", {"reports": read_table(spark, sf_dir, "reports")})


@query(f"WITH {SQL_ITEMS} SELECT qa_id, coalesce(json_extract_string(to_json(struct_pack(q := question)), '$.q'), '') AS question FROM items")
def single_json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator's single object counts as a list of one; values that are no objects are left out."""
    raw = F.to_json(F.struct(F.col("question").alias("q")))
    parsed = tx.json_items(raw, "q string")
    return qa_items(spark, sf_dir, "question").select("qa_id", F.coalesce(F.get(parsed, F.lit(0))["q"], F.lit("")).alias("question"))
