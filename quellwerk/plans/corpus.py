"""Profiles and keyed operations over patients, reports and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.functions.text import word_count
from quellwerk.operators import rows
from quellwerk.operators.sections import build_chunks, extract_sections, merge_small, overlap_windows
from quellwerk.plans.registry import query
from quellwerk.plans.tables import SQL_ITEMS, SQL_PATIENTS, SQL_REPORTS, SQL_SECTIONS, patients, qa_items, reports, sections, sql_word_count, sql_words
from quellwerk.session import read_table, spread


@query(f"WITH {SQL_PATIENTS} SELECT patient_id, firstname, lastname, fullname, dob FROM pats")
def patients_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patients(spark, sf_dir).select("patient_id", "firstname", "lastname", "fullname", "dob")


_STATUS = """hashed AS (SELECT report_id, patient_id, created_at, source_path, sha256(content) AS sha256 FROM reps),
    marked AS (SELECT *, CASE WHEN sha256 IS NULL THEN 'skipped'
        WHEN row_number() OVER w = 1 THEN 'inserted'
        WHEN patient_id IS NOT DISTINCT FROM first_value(patient_id) OVER w THEN 'duplicate' ELSE 'conflict' END AS status
        FROM hashed WINDOW w AS (PARTITION BY sha256 ORDER BY created_at NULLS FIRST, report_id))"""


def _with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports(spark, sf_dir, "patient_id", "content")
    return rows.duplicate_status(df, "content", "patient_id", [F.col("created_at"), F.col("report_id")])


@query(f"WITH {SQL_REPORTS}, {_STATUS} SELECT report_id, sha256, status FROM marked")
def sha_dedup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_status(spark, sf_dir).select("report_id", "sha256", "status")


@query(f"WITH {SQL_REPORTS}, {_STATUS} SELECT status, count(*) AS n FROM marked GROUP BY status")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(
    rf"""WITH {SQL_REPORTS}, base AS (SELECT report_id, filename, row_number() OVER (PARTITION BY filename ORDER BY source_path NULLS FIRST, report_id) - 1 AS nth, count(*) OVER (PARTITION BY filename) AS n FROM reps WHERE filename IS NOT NULL),
    offered AS (SELECT filename, i, filename || '_' || i AS form FROM (SELECT DISTINCT filename, unnest(range(1, n + (SELECT count(*) FROM base))) AS i FROM base WHERE n > 1)),
    free AS (SELECT filename, form, row_number() OVER (PARTITION BY filename ORDER BY i) AS nth FROM offered WHERE form NOT IN (SELECT filename FROM base))
    SELECT report_id, coalesce(form, filename) AS unique_name FROM base LEFT JOIN free USING (filename, nth)"""
)
def unique_report_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports(spark, sf_dir, "filename").where(F.col("filename").isNotNull())
    return rows.unique_names(df, "filename", [F.col("source_path"), F.col("report_id")]).select("report_id", "unique_name")


@query(f"WITH {SQL_ITEMS} SELECT section_id, question, min(qa_id) AS qa_id FROM items WHERE section_id IS NOT NULL AND question IS NOT NULL GROUP BY ALL")
def qa_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first id of every (section, question): what an insert that ignores repeats would keep."""
    kept = qa_items(spark, sf_dir, "section_id", "question").where("section_id is not null and question is not null")
    return kept.groupBy("section_id", "question").agg(F.min("qa_id").alias("qa_id"))


@query(
    "SELECT 'patients' AS table_name, count(*) AS n FROM patients UNION ALL SELECT 'reports', count(*) FROM reports UNION ALL SELECT 'report_sections', count(*) FROM report_sections UNION ALL SELECT 'qa_items', count(*) FROM qa_items"
)
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read_table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("patients", "reports", "report_sections", "qa_items")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query(f"WITH {SQL_REPORTS} SELECT lower(trim(report_type)) AS report_type, count(*) AS n FROM reps GROUP BY 1")
def report_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir, "report_type").groupBy(F.lower(F.trim("report_type")).alias("report_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "report_type")


@query("SELECT DISTINCT report_type FROM reports WHERE report_type IS NOT NULL")
def distinct_report_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "reports").select("report_type").where("report_type is not null").distinct().orderBy("report_type")


@query(f"WITH {SQL_SECTIONS} SELECT count(DISTINCT patient_id) AS patients, count(DISTINCT report_id) AS reports, count(*) AS sections FROM secs")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sections(spark, sf_dir, "patient_id", "report_id")
    return df.agg(F.count_distinct("patient_id").alias("patients"), F.count_distinct("report_id").alias("reports"), F.count("*").alias("sections"))


_NAMED = f"SELECT upper(trim(section_name)) AS section_name, {sql_word_count('section_content')} AS words, length(section_content) AS chars FROM secs"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sections(spark, sf_dir, "section_name", "section_content")
    return df.select(F.upper(F.trim("section_name")).alias("section_name"), word_count("section_content").alias("words"), F.length("section_content").alias("chars"))


@query(
    f"WITH {SQL_SECTIONS}, named AS ({_NAMED}) SELECT section_name, count(*) AS n, round(avg(words), 6) AS avg_words, max(words) AS max_words FROM named GROUP BY 1 ORDER BY n DESC, section_name NULLS FIRST LIMIT 15"
)
def section_name_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-15 report; the limit is the feature."""
    out = _named(spark, sf_dir).groupBy("section_name").agg(F.count("*").alias("n"), F.round(F.avg("words"), 6).alias("avg_words"), F.max("words").alias("max_words"))
    return out.orderBy(F.desc("n"), "section_name").limit(15)


@query(
    f"WITH {SQL_SECTIONS}, named AS ({_NAMED}) SELECT round(avg(words), 6) AS mean_words, min(words) AS min_words, max(words) AS max_words, count(*) FILTER (words < 50) AS small, round(count(*) FILTER (words < 50) / count(*), 6) AS small_share FROM named"
)
def section_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.count_if(F.col("words") < 50)
    return _named(spark, sf_dir).agg(
        F.round(F.avg("words"), 6).alias("mean_words"), F.min("words").alias("min_words"), F.max("words").alias("max_words"), small.alias("small"), F.round(small / F.count("*"), 6).alias("small_share")
    )


@query(
    f"WITH {SQL_SECTIONS}, named AS ({_NAMED}) SELECT section_name, count(chars) AS n, round(avg(chars), 6) AS mean_chars, median(chars) AS median_chars, max(chars) AS max_chars, min(chars) AS min_chars, round(stddev_samp(chars), 6) AS std_chars FROM named GROUP BY 1"
)
def section_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("chars")
    return _named(spark, sf_dir).groupBy("section_name").agg(
        F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean_chars"), F.median(c).alias("median_chars"), F.max(c).alias("max_chars"), F.min(c).alias("min_chars"), F.round(F.stddev_samp(c), 6).alias("std_chars")
    )


@query(f"WITH {SQL_SECTIONS} SELECT trim(section_name) AS section_name, count(*) AS n FROM secs WHERE section_name IS NOT NULL GROUP BY 1")
def section_type_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sections(spark, sf_dir, "section_name").where("section_name is not null")
    return df.groupBy(F.trim("section_name").alias("section_name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section_name")


@query(
    rf"""WITH {SQL_REPORTS}, heads AS (SELECT unnest(regexp_extract_all(content, '(?m)^##[ \t]*([^\n]+)$', 1)) AS h FROM reps)
    SELECT trim(split_part(h, ':', 1)) AS section_name, count(*) AS n FROM heads WHERE trim(split_part(h, ':', 1)) <> '' GROUP BY 1"""
)
def header_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all ## headings, with or without a body."""
    heads = reports(spark, sf_dir, "content").select(F.explode(F.regexp_extract_all("content", F.lit(r"(?md)^##[ \t]*([^\n]+)$"), F.lit(1))).alias("h"))
    name = F.trim(F.substring_index("h", ":", 1))
    return heads.select(name.alias("section_name")).where("section_name != ''").groupBy("section_name").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SQL_REPORTS}, counts AS (SELECT patient_id, count(*) AS n FROM reps WHERE patient_id IS NOT NULL GROUP BY 1)
    SELECT count(*) AS patients, sum(n)::BIGINT AS files, min(n) AS min_files, max(n) AS max_files, round(avg(n), 6) AS mean_files, median(n) AS median_files, round(stddev_samp(n), 6) AS std_files FROM counts"""
)
def files_per_patient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reports(spark, sf_dir, "patient_id").where("patient_id is not null").groupBy("patient_id").agg(F.count("*").alias("n"))
    n = F.col("n")
    return counts.agg(
        F.count("*").alias("patients"), F.sum(n).alias("files"), F.min(n).alias("min_files"), F.max(n).alias("max_files"), F.round(F.avg(n), 6).alias("mean_files"), F.median(n).alias("median_files"), F.round(F.stddev_samp(n), 6).alias("std_files")
    )


_BLANK = "({0} IS NULL OR {0} IN ('', ' '))"


@query(
    f"""WITH {SQL_PATIENTS} SELECT count(*) AS patients, count(*) FILTER ({_BLANK.format('firstname')}) AS no_first, count(*) FILTER ({_BLANK.format('lastname')}) AS no_last,
    count(*) FILTER ({_BLANK.format('firstname')} AND {_BLANK.format('lastname')}) AS nameless, count(*) FILTER (dob IS NULL OR trim(dob) = '') AS no_dob FROM pats"""
)
def name_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = lambda c: F.col(c).isNull() | F.col(c).isin("", " ")
    return patients(spark, sf_dir).agg(
        F.count("*").alias("patients"), F.count_if(blank("firstname")).alias("no_first"), F.count_if(blank("lastname")).alias("no_last"), F.count_if(rows.nameless()).alias("nameless"), F.count_if(F.col("dob").isNull() | (F.trim("dob") == "")).alias("no_dob")
    )


_DOOMED = f"doomed AS (SELECT patient_id FROM pats WHERE {_BLANK.format('firstname')} AND {_BLANK.format('lastname')})"


@query(
    f"""WITH {SQL_PATIENTS}, {SQL_REPORTS}, {SQL_SECTIONS}, {_DOOMED}
    SELECT 'patients' AS table_name, count(*) AS rows_left FROM pats ANTI JOIN doomed USING (patient_id)
    UNION ALL SELECT 'reports', count(*) FROM reps ANTI JOIN doomed USING (patient_id) UNION ALL SELECT 'report_sections', count(*) FROM secs ANTI JOIN doomed USING (patient_id)"""
)
def cleanup_nameless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left per table after patients without any name and all that is theirs are removed."""
    people = patients(spark, sf_dir)
    left = rows.cascade_delete(people.where(rows.nameless()), "patient_id", {"patients": people, "reports": reports(spark, sf_dir, "patient_id"), "report_sections": sections(spark, sf_dir, "patient_id")})
    counted = [df.agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left") for name, df in left.items()]
    return counted[0].unionAll(counted[1]).unionAll(counted[2])


@query(f"WITH {SQL_PATIENTS}, {SQL_REPORTS}, {_DOOMED} SELECT report_id, patient_id FROM reps SEMI JOIN doomed USING (patient_id)")
def doomed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = patients(spark, sf_dir).where(rows.nameless()).select("patient_id")
    return reports(spark, sf_dir, "patient_id").join(doomed, "patient_id", "left_semi").select("report_id", "patient_id")


@query(
    f"""WITH {SQL_SECTIONS}, {SQL_REPORTS} SELECT s.section_id, r.report_id, r.patient_id, upper(trim(s.section_name)) AS section_name, CAST(r.report_date AS VARCHAR) AS report_date
    FROM secs s JOIN reps r ON s.report_id = r.report_id"""
)
def sections_with_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = sections(spark, sf_dir, "report_id", "section_name").select("section_id", "report_id", F.upper(F.trim("section_name")).alias("section_name"))
    right = reports(spark, sf_dir, "patient_id", "report_date").select("report_id", "patient_id", F.col("report_date").cast("string").alias("report_date"))
    return left.join(right, "report_id").select("section_id", "report_id", "patient_id", "section_name", "report_date")


@query(f"WITH {SQL_ITEMS}, {SQL_REPORTS} SELECT qa_id, r.report_id, r.patient_id FROM items JOIN reps r ON items.report_key = lower(trim(r.report_id))")
def qa_with_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = reports(spark, sf_dir, "patient_id").select(F.lower(F.trim("report_id")).alias("report_key"), "report_id", "patient_id")
    return qa_items(spark, sf_dir, "report_id").select("qa_id", "report_key").join(right, "report_key").select("qa_id", "report_id", "patient_id")


@query(
    f"""WITH {SQL_SECTIONS}, {SQL_PATIENTS} SELECT s.section_id, s.patient_id, coalesce(nullif(trim(p.fullname), ''), nullif(trim(concat_ws(' ', p.firstname, p.lastname)), ''), 'UNKNOWN') AS display_name
    FROM secs s LEFT JOIN pats p ON s.patient_id = p.patient_id"""
)
def sections_with_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join; the name falls back from full name to first and last, then to UNKNOWN."""
    name = F.coalesce(F.nullif(F.trim("fullname"), F.lit("")), F.nullif(F.trim(F.concat_ws(" ", "firstname", "lastname")), F.lit("")), F.lit("UNKNOWN"))
    right = patients(spark, sf_dir)
    return sections(spark, sf_dir, "patient_id").join(right.drop("created_at"), "patient_id", "left").select("section_id", "patient_id", name.alias("display_name"))


@query(f"WITH {SQL_SECTIONS}, {SQL_ITEMS} SELECT section_id FROM secs ANTI JOIN items USING (section_id)")
def sections_without_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read_table(spark, sf_dir, "qa_items").select("section_id")
    return read_table(spark, sf_dir, "report_sections").select("section_id").where("section_id is not null").distinct().join(asked, "section_id", "left_anti")


@query(f"WITH {SQL_SECTIONS} SELECT section_id, length(section_content) AS chars FROM secs WHERE length(section_content) BETWEEN 200 AND 1200")
def sections_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir, "section_content").where(F.length("section_content").between(200, 1200)).select("section_id", F.length("section_content").alias("chars"))


@query(f"WITH {SQL_REPORTS} SELECT report_id FROM reps WHERE coalesce(lower(report_type), '') <> 'labor' AND regexp_matches(coalesce(content, ''), '[^\\s\\x0b\\x85\\p{{Z}}]')")
def reports_for_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that are neither lab values nor blank; a null type stays."""
    df = reports(spark, sf_dir, "report_type", "content")
    return df.where((F.lower(F.coalesce("report_type", F.lit(""))) != "labor") & F.coalesce("content", F.lit("")).rlike(r"(?U)\S")).select("report_id")


@query("SELECT report_id, filename, report_type FROM reports ORDER BY report_id, created_at, filename, report_type LIMIT 10")
def preview_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows; a preview's limit is its purpose."""
    return read_table(spark, sf_dir, "reports").orderBy("report_id", "created_at", "filename", "report_type").limit(10).select("report_id", "filename", "report_type")


_EXTRACT = r"""cut AS (SELECT report_id, regexp_split_to_array(content, '(?m)^##\s*.+?$') AS texts, regexp_extract_all(content, '(?m)^(##\s*.+?)$', 1) AS heads FROM reps),
    parts AS (SELECT report_id, unnest(range(2 * len(texts))) AS i, texts, heads FROM cut),
    trimmed AS (SELECT report_id, i, regexp_replace(coalesce(CASE WHEN i % 2 = 0 THEN texts[i // 2 + 1] ELSE heads[i // 2 + 1] END, ''), '^[\s\x0b\x85\p{Z}]+|[\s\x0b\x85\p{Z}]+$', '', 'g') AS p FROM parts),
    named AS (SELECT report_id, i, p, p LIKE '##%' AS is_head FROM trimmed WHERE p <> ''),
    heads2 AS (SELECT *, CASE WHEN is_head THEN regexp_replace(substr(p, 3), '^[\s\x0b\x85\p{Z}]+|[\s\x0b\x85\p{Z}]+$', '', 'g') END AS line FROM named),
    heads3 AS (SELECT *, CASE WHEN line LIKE '%:%' THEN regexp_replace(split_part(line, ':', 1), '[\s\x0b\x85\p{Z}]+$', '') ELSE regexp_extract(line, '^[^\s\x0b\x85\p{Z}]*') END AS nm FROM heads2),
    filled AS (SELECT report_id, i, p, is_head, last_value(nm IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS name FROM heads3)"""


@query(f"WITH {SQL_REPORTS}, {_EXTRACT} SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY i) - 1 AS section_order, name AS section_name, p AS body FROM filled WHERE NOT is_head AND coalesce(name, '') <> ''")
def sections_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports(spark, sf_dir, "content").select("report_id", F.posexplode(extract_sections("content")).alias("section_order", "s"))
    return df.select("report_id", "section_order", F.col("s.name").alias("section_name"), F.col("s.body").alias("body"))


# The fold over the sections of a report, a step for each; n: words of a section.
_MERGED = f"""{_EXTRACT}, parts_n AS (SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY i) AS k, name, p AS body, {sql_word_count('p')} AS n FROM filled WHERE NOT is_head AND coalesce(name, '') <> ''),
    fold(report_id, k, names, bodies, is_open, held) AS (
        SELECT DISTINCT report_id, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false, 0::BIGINT FROM parts_n
        UNION ALL
        SELECT f.report_id, p.k,
            CASE WHEN len(names) > 0 AND (is_open OR n < 50) THEN names ELSE list_append(names, name) END,
            CASE WHEN len(names) > 0 AND (is_open OR n < 50) THEN list_append(bodies[1:len(bodies) - 1], bodies[-1] || chr(10) || chr(10) || '## ' || name || ':' || chr(10) || body)
                WHEN len(names) = 0 AND n < 50 THEN ['## ' || name || ':' || chr(10) || body] ELSE list_append(bodies, body) END,
            CASE WHEN len(names) = 0 THEN n < 50 WHEN is_open THEN held + n < 50 ELSE false END,
            CASE WHEN len(names) = 0 AND n < 50 THEN n WHEN is_open THEN held + n ELSE 0 END
        FROM fold f JOIN parts_n p ON p.report_id = f.report_id AND p.k = f.k + 1),
    folded AS (SELECT * FROM fold f WHERE k = (SELECT max(k) FROM parts_n p WHERE p.report_id = f.report_id)),
    merged AS (SELECT report_id, unnest(range(len(names))) AS section_order, unnest(names) AS name, unnest(bodies) AS body FROM folded)"""


@query(f"WITH RECURSIVE {SQL_REPORTS}, {_MERGED} SELECT report_id, section_order, name AS section_name, body FROM merged")
def sections_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports(spark, sf_dir, "content").select("report_id", F.posexplode(merge_small(extract_sections("content"))).alias("section_order", "s"))
    return df.select("report_id", "section_order", F.col("s.name").alias("section_name"), F.col("s.body").alias("body"))


_CHUNKS = f"""{_MERGED}, kept AS (SELECT * FROM reps WHERE lower(coalesce(report_type, '')) <> 'labor' AND regexp_matches(coalesce(content, ''), '[^\\s\\x0b\\x85\\p{{Z}}]')),
    whole AS (SELECT k.report_id, 0 AS section_order, 'Full report' AS name, content AS body FROM kept k ANTI JOIN merged m USING (report_id)),
    every AS (SELECT m.* FROM merged m SEMI JOIN kept USING (report_id) UNION ALL SELECT * FROM whole),
    worded AS (SELECT *, {sql_words('body')} AS w FROM every),
    cut_up AS (SELECT *, unnest(CASE WHEN len(w) <= 350 THEN [0] ELSE list_filter(range(0, len(w), 300), lambda s: s = 0 OR s < len(w) - 50) END) AS s FROM worded),
    pieces AS (SELECT *, s // 300 AS chunk_index, CASE WHEN len(w) <= 350 THEN body ELSE array_to_string(w[s + 1 : s + 350], ' ') END AS text FROM cut_up)"""


@query(
    f"""WITH RECURSIVE {SQL_REPORTS}, {_CHUNKS} SELECT p.report_id || '_sec_' || lpad(CAST((section_order + 1) * 1000 + chunk_index AS VARCHAR), CAST(greatest(3, length(CAST((section_order + 1) * 1000 + chunk_index AS VARCHAR))) AS INT), '0') || '_' || left(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), 30) AS section_id,
    p.report_id, k.patient_id, CASE WHEN len(w) > 350 THEN name || ' (part ' || (chunk_index + 1) || ')' ELSE name END AS section_name, text AS section_content, section_order + 1 AS section_order, chunk_index, {sql_word_count('text')} AS word_count,
    k.filename, k.report_type, CAST(k.report_date AS VARCHAR) AS report_date, CAST(k.created_at AS VARCHAR) AS created_at, k.source_path FROM pieces p JOIN kept k USING (report_id)"""
)
def report_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_chunks(reports(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("report_date", "created_at")})


@query(
    f"""WITH w AS (SELECT doc_id, text, {sql_words('text')} AS w FROM documents WHERE text IS NOT NULL),
    starts AS (SELECT doc_id, text, w, unnest(CASE WHEN len(w) <= 350 THEN [0] ELSE list_filter(range(0, len(w), 300), lambda s: s = 0 OR s < len(w) - 50) END) AS s FROM w)
    SELECT doc_id, s // 300 AS chunk_index, CASE WHEN len(w) <= 350 THEN text ELSE array_to_string(w[s + 1 : s + 350], ' ') END AS chunk FROM starts"""
)
def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"))
    return df.select("doc_id", F.posexplode(overlap_windows(F.col("text"))).alias("chunk_index", "chunk"))


@query(
    f"""WITH RECURSIVE {SQL_REPORTS}, {_MERGED}, stages AS (SELECT 'original' AS stage, n AS words FROM parts_n UNION ALL SELECT 'merged', {sql_word_count('body')} FROM merged)
    SELECT stage, count(*) AS sections, round(avg(words), 6) AS mean_words, median(words) AS median_words, max(words) AS max_words, count(*) FILTER (words < 50) AS small FROM stages GROUP BY 1"""
)
def merge_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections before and after merging: how many, and their words."""
    df = reports(spark, sf_dir, "content").select(extract_sections("content").alias("a")).select("a", merge_small(F.col("a")).alias("b"))
    sides = [df.select(F.lit(name).alias("stage"), F.explode(c).alias("s")) for name, c in (("original", "a"), ("merged", "b"))]
    w = word_count("s.body")
    return sides[0].unionAll(sides[1]).groupBy("stage").agg(F.count("*").alias("sections"), F.round(F.avg(w), 6).alias("mean_words"), F.median(w).alias("median_words"), F.max(w).alias("max_words"), F.count_if(w < 50).alias("small"))


@query(
    f"""WITH {SQL_SECTIONS}, per AS (SELECT patient_id, report_id, count(*) AS n FROM secs GROUP BY ALL),
    by_patient AS (SELECT sum(n) AS n FROM per WHERE patient_id IS NOT NULL GROUP BY patient_id), by_report AS (SELECT sum(n) AS n FROM per WHERE report_id IS NOT NULL GROUP BY report_id)
    SELECT 'patient' AS unit, count(*) AS units, round(avg(n), 6) AS mean_n, max(n)::BIGINT AS max_n, median(n) AS median_n, min(n)::BIGINT AS min_n, sum(n)::BIGINT AS total FROM by_patient
    UNION ALL SELECT 'report', count(*), round(avg(n), 6), max(n)::BIGINT, median(n), min(n)::BIGINT, sum(n)::BIGINT FROM by_report"""
)
def snippet_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = sections(spark, sf_dir, "patient_id", "report_id").groupBy("patient_id", "report_id").agg(F.count("*").alias("n"))
    out = []
    for unit in ("patient", "report"):
        counts = per.where(F.col(f"{unit}_id").isNotNull()).groupBy(f"{unit}_id").agg(F.sum("n").alias("n"))
        out.append(
            counts.agg(F.count("*").alias("units"), F.round(F.avg("n"), 6).alias("mean_n"), F.max("n").alias("max_n"), F.median("n").alias("median_n"), F.min("n").alias("min_n"), F.sum("n").alias("total")).select(F.lit(unit).alias("unit"), "*")
        )
    return out[0].unionAll(out[1])
