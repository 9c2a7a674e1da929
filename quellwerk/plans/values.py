"""Scalar functions over the tables: names of files, dates, words, grams, tags, JSON, highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.functions import dates, naming, text
from quellwerk.functions.names import compose, fold, fuzzy_ratio
from quellwerk.plans.registry import query
from quellwerk.plans.tables import SQL_ITEMS, SQL_PATIENTS, SQL_REPORTS, SQL_SECTIONS, patients, qa_items, reports, sections, sql_word_count, sql_words
from quellwerk.session import read_table, spread

_PIVOT = rf"CASE WHEN {'{0}'} <> '' THEN regexp_replace({'{0}'}, '\d\d$', '') || CASE WHEN CAST(right({'{0}'}, 2) AS INT) <= 25 THEN '20' ELSE '19' END || right({'{0}'}, 2) END"
_D = "try_cast(try_strptime({0}, '%d.%m.%Y') AS DATE)"
_LONG = r"regexp_extract(filename, '\b(\d{1,2}\.\d{1,2}\.\d{4})\b', 1)"
_SHORT = r"regexp_extract(filename, '\b(\d{1,2}\.\d{1,2}\.\d{2})\b', 1)"
_TYPES = " ".join(f"WHEN contains(lower(filename), '{t.lower()}') THEN '{t}'" for t in naming.REPORT_TYPES)


@query(
    rf"""WITH {SQL_REPORTS} SELECT report_id,
    CAST(coalesce({_D.format(_LONG)}, {_D.format(_PIVOT.format(_SHORT))}) AS VARCHAR) AS file_date,
    CASE {_TYPES} ELSE 'Arztbrief' END AS file_type,
    patient_id || '_' || left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(filename, '(.)\.[^.]*$', '\1'), '\s+', '_', 'g'), '^_+|_+$', '', 'g'), '[^A-Za-z0-9._-]', '_', 'g'), 60) AS safe_id
    FROM reps WHERE filename IS NOT NULL"""
)
def filename_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports(spark, sf_dir, "filename", "patient_id").where("filename is not null")
    return df.select("report_id", dates.date_from_filename("filename").cast("string").alias("file_date"), naming.report_type_of("filename").alias("file_type"), naming.safe_id("patient_id", "filename").alias("safe_id"))


@query(rf"SELECT report_id, regexp_extract(source_path, '\d{{1,2}}\.\d{{1,2}}\.20\d{{2}}') AS path_date FROM (SELECT DISTINCT report_id, source_path FROM reports)")
def path_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "reports").select("report_id", "source_path").distinct()
    return df.select("report_id", F.regexp_extract("source_path", r"\d{1,2}\.\d{1,2}\.20\d{2}", 0).alias("path_date"))


@query(f"SELECT doc_id, {sql_word_count('text')} AS words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.word_count("text").alias("words"))


_GRAMS = r"""norm AS (SELECT doc_id, replace(trim(regexp_replace(lower(coalesce(text, '')), '[^0-9a-zA-ZäöüÄÖÜß]+', ' ', 'g')), ' ', '_') AS t FROM documents),
    grams AS (SELECT doc_id, CASE WHEN length(t) >= 3 THEN substr(t, i, 3) ELSE t END AS gram FROM (SELECT *, unnest(range(1, CASE WHEN t = '' THEN 0 ELSE greatest(length(t) - 2, 1) END + 1)) AS i FROM norm))"""


@query(f"WITH {_GRAMS} SELECT gram, count(*) AS tf, count(DISTINCT doc_id) AS df FROM grams GROUP BY gram")
def char_gram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term and document frequency of each character gram: counted inside rows, combined before the shuffle."""
    from quellwerk.operators.retrieval import gram_counts

    grams = gram_counts(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
    return grams.groupBy(F.col("term").alias("gram")).agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(
    rf"""WITH {SQL_PATIENTS}, d AS (SELECT patient_id, trim(dob) AS t FROM pats)
    SELECT patient_id, CAST(CASE WHEN year(x) >= 1900 THEN x END AS VARCHAR) AS birth_date, CASE WHEN t IS NULL THEN NULL ELSE coalesce(strftime(CASE WHEN regexp_matches(t, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN try_cast(t AS DATE) END, '%d.%m.%Y'), t) END AS shown
    FROM (SELECT *, coalesce(CASE WHEN regexp_matches(t, '^\d{{1,2}}[-./]\d{{1,2}}[-./](19|20)\d{{2}}$') THEN {_D.format("regexp_replace(t, '[/-]', '.', 'g')")} END, CASE WHEN regexp_matches(t, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN try_cast(try_strptime(t, '%Y-%m-%d') AS DATE) END) AS x FROM d)"""
)
def birth_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = patients(spark, sf_dir).select("patient_id", F.trim("dob").alias("t"))
    return df.select("patient_id", dates.birth_date("t").cast("string").alias("birth_date"), dates.german_text("t").alias("shown"))


def _sql_fold(c: str) -> str:
    return f"trim(lower(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g')))"


# The longest common subsequence row by row: rows[j] is its length for the first j characters of b.
_LCS = """list_reduce(list_concat([list_transform(range(length(b) + 1), lambda j: 0::BIGINT)], list_transform(range(length(a)), lambda i: [ascii(substr(a, i + 1, 1))::BIGINT])),
    lambda row, x: list_transform(range(len(row)), lambda j: greatest(row[j + 1], coalesce(list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN ascii(substr(b, i, 1)) = x[1] THEN row[i] + 1 ELSE 0 END)), 0))))[-1]"""


@query(
    f"""WITH {SQL_PATIENTS}, f AS (SELECT patient_id, trim(nfc_normalize(fullname)) AS composed, {_sql_fold('fullname')} AS folded, {_sql_fold('firstname')} AS a, {_sql_fold('lastname')} AS b FROM pats)
    SELECT patient_id, composed, folded, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN length(a) + length(b) = 0 THEN 100.0 ELSE 200.0 * ({_LCS}) / (length(a) + length(b)) END AS ratio FROM f"""
)
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = patients(spark, sf_dir)
    return df.select("patient_id", compose("fullname").alias("composed"), fold("fullname").alias("folded"), fuzzy_ratio(fold("firstname"), fold("lastname")).alias("ratio"))


@query(f"WITH {SQL_SECTIONS} SELECT section_id, replace(replace(section_content, 'Untersucher', '___'), '(Ref.', '___') AS redacted, section_content <> replace(replace(section_content, 'Untersucher', '___'), '(Ref.', '___') AS changed FROM secs")
def redact_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caller-supplied literals replaced in order."""
    df = sections(spark, sf_dir, "section_content")
    done = text.redact_patterns("section_content", ["Untersucher", "(Ref."])
    return df.select("section_id", done.alias("redacted"), (F.col("section_content") != done).alias("changed"))


@query(
    f"""WITH {SQL_REPORTS}, f AS (SELECT DISTINCT report_id, filename, CASE lower(trim(report_type)) WHEN 'rad' THEN 'Radiologie' WHEN 'path' THEN 'Pathologie' ELSE 'Unknown' END AS category FROM reps WHERE filename IS NOT NULL AND NOT (contains(filename, '(') AND contains(filename, ')')))
    SELECT report_id, category, regexp_replace(filename, '(.)\\.[^.]*$', '\\1') || ' (' || category || ')' || regexp_extract(filename, '.(\\.[^.]*)$', 1) AS target FROM f"""
)
def categorised_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rename plan: category from a mapping with a default, names that already carry one left out."""
    mapping = F.create_map(F.lit("rad"), F.lit("Radiologie"), F.lit("path"), F.lit("Pathologie"))
    df = reports(spark, sf_dir, "filename", "report_type").where("filename is not null").where(~(F.col("filename").contains("(") & F.col("filename").contains(")")))
    category = F.coalesce(F.try_element_at(mapping, F.lower(F.trim("report_type"))), F.lit("Unknown"))
    return df.select("report_id", category.alias("category"), naming.with_category(F.col("filename"), category).alias("target"))


@query(f"WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents WHERE source IS NOT NULL) SELECT doc_id, CASE WHEN r = 0 THEN source ELSE source || '-' || (r + 1) END AS target FROM d")
def unique_target_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, name-2, name-3, ...: ranks inside a hot source come from salted counts, not from one task."""
    from quellwerk.operators.ranks import salted_rank

    ranked = salted_rank(read_table(spark, sf_dir, "documents").select("doc_id", "source").where("source is not null"), "source", "doc_id")
    return ranked.select("doc_id", F.when(F.col("rank") == 0, F.col("source")).otherwise(F.concat("source", F.lit("-"), (F.col("rank") + 1).cast("string"))).alias("target"))


_NEG = r"(?i)(^|[^\p{L}\p{N}_])(kein|keine|keiner|ohne|fehlt|fehlend|Ausschluss|negativ|nicht|unauffällig)($|[^\p{L}\p{N}_])"
_CMP = r"(?i)(^|[^\p{L}\p{N}_])(verglichen (mit|zu)|seit|gegenüber|im Vergleich|Verlauf|Veränderung)($|[^\p{L}\p{N}_])"


@query(
    rf"""WITH {SQL_ITEMS}, {SQL_SECTIONS} SELECT qa_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(coalesce(answer_text, ''), '\d') THEN 'numeric' END,
    CASE WHEN regexp_matches(coalesce(answer_text, ''), '{_NEG}') OR regexp_matches(coalesce(section_content, ''), '{_NEG}') THEN 'negation' END,
    CASE WHEN regexp_matches(coalesce(section_content, ''), '{_CMP}') THEN 'comparison' END], lambda x: x IS NOT NULL)), ',') AS tags
    FROM items LEFT JOIN secs USING (section_id)"""
)
def phenomena_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = qa_items(spark, sf_dir, "section_id", "answer_text").drop("created_at").join(sections(spark, sf_dir, "section_content").select("section_id", "section_content"), "section_id", "left")
    return joined.select("qa_id", F.array_join(text.phenomena_tags(F.col("answer_text"), F.col("section_content")), ",").alias("tags"))


@query(
    f"""WITH {SQL_ITEMS}, q AS (SELECT qa_id, lower(coalesce(question, '')) AS t, lower(coalesce(section_name, '')) AS s, {sql_word_count('question')} AS n FROM items)
    SELECT qa_id, n < 8 OR {' OR '.join(f"contains(t, '{p}')" for p in text.TRIVIAL)} OR contains(t, 'was ist ' || s) OR contains(t, 'was steht in ' || s) AS trivial FROM q"""
)
def trivial_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_items(spark, sf_dir, "question", "section_name").select("qa_id", text.trivial_question(F.col("question"), F.col("section_name")).alias("trivial"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS INT), -1) AS missing FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k INT, missing INT")
    return read_table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select("event_id", "p.k", F.coalesce("p.missing", F.lit(-1)).alias("missing"))


@query(
    f"""WITH {SQL_ITEMS}, c AS (SELECT qa_id, trim(regexp_replace(coalesce(question, '') || chr(10) || coalesce(answer_text, ''), '[\\s\\x0b\\x85\\p{{Z}}]+', ' ', 'g')) AS t FROM items)
    SELECT qa_id, CASE WHEN length(t) > 1000 THEN left(t, 997) || '...' ELSE t END AS line FROM c"""
)
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut only over 1,000 characters."""
    joined = F.concat(F.coalesce("question", F.lit("")), F.lit("\n"), F.coalesce("answer_text", F.lit("")))
    return qa_items(spark, sf_dir, "question", "answer_text").select("qa_id", text.clean_csv(joined).alias("line"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", text.preview("text").alias("preview"))


@query(
    f"""WITH {SQL_ITEMS}, {SQL_SECTIONS}, j AS (SELECT qa_id, section_content AS c, answer_text AS a, array_to_string(({sql_words('answer_text')})[1:10], ' ') AS f, {sql_word_count('answer_text')} AS n FROM items JOIN secs USING (section_id))
    SELECT qa_id, CASE WHEN length(a) > 20 AND contains(c, a) THEN replace(c, a, '<mark>' || a || '</mark>') WHEN length(a) > 20 AND n >= 5 AND contains(c, f) THEN replace(c, f, '<mark>' || f || '</mark>') ELSE c END AS marked FROM j"""
)
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = qa_items(spark, sf_dir, "section_id", "answer_text").drop("created_at").join(sections(spark, sf_dir, "section_content").select("section_id", "section_content"), "section_id")
    return joined.select("qa_id", text.highlight(F.col("section_content"), F.col("answer_text")).alias("marked"))


@query(
    rf"""WITH j AS (SELECT qa_id, '```json' || chr(10) || '[' || CAST(to_json(struct_pack(question := question, answer_text := answer_text)) AS VARCHAR) || ']' || chr(10) || '```' AS raw FROM (SELECT DISTINCT qa_id, question, answer_text FROM qa_items))
    SELECT qa_id, coalesce(json_extract_string(regexp_extract(raw, '(?s)\[.*\]'), '$[0].question'), '') AS question FROM j"""
)
def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator output in code fences, parsed back into items."""
    df = read_table(spark, sf_dir, "qa_items").select("qa_id", "question", "answer_text").distinct()
    raw = F.concat(F.lit("```json\n["), F.to_json(F.struct("question", "answer_text")), F.lit("]\n```"))
    items = F.from_json(text.fenced_json(raw), "array<struct<question: string, answer_text: string>>")
    return df.select("qa_id", F.coalesce(F.get(items, F.lit(0))["question"], F.lit("")).alias("question"))
