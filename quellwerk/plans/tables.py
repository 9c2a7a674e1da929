"""The clinical tables with redelivered rows resolved, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.operators.rows import latest
from quellwerk.session import dealt, read_table

GAP = r"[\s\x0b\x85\p{Z}]+"


def patient_key(c: str = "patient_id") -> Column:
    """One spelling for all spellings of a patient id: P and seven digits; null without digits."""
    digits = F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")
    return F.concat(F.lit("P"), F.lpad(digits.cast("string"), 7, "0"))


def sql_patient_key(c: str = "patient_id") -> str:
    return f"'P' || lpad(CAST(try_cast(regexp_replace({c}, '[^0-9]', '', 'g') AS BIGINT) AS VARCHAR), 7, '0')"


def reports(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Reports as first delivered; patient_id in one spelling."""
    df = read_table(spark, sf_dir, "reports")
    kept = df.select(*dict.fromkeys(["report_id", "created_at", "source_path", *columns])) if columns else df
    kept = latest(kept, ["report_id"], [F.col("created_at"), F.col("source_path")])
    return kept.withColumn("patient_id", patient_key()) if "patient_id" in kept.columns else kept


def sections(spark: SparkSession, sf_dir: str, *columns: str, even: bool = False) -> DataFrame:
    """Sections as first delivered; patient_id in one spelling. `even`: on all cores, for Python work."""
    df = read_table(spark, sf_dir, "report_sections")
    kept = df.select(*dict.fromkeys(["section_id", "created_at", "section_key", *columns])) if columns else df
    kept = latest(dealt(kept, "section_id") if even else kept, ["section_id"], [F.col("created_at"), F.col("section_key")])
    return kept.withColumn("patient_id", patient_key()) if "patient_id" in kept.columns else kept


def qa_items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """QA items as first delivered; report_id trimmed, its key in lower case as report_key."""
    df = read_table(spark, sf_dir, "qa_items")
    kept = df.select(*dict.fromkeys(["qa_id", "created_at", *columns])) if columns else df
    kept = latest(kept, ["qa_id"], [F.col("created_at")])
    return kept.withColumn("report_key", F.lower(F.trim("report_id"))) if "report_id" in kept.columns else kept


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row of each patient (upsert)."""
    df = read_table(spark, sf_dir, "patients").withColumn("patient_id", patient_key())
    return latest(df, ["patient_id"], [F.col("created_at").desc(), F.col("fullname").asc_nulls_first(), F.col("firstname").asc_nulls_first(), F.col("lastname").asc_nulls_first(), F.col("dob").asc_nulls_first()])


SQL_REPORTS = f"""reps AS (SELECT * REPLACE ({sql_patient_key()} AS patient_id) FROM reports WHERE report_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY created_at NULLS FIRST, source_path NULLS FIRST) = 1)"""
SQL_SECTIONS = f"""secs AS (SELECT * REPLACE ({sql_patient_key()} AS patient_id) FROM report_sections WHERE section_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY created_at NULLS FIRST, section_key NULLS FIRST) = 1)"""
SQL_ITEMS = """items AS (SELECT *, lower(trim(report_id)) AS report_key FROM qa_items WHERE qa_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY qa_id ORDER BY created_at NULLS FIRST) = 1)"""
SQL_PATIENTS = f"""pats AS (SELECT * FROM (SELECT * REPLACE ({sql_patient_key()} AS patient_id) FROM patients) WHERE patient_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC NULLS LAST, fullname NULLS FIRST, firstname NULLS FIRST, lastname NULLS FIRST, dob NULLS FIRST) = 1)"""


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{GAP}'), lambda x: x <> '')"


def sql_word_count(c: str) -> str:
    return f"coalesce(len({sql_words(c)}), 0)"
