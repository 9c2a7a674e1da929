"""Session logs: flattening of nested entries, hits per patient, and the stream that tails a log folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quellwerk.functions.text import clean_csv
from quellwerk.schema import SESSION_LOG


def _text(path: str) -> Column:
    return F.coalesce(F.col(path).cast("string"), F.lit(""))


# The flat log's columns, in order, with the field each holds.
FLAT = [
    ("timestamp", "timestamp"),
    ("session_id", "session_id"),
    ("patient_id", "patient.id"),
    ("patient_name", "patient.name"),
    ("patient_dob", "patient.dob"),
    ("question", "query.question"),
    ("k", "query.settings.k"),
    ("search_level", "query.settings.searchLevel"),
    ("doc_types", "query.settings.docTypes"),
    ("section_types", "query.settings.sectionTypes"),
    ("date_start", "query.settings.dateRange.start"),
    ("date_end", "query.settings.dateRange.end"),
    ("answer_status", "results.answer.status"),
    ("answer_text", "results.answer.text"),
    ("source_count", "results.sourceCount"),
    ("model_id", "metadata.modelId"),
    ("retrieval_latency_ms", "metadata.latency.retrieval"),
    ("generation_latency_ms", "metadata.latency.generation"),
    ("total_latency_ms", "metadata.latency.total"),
    ("index_version", "metadata.indexVersion"),
]
CLEANED = {"patient_name", "question", "section_types", "answer_text"}
LISTS = {"doc_types", "section_types"}


def flatten(logs: DataFrame) -> DataFrame:
    """Twenty text columns; a missing field, or a missing struct above it, is empty; lists are joined by commas."""
    columns = []
    for name, path in FLAT:
        value = F.coalesce(F.array_join(F.col(path), ","), F.lit("")) if name in LISTS else _text(path)
        columns.append((clean_csv(value) if name in CLEANED else value).alias(name))
    return logs.select(*columns)


def hits_by_patient(logs: DataFrame) -> DataFrame:
    """(session_id, distribution MAP): sources per patient of each entry, recomputed from the sources."""
    found = logs.select("session_id", "timestamp", F.explode("results.sources").alias("s")).groupBy("session_id", "timestamp", "s.patient_id").agg(F.count("*").cast("int").alias("n"))
    return found.groupBy("session_id", "timestamp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("patient_id", "n")))).alias("distribution"))


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """The log folder as a stream of entries."""
    return spark.readStream.schema(SESSION_LOG).json(folder)


def flatten_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Flatten what is new in the folder since the last run and append it as CSV files."""
    return flatten(tail(spark, folder)).writeStream.format("csv").option("header", "true").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def question_rate(entries: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Questions per window with a watermark for late entries (an extension, for monitoring)."""
    timed = entries.withColumn("at", F.col("timestamp").try_cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w")).agg(F.count("*").alias("questions")).select(F.col("w.start").alias("start"), "questions")
