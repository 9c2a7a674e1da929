"""The engine's facade: what a client asks over HTTP in other systems, as methods that return DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.functions.dates import german_text
from quellwerk.functions.names import porter_stem
from quellwerk.functions.text import fts_terms, words
from quellwerk.operators import retrieval
from quellwerk.session import cut_lineage
from quellwerk.sources import files
from quellwerk.streaming import sessions


@dataclass
class SearchRequest:
    """One search; a single patient wins over a list of patients."""

    text: str
    k: int = 20
    level: str = "combined"
    patient_id: str | None = None
    patient_ids: list[str] = field(default_factory=list)
    report_types: list[str] = field(default_factory=list)
    section_types: list[str] = field(default_factory=list)
    date_from: str | None = None
    date_to: str | None = None
    per_patient: bool = False
    least_score: float = 0.0

    def condition(self, columns: list[str]) -> Column:
        """The filters that apply to a table with these columns; a null date fails any date filter."""
        parts = [F.lit(True)]
        if self.patient_id:
            parts.append(F.col("patient_id") == self.patient_id)
        elif self.patient_ids:
            parts.append(F.col("patient_id").isin(self.patient_ids))
        if self.report_types and "report_type" in columns:
            parts.append(F.col("report_type").isin(self.report_types))
        if self.section_types and "section_name" in columns:
            parts.append(F.col("section_name").isin(self.section_types))
        if self.date_from:
            parts.append(F.coalesce(F.col("report_date") >= F.lit(self.date_from).cast("date"), F.lit(False)))
        if self.date_to:
            parts.append(F.coalesce(F.col("report_date") <= F.lit(self.date_to).cast("date"), F.lit(False)))
        out = parts[0]
        for part in parts[1:]:
            out = out & part
        return out


def search_directory(people: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Patients whose names, id or birth date (also as shown in German) contain the text, likeliest first."""
    wanted = text.strip().lower()
    shown = german_text("dob")
    if not wanted:
        return people.withColumn("shown", shown).withColumn("priority", F.lit(4)).orderBy("fullname", "patient_id").limit(limit)
    fields = [F.lower(c) for c in ("fullname", "firstname", "lastname", "patient_id", "dob")] + [F.lower(shown)]
    match = F.lit(False)
    for c in fields:
        match = match | F.coalesce(c.contains(wanted), F.lit(False))
    starts = lambda c: F.coalesce(F.startswith(F.lower(c), F.lit(wanted)), F.lit(False))
    priority = F.when(starts("patient_id"), 1).when(starts("fullname"), 2).when(starts("firstname") | starts("lastname"), 3).otherwise(4)
    return people.where(match).withColumn("shown", shown).withColumn("priority", priority).orderBy("priority", "fullname", "patient_id").limit(limit)


def snippet(content: Column, terms: list[str], size: int = 20) -> Column:
    """Words around the first one that begins with a term; else the first 200 characters."""
    found = words(content)
    at = F.array_position(F.transform(found, lambda w: F.coalesce(F.exists(F.array(*map(F.lit, terms)), lambda t: F.startswith(F.lower(w), t)), F.lit(False))), True)
    return F.when(at > 0, F.array_join(F.slice(found, F.greatest(at - size // 2, F.lit(1)).cast("int"), F.lit(size)), " ")).otherwise(F.substring(content, 1, 200))


def answer_prompt(template: str, context: Column, question: Column) -> Column:
    """A prompt from a template with {context} and {question}."""
    return F.replace(F.replace(F.lit(template), F.lit("{context}"), context), F.lit("{question}"), question)


def document_url(report: Column, section: Column) -> Column:
    """A link to a report, or to its section."""
    return F.concat(F.lit("#/document/"), report, F.coalesce(F.concat(F.lit("/section/"), section), F.lit("")))


def context_block(number: Column, report: Column, section: Column, date: Column, path: Column, score: Column, text: Column) -> Column:
    """A hit as a numbered header and its text; the date is that of the path if it names one."""
    named = F.nullif(F.regexp_extract(path, r"\d{1,2}\.\d{1,2}\.20\d{2}", 0), F.lit(""))
    shown = F.coalesce(named, date.cast("string"), F.lit("Unbekanntes Datum"))
    points = F.when(score > 0, F.format_string("BM25: %.3f", score)).otherwise("Score: N/A")
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.concat(F.lit("["), number.cast("string"), F.lit("] Bericht: "), report, F.lit(" | Abschnitt: "), F.coalesce(section, F.lit("")), F.lit(" | Datum: "), shown, F.lit(" | "), points, F.lit("\n"), body)


def citation(kind: Column, section: Column, date: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(kind, F.lit("")), F.coalesce(F.concat(F.lit(" - "), section), F.lit("")), F.lit(" • "), F.coalesce(F.date_format(date, "dd.MM.yyyy"), F.lit("")), F.lit("]"))


def index_version(level: str, k: int, group: bool) -> str:
    return f"quellwerk-{level}-{k}" + ("-group" if group else "")


class Engine:
    """Searches over tables given as DataFrames: patients, reports, sections (with section_id and section_content)."""

    def __init__(self, spark: SparkSession, patients: DataFrame, reports: DataFrame, sections: DataFrame):
        self.spark, self.patients, self.reports, self.sections = spark, patients, reports, sections

    def health(self) -> dict[str, str]:
        return {"status": "ok", "version": self.spark.version}

    def directory(self, text: str, limit: int = 50) -> DataFrame:
        return search_directory(self.patients, text, limit)

    def report_types(self) -> DataFrame:
        return self.reports.select("report_type").where("report_type is not null").distinct().orderBy("report_type")

    def section_types(self) -> DataFrame:
        return self.sections.where("section_name is not null").groupBy("section_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section_name")

    def report(self, report_id: str) -> DataFrame:
        return self.reports.where(F.col("report_id") == report_id)

    def _ranked(self, docs: DataFrame, key: str, body: str, request: SearchRequest) -> DataFrame:
        terms = [t.lower() for t in fts_terms(request.text)]
        stems = list(dict.fromkeys(map(porter_stem, terms)))
        text = " ".join(terms)
        index = cut_lineage(retrieval.search_index(docs, key, body, retrieval.cut_stems, only=np.unique(retrieval.cut_stems([text])[1])))
        asked = self.spark.createDataFrame([(0, text)], "query_id int, text string")
        scored = retrieval.bm25_search(index, asked, None, retrieval.cut_stems, floor=True).where(F.col("score") > request.least_score)
        hits = docs.where(request.condition(docs.columns)).withColumn("id", F.col(key)).join(scored.select("id", "score"), "id")
        hits = hits.withColumn("snippet", snippet(F.col(body), list(dict.fromkeys(terms + stems))))
        if request.per_patient:
            return retrieval.top_k(hits, ["patient_id"], request.k)
        return hits.orderBy(F.desc("score"), "id").limit(request.k)

    def search_sections(self, request: SearchRequest) -> DataFrame:
        return self._ranked(self.sections, "section_id", "section_content", request)

    def search_reports(self, request: SearchRequest) -> DataFrame:
        return self._ranked(self.reports, "report_id", "content", request)

    def search(self, request: SearchRequest) -> DataFrame:
        """By the request's level: sections, reports, or half of each."""
        if request.level == "sections":
            return self.search_sections(request)
        if request.level == "reports":
            return self.search_reports(request)
        if request.level != "combined":
            raise ValueError(f"no level {request.level}")
        return retrieval.combine(self.search_sections(request), self.search_reports(request), request.k)

    def answer(self, request: SearchRequest, generator: Callable[[str], str], template: str, empty: str = "{question}") -> dict:
        """Search, prompt and a supplied model's answer: status ok, insufficient (no hit) or error, citations, latencies in whole milliseconds.

        At most k hits come to the driver. Without a hit the model gets the `empty` template.
        """
        began = time.monotonic()
        hits = [r.asDict() for r in self.search(request).collect()]
        found = time.monotonic()
        group = not request.patient_id and len(request.patient_ids) > 1
        context = "\n\n".join(f"[{i}] {('Patient: ' + h['patient_id'] + ' | ') if group and h.get('patient_id') else ''}{h['id']}\n{h.get('snippet') or ''}" for i, h in enumerate(hits, 1))
        warnings = [] if hits else ["no relevant documents"]
        try:
            text = generator((template if hits else empty).replace("{context}", context).replace("{question}", request.text))
            status = "ok" if hits else "insufficient"
        except Exception as error:  # noqa: BLE001  any failure of a supplied model is an answer of its own
            text, status, warnings = str(error), "error", [*warnings, "the model failed"]
        done = time.monotonic()
        latency = {"retrieval": round((found - began) * 1000), "generation": round((done - found) * 1000), "total": round((done - began) * 1000)}
        return {"status": status, "text": text, "cited": [h["id"] for h in hits] if status != "error" else [], "warnings": warnings, "index_version": index_version(request.level, request.k, group), "latency": latency}

    def log(self, entries: DataFrame, folder: str) -> None:
        """Append session entries to the nested log and to the flat one."""
        files.append_json(entries, f"{folder}/json")
        files.append_csv(sessions.flatten(entries), f"{folder}/csv")

    def sessions(self, folder: str) -> DataFrame:
        """The logged entries."""
        return files.read_sessions(self.spark, f"{folder}/json")
