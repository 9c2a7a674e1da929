"""Sections of reports: extraction at ## headings, merging of small ones, overlapping word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellwerk.functions.naming import section_id
from quellwerk.functions.text import word_count, words

HEADER = r"(?md)^(##\s*.+?)$"
SECTION = "array<struct<name: string, body: string>>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def header_name(part: Column) -> Column:
    """Text before the first colon, else the first word, of a header without its ##."""
    line = strip(F.substring(part, 3, 1_000_000))
    first = F.regexp_extract(line, r"(?U)^(\S*)", 1)
    return F.when(line.contains(":"), strip(F.substring_index(line, ":", 1))).otherwise(first)


def extract_sections(content: Column | str) -> Column:
    """array<struct<name, body>> in order; text before the first header and headers without body give none.

    Split texts and found headers alternate; a text part that itself begins with ##
    counts as a header. Null or header-less content gives an empty array.
    """
    content = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    texts = F.split(content, HEADER)
    headers = F.regexp_extract_all(content, F.lit(HEADER), F.lit(1))
    parts = F.flatten(F.transform(texts, lambda t, i: F.array(t, F.coalesce(F.get(headers, i), F.lit("")))))
    parts = F.filter(F.transform(parts, strip), lambda p: p != "")
    start = F.struct(F.array().cast(SECTION).alias("out"), F.lit(None).cast("string").alias("name"))

    def step(acc: Column, part: Column) -> Column:
        head = part.startswith("##")
        keep = F.concat(acc["out"], F.array(F.struct(acc["name"].alias("name"), part.alias("body"))))
        return F.struct(
            F.when(head | acc["name"].isNull() | (acc["name"] == ""), acc["out"]).otherwise(keep).alias("out"), F.when(head, header_name(part)).otherwise(acc["name"]).alias("name")
        )

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def merge_small(sections: Column, least: int = 50) -> Column:
    """Fold of small sections: appended to the one before; a small first one takes followers in until it is large enough."""
    start = F.struct(F.array().cast(SECTION).alias("out"), F.lit(False).alias("open"), F.lit(0).alias("held"))
    headed = lambda s: F.concat(F.lit("## "), s["name"], F.lit(":\n"), s["body"])

    def step(acc: Column, s: Column) -> Column:
        size = word_count(s["body"])
        last = F.element_at(acc["out"], -1)
        grown = F.struct(last["name"].alias("name"), F.concat(last["body"], F.lit("\n\n"), headed(s)).alias("body"))
        swap = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(grown))
        empty = F.size(acc["out"]) == 0
        small_first = F.array(F.struct(s["name"].alias("name"), headed(s).alias("body")))
        fresh = F.struct(F.concat(acc["out"], F.array(F.struct(s["name"].alias("name"), s["body"].alias("body")))).alias("out"), F.lit(False).alias("open"), F.lit(0).alias("held"))
        return (
            F.when(empty & (size < least), F.struct(small_first.alias("out"), F.lit(True).alias("open"), size.alias("held")))
            .when(acc["open"], F.struct(swap.alias("out"), (acc["held"] + size < least).alias("open"), (acc["held"] + size).alias("held")))
            .when(~empty & (size < least), F.struct(swap.alias("out"), F.lit(False).alias("open"), F.lit(0).alias("held")))
            .otherwise(fresh)
        )

    return F.aggregate(sections, start, step, lambda acc: acc["out"])


def overlap_windows(text: Column, size: int = 350, overlap: int = 50) -> Column:
    """array<string>: the text itself up to `size` words, else windows of `size` words, each `size - overlap` after the last."""
    bound = F.array(F.struct(text.alias("t"), F.coalesce(words(text), F.array().cast("array<string>")).alias("w")))

    def cut(b: Column) -> Column:
        n = F.size(b["w"])
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s < n - overlap))
        return F.when(n <= size, F.array(b["t"])).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(b["w"], s + 1, F.lit(size)), " ")))

    return F.transform(bound, cut)[0]


def build_chunks(reports: DataFrame, least: int = 50, size: int = 350, overlap: int = 50) -> DataFrame:
    """Chunks of reports: extract, merge, fall back to the whole report, cut, number. Lab reports and blank ones are skipped.

    No shuffle: every report is worked on where it is read.
    """
    kept = reports.where((F.lower(F.coalesce("report_type", F.lit(""))) != "labor") & (F.coalesce(strip(F.col("content")), F.lit("")) != ""))
    found = merge_small(extract_sections("content"), least)
    sections = kept.withColumn("_s", found).withColumn(
        "_s", F.when(F.size("_s") == 0, F.array(F.struct(F.lit("Full report").alias("name"), F.col("content").alias("body")))).otherwise(F.col("_s"))
    )
    exploded = sections.select("*", F.posexplode("_s").alias("section_order", "_one")).withColumn("_parts", overlap_windows(F.col("_one.body"), size, overlap))
    parts = exploded.select("*", F.posexplode("_parts").alias("chunk_index", "section_content"))
    many = F.size("_parts") > 1
    name = F.when(many, F.concat(F.col("_one.name"), F.lit(" (part "), (F.col("chunk_index") + 1).cast("string"), F.lit(")"))).otherwise(F.col("_one.name"))
    order = (F.col("section_order") + 1) * 1000 + F.col("chunk_index")
    return parts.select(
        section_id(F.col("report_id"), order, F.col("_one.name")).alias("section_id"),
        "report_id",
        "patient_id",
        name.alias("section_name"),
        "section_content",
        (F.col("section_order") + 1).alias("section_order"),
        "chunk_index",
        word_count("section_content").alias("word_count"),
        *[c for c in ("filename", "report_type", "report_date", "created_at", "source_path") if c in reports.columns],
    )
