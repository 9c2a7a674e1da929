"""Ids, file names and report types derived from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report types in the order in which a file name is searched for them.
REPORT_TYPES = ["Arztbrief", "Cytologie", "Flow cytometry", "Cytology", "Flow", "Path", "Beschluss", "RAD", "labor"]
# Category by folder.
CATEGORIES = {
    "Arzbriefe Ambulanz bis 2020": "Arztbrief",
    "Arztbriefe Ambulanz bis 2020": "Arztbrief",
    "Arztbriefe": "Arztbrief",
    "Cytology": "Cytologie",
    "Flow-Cytology": "Flow Cytometry",
    "Flow cytology": "Flow Cytometry",
}


def report_type_of(c: Column | str, default: str = "Arztbrief") -> Column:
    """The first type that the name contains in any case; else, or for null, the default."""
    lower = F.lower(F.col(c) if isinstance(c, str) else c)
    chain = F
    for kind in REPORT_TYPES:
        chain = chain.when(lower.contains(kind.lower()), kind)
    return chain.otherwise(default)


def stem_of(c: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")


def safe_id(patient: Column | str, filename: Column | str, size: int = 60) -> Column:
    """patient_stem with white space and unsafe characters as underscores, stem cut to `size`."""
    stem = F.regexp_replace(F.regexp_replace(stem_of(filename), r"\s+", "_"), r"^_+|_+$", "")
    stem = F.substring(F.regexp_replace(stem, r"[^A-Za-z0-9._-]", "_"), 1, size)
    return F.concat(F.col(patient) if isinstance(patient, str) else patient, F.lit("_"), stem)


def section_id(report: Column, order: Column, name: Column) -> Column:
    """report_sec_NNN_Name: the order padded to three digits, never cut."""
    clean = F.substring(F.regexp_replace(name, r"[^A-Za-z0-9]+", "_"), 1, 30)
    return F.concat(report, F.lit("_sec_"), F.format_string("%03d", order), F.lit("_"), clean)


def with_category(filename: Column, category: Column) -> Column:
    """stem (category).ext"""
    return F.concat(stem_of(filename), F.lit(" ("), category, F.lit(")"), F.regexp_extract(filename, r"(?<=.)\.[^.]*$", 0))
