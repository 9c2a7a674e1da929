"""Linking of files to a roster by birth dates and names, without comparing every file with every patient.

A pair scores above zero only by an equal birth date, an equal folded full name, or
the folded last name inside the file's folded names. Patients that score alike by one
of these are one class, of which only the least id can be a file's best, so a file
meets a patient for each date or name, not all who share them. Last names are looked
for in the distinct names of all files: every run of three characters of the last
name must occur, so its rarest gram is the join key, and containment is checked after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellwerk.functions.dates import birth_date
from quellwerk.functions.names import fold, fuzzy_ratio
from quellwerk.session import cut_lineage

# The forms of name pairs and of birth dates in texts.
NAME_PAIR = r"\b([A-ZÄÖÜ][A-Za-zÄÖÜäöüß']+)\s+([A-ZÄÖÜ][A-Za-zÄÖÜäöüß']+)\b"
GERMAN_DATE = r"\b[0-3]?\d[.][0-1]?\d[.](?:19|20)\d{2}\b"
CAP, DOB, FULL, LAST, FIRST, NEAR = 1.5, 1.0, 0.8, 0.5, 0.3, 90.0
# Lower bounds and labels of score buckets, best first.
BUCKETS = [(1.5, "Perfect (1.5)"), (1.0, "Excellent (1.0-1.4)"), (0.8, "Good (0.8-0.9)"), (0.5, "Fair (0.5-0.7)"), (0.1, "Poor (0.1-0.4)"), (0.0, "No match (0.0)")]


def signals(files: DataFrame, id_col: str, text_col: str, lines: int = 120, before: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, names ARRAY of folded name pairs in both orders, dobs ARRAY<DATE>) of each file.

    The columns of `before` (folder, file name) are lines before the text. Dates are
    taken from all of it, name pairs from its first `lines` lines.
    """
    body = F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in (*before, text_col)))
    found = files.select(F.col(id_col).alias("file_id"), body.alias("b"))
    found = found.select("file_id", "b", F.array_join(F.slice(F.split("b", r"\r?\n"), 1, lines), "\n").alias("h"))
    pairs = F.arrays_zip(F.regexp_extract_all("h", F.lit(NAME_PAIR), F.lit(1)).alias("a"), F.regexp_extract_all("h", F.lit(NAME_PAIR), F.lit(2)).alias("b"))
    both = F.flatten(F.transform(pairs, lambda p: F.array(F.concat_ws(" ", p["a"], p["b"]), F.concat_ws(" ", p["b"], p["a"]))))
    dobs = F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all("b", F.lit(GERMAN_DATE), F.lit(0)), birth_date)))
    joined = found.select("file_id", fold(F.array_join(F.array_distinct(both), "\n")).alias("n"), dobs.alias("dobs"))
    return joined.select("file_id", F.array_distinct(F.filter(F.split("n", "\n"), lambda x: x != "")).alias("names"), "dobs")


def grams(c: str) -> Column:
    """All distinct runs of three characters; a shorter text is its own."""
    return F.array_distinct(F.expr(f"transform(sequence(1, greatest(length({c}) - 2, 1)), i -> substring({c}, i, 3))"))


def surnames_in(vocabulary: DataFrame, lasts: DataFrame) -> DataFrame:
    """(name, last): the last names inside each name, both distinct."""
    in_names = vocabulary.select("name", F.explode(grams("name")).alias("gram"))
    counts = in_names.groupBy("gram").agg(F.count("*").alias("n"))
    of_last = lasts.where(F.length("last") > 2).select("last", F.explode(grams("last")).alias("gram"))
    rarest = of_last.join(counts, "gram", "left").groupBy("last").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = in_names.join(rarest, "gram").where(F.col("name").contains(F.col("last"))).select("name", "last")
    short = lasts.where((F.length("last") > 0) & (F.length("last") < 3))
    if not short.isEmpty():  # surnames under three characters have no gram of their own
        found = found.unionAll(vocabulary.select("name", F.explode(F.array_distinct(short_runs("name"))).alias("last")).join(short, "last").select("name", "last"))
    return found


def near_words(tokens: DataFrame, firsts: DataFrame) -> DataFrame:
    """(token, first) with a fuzzy ratio of NEAR or more; both distinct.

    Such a ratio leaves few insertions and deletions: lengths are close, and words of under
    twenty characters together share an end. Longer ones, cut into a piece more than they
    have edits, share a piece of three characters at least.
    """
    share = 1 - NEAR / 100
    least, most = (F.length("first") * ((1 - share) / (1 + share)) - 1e-9), (F.length("first") * ((1 + share) / (1 - share)) + 1e-9)
    sized = firsts.where(F.length("first") > 0).select("first", F.explode(F.sequence(F.ceil(least).cast("int"), F.floor(most).cast("int"))).alias("size"))
    sizes = F.length("first") + F.col("size")
    ends = lambda c: F.array(F.concat(F.lit("<"), F.substring(c, 1, 1)), F.concat(F.lit(">"), F.expr(f"right({c}, 1)")))
    left = tokens.select("token", F.length("token").alias("size"), F.explode(F.concat(ends("token"), F.when(F.length("token") >= 9, grams("token")).otherwise(F.array().cast("array<string>")))).alias("key"))
    right = sized.select("first", "size", F.explode(F.concat(ends("first"), F.when(sizes >= 20, grams("first")).otherwise(F.array().cast("array<string>")))).alias("key"))
    pairs = left.join(right, ["size", "key"]).select("token", "first").distinct()
    return pairs.where(fuzzy_ratio("token", "first") >= NEAR)


def candidates(found: DataFrame, roster: DataFrame) -> DataFrame:
    """(file_id, patient_id, score): pairs among which each file's best is, with its score. roster: (patient_id, first, last, dob), folded.

    Of the patients who share what a score is for (birth date; birth date and last name;
    full name; last name and first name; last name) only the least id is paired. A birth
    date outweighs every name without one, so names alone count for the other files.
    A birth date with a name reaches the cap, whatever else agrees.
    """
    people = roster.where(F.col("patient_id").isNotNull())
    least = lambda *keys: people.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.min("patient_id").alias("patient_id"))
    scored = lambda df, points: df.select("file_id", "patient_id", F.lit(round(min(points, CAP), 6)).alias("score"))
    names = found.select("file_id", F.explode("names").alias("name"))
    vocabulary = cut_lineage(names.select("name").distinct())
    inside = cut_lineage(surnames_in(vocabulary, people.select("last").where("length(last) > 0").distinct()))
    dated = cut_lineage(found.select("file_id", F.explode("dobs").alias("dob")).join(least("dob"), "dob"))
    lasts = cut_lineage(names.join(inside, "name").select("file_id", "last").distinct())
    undated = dated.select("file_id").distinct()
    by_both = dated.select("file_id", "dob").join(lasts, "file_id").join(least("dob", "last"), ["dob", "last"])
    # A full name without a last name is no case of one inside a name.
    bare = people.where(F.coalesce(F.length("last"), F.lit(0)) == 0).select(F.concat_ws(" ", "first", "last").alias("name"), "patient_id", "dob").groupBy("name", "dob").agg(F.min("patient_id").alias("patient_id"))
    by_bare = names.join(bare, "name").join(found.select("file_id", "dobs"), "file_id")
    by_bare = by_bare.select("file_id", "patient_id", F.when(F.array_contains("dobs", F.col("dob")), min(DOB + FULL, CAP)).otherwise(FULL).alias("score"))
    left_names, left_lasts = names.join(undated, "file_id", "left_anti"), lasts.join(undated, "file_id", "left_anti")
    full = people.where(F.length("last") > 0).groupBy(F.concat_ws(" ", "first", "last").alias("name")).agg(F.min("patient_id").alias("patient_id"))
    words = lambda df: df.select(*(c for c in df.columns if c != "name"), F.explode(F.split("name", " ")).alias("token")).distinct()
    near = near_words(words(vocabulary), people.select("first").distinct())
    by_near = words(left_names.join(left_lasts, "file_id", "left_semi")).join(near, "token").select("file_id", "first").distinct().join(left_lasts, "file_id").join(least("last", "first"), ["last", "first"])
    parts = [scored(dated, DOB), scored(by_both, DOB + LAST), by_bare, scored(left_names.join(full, "name"), FULL), scored(by_near, LAST + FIRST), scored(left_lasts.join(least("last"), "last"), LAST)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def short_runs(name: str) -> Column:
    """All runs of one and two characters."""
    run = lambda n: F.expr(f"transform(sequence(1, greatest(length({name}) - {n - 1}, 1)), i -> substring({name}, i, {n}))")
    return F.concat(run(1), run(2))


def best_matches(files: DataFrame, roster: DataFrame, id_col: str, text_col: str, before: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, patient_id, score): the best patient of each file, ties to the smaller id; files without a match have score 0."""
    found = cut_lineage(signals(files, id_col, text_col, before=before))  # names are folded once
    best = candidates(found, cut_lineage(roster)).groupBy("file_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "patient_id")).alias("b"))
    best = best.select("file_id", F.col("b.patient_id").alias("patient_id"), (-F.col("b.s")).alias("score"))
    return found.select("file_id").join(best, "file_id", "left").select("file_id", "patient_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def score_bucket(score: str = "score"):
    chain = F
    for low, label in BUCKETS:
        chain = chain.when(F.col(score) >= low, label)
    return chain
