"""String functions as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM_ALPHABET = "[^0-9a-zA-ZäöüÄÖÜß]+"
DIGITS = r"\d"
# Markers of the phenomena tags and phrases of trivial questions.
NEGATION = r"(?i)\b(kein|keine|keiner|ohne|fehlt|fehlend|Ausschluss|negativ|nicht|unauffällig)\b"
COMPARISON = r"(?i)\b(verglichen (mit|zu)|seit|gegenüber|im Vergleich|Verlauf|Veränderung)\b"
TRIVIAL = [
    "was ist der eindruck",
    "was ist die beurteilung",
    "was sind die befunde",
    "was ist die indikation",
    "was ist die technik",
    "was ist die empfehlung",
    "wie lautet der befund",
    "wie lautet die diagnose",
]
TRIVIAL_WITH_SECTION = ["was ist ", "was steht in "]


def squeeze(c: Column | str) -> Column:
    """Every run of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column | str) -> Column:
    """Maximal runs without Unicode white space; null for null."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """Number of words; 0 for null, as for blank."""
    return F.coalesce(F.size(words(c)), F.lit(0))


def char_grams(c: Column | str, n: int = 3) -> Column:
    """All runs of n characters of the normalised text; a shorter text is one gram, an empty or null one none.

    The text is split into characters once and bound by a one-element array, so the
    runs are cut in time linear in the text.
    """
    text = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), GRAM_ALPHABET, " ")), " ", "_")
    bound = F.array(F.struct(text.alias("t"), F.split(text, "").alias("c")))
    cut = lambda b: F.when(
        F.length(b["t"]) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.length(b["t"]) - n, F.lit(0))), lambda i: F.concat(*(b["c"][i + k] for k in range(n))))
    ).otherwise(F.when(b["t"] != "", F.array(b["t"])).otherwise(F.array().cast("array<string>")))
    return F.transform(bound, cut)[0]


def clean_csv(c: Column | str, limit: int = 1000) -> Column:
    """One line of at most `limit` characters; null becomes empty."""
    line = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 3), F.lit("..."))).otherwise(line)


def preview(c: Column | str, size: int = 200) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def redact_patterns(c: Column | str, patterns: list[str], mark: str = "___", literal: bool = True) -> Column:
    """Replace caller-supplied patterns in order; taken literally unless told otherwise."""
    import re

    c = F.col(c) if isinstance(c, str) else c
    for pattern in patterns:
        c = F.regexp_replace(c, re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", pattern) if literal else pattern, mark)
    return c


def phenomena_tags(answer: Column, chunk: Column) -> Column:
    """Sorted tags: numeric from the answer, negation from either, comparison from the chunk."""
    answer, chunk = F.coalesce(answer, F.lit("")), F.coalesce(chunk, F.lit(""))
    tags = F.array(
        F.when(answer.rlike(DIGITS), "numeric"),
        F.when(answer.rlike(NEGATION) | chunk.rlike(NEGATION), "negation"),
        F.when(chunk.rlike(COMPARISON), "comparison"),
    )
    return F.array_sort(F.filter(tags, lambda t: t.isNotNull()))


def trivial_question(question: Column, section: Column | None = None, least: int = 8) -> Column:
    """Empty, shorter than `least` words, or one of the trivial phrases (also with the section's name)."""
    text = F.lower(F.coalesce(question, F.lit("")))
    phrases = F.exists(F.array(*map(F.lit, TRIVIAL)), text.contains)
    if section is not None:
        named = F.lower(F.coalesce(section, F.lit("")))
        for lead in TRIVIAL_WITH_SECTION:
            phrases = phrases | text.contains(F.concat(F.lit(lead), named))
    return (word_count(question) < least) | phrases


def fenced_json(c: Column | str) -> Column:
    """The outermost JSON array of a model's answer, without code fences; the text itself if there is none."""
    bare = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"```[a-zA-Z]*", ""))
    found = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    return F.when(found != "", found).otherwise(bare)


def json_items(c: Column | str, fields: str) -> Column:
    """The objects of a JSON array, or a single object as a list of one; other values are left out, text that is no JSON gives an empty list."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    whole = F.when(c.startswith("{"), F.concat(F.lit("["), c, F.lit("]"))).otherwise(c)
    parts = F.filter(F.from_json(whole, "array<string>"), lambda x: x.startswith("{"))
    return F.coalesce(F.transform(parts, lambda x: F.from_json(x, fields)), F.array().cast(f"array<struct<{fields.replace(' ', ': ', 1)}>>"))


def highlight(content: Column, snippet: Column, open_mark: str = "<mark>", close_mark: str = "</mark>") -> Column:
    """Mark an exact snippet of over 20 characters, else its first ten words if it has five."""
    first = F.array_join(F.slice(words(snippet), 1, 10), " ")
    marked = lambda part: F.replace(content, part, F.concat(F.lit(open_mark), part, F.lit(close_mark)))
    return (
        F.when((F.length(snippet) > 20) & content.contains(snippet), marked(snippet))
        .when((F.length(snippet) > 20) & (word_count(snippet) >= 5) & content.contains(first), marked(first))
        .otherwise(content)
    )


def fts_terms(text: str) -> list[str]:
    """Query text to search terms: no quote or bracket characters; words over two characters, else the text itself."""
    bare = text
    for c in "'\"*(){}[]":
        bare = bare.replace(c, " ")
    found = bare.split()
    kept = [w for w in found if len(w) > 2]
    return kept or ([" ".join(found)] if found else [])


def fts_query(text: str) -> str:
    """The terms as an any-of query string."""
    kept = fts_terms(text)
    return " OR ".join(f'"{w}"' for w in kept) if all(len(w) > 2 and " " not in w for w in kept) else " ".join(kept)
