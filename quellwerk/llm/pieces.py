"""Cutting of oversized texts into ordered, overlapping pieces at natural boundaries.

A word is a maximal run of characters that are not Unicode white space. Every gap
between words is a boundary of some kind; dynamic programming over the boundaries
chooses the cuts that minimise the sum of cut penalties, start penalties and
squared size imbalance, no piece being longer than the limit. Each piece after the
first starts `overlap` words before the previous cut, or at a natural boundary
within that stretch where that is cheaper.

Defined cases: null, blank and short texts need no cut and give no rows in
`split_oversized`; a text of exactly the limit is not cut; texts without natural
boundaries are cut between words; repeated rows give the same pieces once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.session import read_table, spread

MAX_WORDS = 350
OVERLAP = 50
# Penalties of a cut (or a start) by kind of boundary.
HEADING, PARAGRAPH, LIST_ENTRY, LINE, SENTENCE, WORD = 0, 1, 2, 3, 4, 5
PENALTY = np.array([0.0, 0.1, 0.2, 0.5, 0.4, 4.0])
SIZE_WEIGHT = 3.0
SHORT_OVERLAP_WEIGHT = 0.6

# Unicode white space; Python's \s also takes the separators U+001C to U+001F.
GAP = re.compile(r"[^\S\x1c-\x1f]+")
WORDS = re.compile(r"(?:\S|[\x1c-\x1f])+")
BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
HEADING_LINE = re.compile(r"#{1,6}\s*\S|[^\s.!?;,:][^.!?;,:\n\r]{0,60}:\s*(?:$|[\n\r])")
LIST_LINE = re.compile(r"(?:[-*•–+]|\d{1,3}[.)]|[a-z]\))\s|\|")
SENTENCE_END = re.compile(r"(?:[.!?…][\"'”“»«’)\]]*|[。！？][」』”）]*)$")
ABBREVIATION = re.compile(r"^\(?(?:\w\.)+$|^\(?(?:ca|bzw|vgl|Nr|Dr|Prof|St|max|bds|inkl|lt|einschl|med|Abb|Ref|tgl|Bed|Auftragsnr|etwa|evtl|ggf|gem|bez|Abs|geb)\.$|^\d{1,2}\.$")


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORDS.finditer(text)]


def boundary_kinds(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Kind of the boundary before each word; that before the first is a heading."""
    kinds = np.full(len(spans), WORD, np.int8)
    kinds[0] = HEADING
    end = spans[0][1]
    for i in range(1, len(spans)):
        start, stop = spans[i]
        if start - end > 1 or text[end] != " ":
            breaks = len(BREAK.findall(text, end, start))
            if breaks:
                kinds[i] = PARAGRAPH if breaks > 1 else LINE
                if HEADING_LINE.match(text, start):
                    kinds[i] = HEADING
                elif breaks == 1 and LIST_LINE.match(text, start):
                    kinds[i] = LIST_ENTRY
        if kinds[i] == WORD and text[end - 1] in ".!?…\"'”“»«’)]。！？」』）":
            a = spans[i - 1][0]
            word = text[a:end]
            if SENTENCE_END.search(word) and not ABBREVIATION.match(word) and not text[start].islower():
                kinds[i] = SENTENCE
        end = stop
    return kinds


def best_starts(kinds: np.ndarray, cuts: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a cut before word c: the first word of the next piece and what that start costs."""
    starts, costs = np.zeros(len(cuts), int), np.zeros(len(cuts))
    for k, cut in enumerate(cuts.tolist()):
        low = max(1, cut - overlap)
        at = np.arange(low, cut) if cut > low else np.array([cut])
        cost = PENALTY[kinds[at]] * 0.5 + SHORT_OVERLAP_WEIGHT * (at - (cut - overlap)) / max(overlap, 1)
        best = int(cost.argmin())
        starts[k], costs[k] = at[best], cost[best]
    return starts, costs


def choose_pieces(kinds: np.ndarray, limit: int = MAX_WORDS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Half-open word ranges of the pieces, in order."""
    n = len(kinds)
    if n <= limit:
        return [(0, n)]
    overlap = min(overlap, limit - 1)
    natural = np.flatnonzero(kinds != WORD)
    natural = natural[natural > 0]
    # Between natural boundaries too far apart for a piece, every word is a candidate.
    edge = np.concatenate([[0], natural, [n]])
    wide = np.flatnonzero(np.diff(edge) > max(1, (limit - overlap) // 2))
    extra = [np.arange(edge[w] + 1, edge[w + 1]) for w in wide]
    cuts = np.unique(np.concatenate([natural, *extra, [n]]).astype(int))
    starts, start_cost = best_starts(kinds, cuts[:-1], overlap)
    starts, start_cost = np.append(0, starts), np.append(0.0, start_cost)  # state 0: nothing cut yet
    position = np.append(0, cuts[:-1])
    count = max(2, -(-(n - overlap) // max(1, limit - overlap)))
    target = (n + (count - 1) * overlap) / count
    cost = np.full(len(cuts) + 1, np.inf)
    cost[0], came = 0.0, np.full(len(cuts) + 1, -1)
    low = 0
    for e, cut in enumerate(cuts.tolist(), 1):
        while starts[low] < cut - limit and low < e - 1:
            low += 1
        begin = starts[low:e]
        size = cut - begin
        trial = cost[low:e] + start_cost[low:e] + SIZE_WEIGHT * ((size - target) / target) ** 2
        trial[(size > limit) | (position[low:e] >= cut)] = np.inf
        best = int(trial.argmin())
        cost[e] = trial[best] + (PENALTY[kinds[cut]] if cut < n else 0.0)
        came[e] = low + best
    pieces, e = [], len(cuts)
    while e > 0:
        previous = int(came[e])
        pieces.append((int(starts[previous]), int(cuts[e - 1])))
        e = previous
    return pieces[::-1]


def cut_text(text: str, limit: int = MAX_WORDS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, words) of each piece of a text, in characters; [] for a text within the limit."""
    if len(text) < 2 * limit + 1:
        return []
    spans = word_spans(text)
    if len(spans) <= limit:
        return []
    ranges = choose_pieces(boundary_kinds(text, spans), limit, overlap)
    return [(spans[a][0], spans[b - 1][1], b - a) for a, b in ranges]


def split_oversized(df: DataFrame, keys: list[str], text_col: str, limit: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(keys..., piece_index, pieces INT, start_char, end_char, word_count INT, piece STRING) of texts over the limit.

    Texts too short to hold more than `limit` words never leave the JVM.
    """
    source = df.select(*keys, F.col(text_col).alias("text")).where(F.length("text") >= 2 * limit + 1)
    fields = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: list[list] = [[] for _ in range(6)]
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                pieces = cut_text(text, limit, overlap)
                for k, (a, b, words) in enumerate(pieces):
                    rows.append(i)
                    for column, value in zip(out, (k, len(pieces), a, b, words, text[a:b])):
                        column.append(value)
            picked = [batch.column(k).take(pa.array(rows, pa.int32())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*picked, *(pa.array(c, pa.int32()) for c in out[:5]), pa.array(out[5], pa.string())], names)

    names = [*keys, "piece_index", "pieces", "start_char", "end_char", "word_count", "piece"]
    schema = f"{fields}, piece_index int, pieces int, start_char int, end_char int, word_count int, piece string"
    return source.mapInArrow(run, schema)


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, record_key, text) of reports and report_sections."""
    reports = read_table(spark, sf_dir, "reports").select(F.lit("reports").alias("source_table"), F.col("report_id").alias("record_key"), F.col("content").alias("text"))
    sections = read_table(spark, sf_dir, "report_sections").select(F.lit("report_sections").alias("source_table"), F.col("section_id").alias("record_key"), F.col("section_content").alias("text"))
    return spread(reports).unionAll(spread(sections))


def cut_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(report_texts(spark, sf_dir), ["source_table", "record_key"], "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_reports(spark, sf_dir).where((F.col("piece_index") == 0) & (F.col("pieces") > 1))
    return cut.select("source_table", "record_key").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized record, redelivered rows once."""
    return cut_reports(spark, sf_dir).dropDuplicates(["source_table", "record_key", "piece_index"])
