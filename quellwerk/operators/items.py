"""Question-answer items: sampling of chunks, neighbours, rule validation, gold bridge, training pairs."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.functions.text import DIGITS, NEGATION, phenomena_tags, trivial_question, word_count

ANSWER_TYPES = ["span", "boolean", "numeric", "classification", "list"]
SPAN_CHARS = (3, 320)
QUESTION_WORDS = 8


def with_neighbours(chunks: DataFrame, order: str = "chunk_index") -> DataFrame:
    """prev_id, prev_text, next_id, next_text of the chunk before and after in the same report and section name.

    A gap in the order, or another chunk of the same order, leaves no neighbour there.
    """
    place = Window.partitionBy("report_id", F.upper("section_name")).orderBy(order, "section_id")
    out = chunks
    for side, shift, step in (("prev", F.lag, -1), ("next", F.lead, 1)):
        beside = shift(order).over(place) == F.col(order) + step
        out = out.withColumn(f"{side}_id", F.when(beside, shift("section_id").over(place))).withColumn(f"{side}_text", F.when(beside, shift("section_content").over(place)))
    return out


def stratified_sample(chunks: DataFrame, stratum: str, per_stratum: int, seed: int, id_col: str = "section_id") -> DataFrame:
    """At most per_stratum rows of each stratum by seeded hash: a sampling operator, the limit is its purpose."""
    order = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    ranked = chunks.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(order, id_col)))
    return ranked.where(F.col("_rank") <= per_stratum).drop("_rank")


def generation_sample(chunks: DataFrame, asked: DataFrame, stratum: str, limit: int, seed: int, id_col: str = "section_id") -> DataFrame:
    """At most `limit` chunks without an item, from each stratum an equal quota, by seeded hash: a sampling operator."""
    strata = chunks.agg(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.count_distinct(stratum)))).alias("_quota"))  # one row
    free = chunks.join(asked.select(id_col), id_col, "left_anti")
    order = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    ranked = free.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(order, id_col))).where(F.col("_rank") <= limit)
    drawn = ranked.join(F.broadcast(strata), F.col("_rank") <= F.col("_quota")).drop("_rank", "_quota")
    return drawn.orderBy(order, id_col).limit(limit)


def span_matches(text: Column, answer: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start) == answer


def validate(items: DataFrame) -> DataFrame:
    """items (question, answer_type, answer_text, start_char, end_char, phenomena, section_name, section_content) with errors, status, tags.

    Null texts count as empty, null offsets as malformed.
    """
    question, answer = F.trim(F.coalesce("question", F.lit(""))), F.coalesce("answer_text", F.lit(""))
    text, kind = F.coalesce("section_content", F.lit("")), F.trim(F.coalesce("answer_type", F.lit("")))
    start, end = F.col("start_char"), F.col("end_char")
    malformed = start.isNull() | end.isNull()
    outside = ~malformed & ((start < 0) | (end <= start) | (end > F.length(text)))
    differs = ~malformed & ~outside & ~span_matches(text, answer, F.when(outside, 0).otherwise(start), F.when(outside, 0).otherwise(end))
    tags = F.transform(F.coalesce("phenomena", F.array().cast("array<string>")), lambda t: F.lower(t))
    # The validator's codes.
    rules = [
        (question == "", "empty_question"),
        (~kind.isin(ANSWER_TYPES), "invalid_answer_type"),
        (trivial_question(question, F.col("section_name"), QUESTION_WORDS), "trivial_question"),
        (malformed, "invalid_offset_format"),
        (outside, "offset_out_of_bounds"),
        (differs, "substring_mismatch"),
        (F.length(answer) < SPAN_CHARS[0], "answer_too_short"),
        (F.length(answer) > SPAN_CHARS[1], "answer_too_long"),
        ((kind == "numeric") & ~answer.rlike(DIGITS), "numeric_type_no_numbers"),
        (F.array_contains(tags, "negation") & ~(answer.rlike(NEGATION) | text.rlike(NEGATION)), "negation_tag_without_negation"),
        (word_count(question) < QUESTION_WORDS, "question_too_short"),
    ]
    errors = F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), code) for rule, code in rules)), lambda e: e.isNotNull())
    enriched = F.array_sort(F.array_union(tags, phenomena_tags(answer, text)))
    checked = items.withColumn("errors", errors).withColumn("enriched", enriched).withColumn("offsets_valid", ~(malformed | outside | differs))
    return checked.withColumn("status", F.when(F.size("errors") > 0, "invalid").otherwise("valid"))


def gold_bridge(items: DataFrame) -> DataFrame:
    """(qa_id, section_id) of valid items: the own chunk, and neighbours that hold the answer too."""
    holds = lambda side: F.when(F.col(f"{side}_text").contains(F.col("answer_text")), F.col(f"{side}_id"))
    own = F.array_compact(F.array(F.col("section_id"), holds("prev"), holds("next")))
    return items.where("status = 'valid'").select("qa_id", F.explode(own).alias("section_id")).distinct()


def hard_negatives(ranking: DataFrame, gold: DataFrame, pool: int = 50, draw: int = 4, seed: int = 42) -> DataFrame:
    """(query_id, id): `draw` items of each query's best `pool` that are not its gold, by seeded hash; never one twice."""
    wrong = ranking.where(F.col("rank") <= pool).join(gold.select("query_id", F.col("gold_id").alias("id")), ["query_id", "id"], "left_anti")
    order = F.md5(F.concat_ws("|", F.col("query_id").cast("string"), F.col("id").cast("string"), F.lit(str(seed))))
    return wrong.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).where(F.col("_rank") <= draw).drop("_rank")


def training_pairs(queries: DataFrame, gold: DataFrame, negatives: DataFrame, texts: DataFrame) -> DataFrame:
    """(q, d, label): gold pairs and negatives of queries that have both."""
    both = gold.join(negatives.select("query_id").distinct(), "query_id", "left_semi")
    labelled = both.select("query_id", F.col("gold_id").alias("id"), F.lit(1.0).cast("float").alias("label"))
    labelled = labelled.unionByName(negatives.join(both.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "id", F.lit(0.0).cast("float").alias("label")))
    return labelled.join(queries, "query_id").join(texts, "id").select("query_id", "id", "q", "d", "label")


def held_out(keys: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """key with is_dev: a seeded hash order, the first max(1, share) of the distinct keys held out.

    The cut is a count of keys, so one global rank is needed; it is over distinct keys only.
    """
    distinct = keys.where(F.col(key).isNotNull()).select(key).distinct()
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    bucket = F.substring(order, 1, 3)
    hashed = distinct.select(key, order.alias("_h"), bucket.alias("_b"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 4 096 rows
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    ranked = hashed.join(F.broadcast(sums), "_b").withColumn("_r", F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    return ranked.select(key, (F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_all") * share))).alias("is_dev"))


def rerank(candidates: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], keep: int = 20) -> DataFrame:
    """candidates (query_id, id, q, d) scored by a supplied model in Arrow batches, best first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(model_score=score(batch["q"], batch["d"]).astype(float))[["query_id", "id", "model_score"]]

    kinds = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in ("query_id", "id"))
    scored = candidates.select("query_id", "id", "q", "d").mapInPandas(run, f"{kinds}, model_score double")
    order = Window.partitionBy("query_id").orderBy(F.col("model_score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def generate(chunks: DataFrame, generator: Callable[[str], str], id_col: str = "section_id", text_col: str = "section_content", attempts: int = 3, delay: float = 1.0, jitter: float = 0.25, most: int | None = None) -> DataFrame:
    """(section_id, raw): a supplied text model asked once per chunk; a chunk that keeps failing gives null.

    A failed attempt is repeated after `delay` seconds, a random part of it (`jitter`) more or
    less. With `most`, a JSON array in an answer keeps its first `most` items.
    """

    def cut(answer: str) -> str:
        try:
            parsed = json.loads(answer)
        except ValueError:
            return answer
        return json.dumps(parsed[:most], ensure_ascii=False) if isinstance(parsed, list) and len(parsed) > most else answer

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch[text_col]:
                answer = None
                for attempt in range(attempts):
                    try:
                        answer = generator(text)
                        answer = cut(answer) if most is not None and answer is not None else answer
                        break
                    except Exception:  # noqa: BLE001  any failure of a supplied model is a failed attempt
                        if attempt + 1 < attempts:
                            time.sleep(max(0.0, delay * (1 + random.uniform(-jitter, jitter))))
                out.append(answer)
            yield pd.DataFrame({"section_id": batch[id_col], "raw": out})

    return chunks.select(id_col, text_col).mapInPandas(run, "section_id string, raw string")
