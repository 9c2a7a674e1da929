"""Keyed rows: upsert, insert-if-new, insert-ignore, unique names, duplicate status, cleanup."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.operators.ranks import ranged_rank, salted_rank
from quellwerk.session import cut_lineage, estimated_bytes

#: Suffixes that one task lists.
CHUNK = 10_000


#: Frames estimated above this size are not shuffled to resolve a few repeated keys; repeated keys are broadcast up to this number.
WIDE_BYTES, BROADCAST_KEYS = 1 << 30, 1_000_000


def latest(df: DataFrame, keys: list[str], order: list[Column], wide_bytes: int = WIDE_BYTES) -> DataFrame:
    """One row per key, the first in the given order; rows with a null key are dropped.

    Of a large frame only the rows of repeated keys are ranked, found by the keys alone;
    all others stay where they are read. Where too many keys repeat to be broadcast, or
    the frame is small, all rows are ranked.
    """
    for key in keys:
        df = df.where(F.col(key).isNotNull())

    def first(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.where("_rank = 1").drop("_rank")

    if estimated_bytes(df) < wide_bytes:
        return first(df)
    repeated = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys))
    if repeated.count() > BROADCAST_KEYS:
        return first(df)
    return df.join(F.broadcast(repeated), keys, "left_anti").unionByName(first(df.join(F.broadcast(repeated), keys, "left_semi")))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming replace rows of existing with the same key; the rest of existing stays."""
    return existing.join(incoming, keys, "left_anti").unionByName(incoming)


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """existing and the first row of each new key of incoming."""
    return existing.unionByName(latest(incoming, keys, order).join(existing, keys, "left_anti"))


def duplicate_status(df: DataFrame, content: str, owner: str, order: list[Column]) -> DataFrame:
    """df with sha256 computed anew and status: inserted, duplicate (same owner holds it), conflict (another owner does).

    The first row of a content in the given order, which must tell rows apart, is
    inserted, over all owners; null content has a null hash and is `skipped`. Only
    first rows are aggregated, combined before the shuffle, so a content that many
    rows share is no task of its own.
    """
    hashed = df.withColumn("sha256", F.sha2(F.col(content), 256)).withColumn("_at", F.struct(*order))
    firsts = hashed.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.min(F.struct("_at", F.col(owner).alias("_owner"))).alias("_first"))
    status = (
        F.when(F.col("sha256").isNull(), "skipped")
        .when(F.col("_at").eqNullSafe(F.col("_first._at")), "inserted")
        .when(F.col(owner).eqNullSafe(F.col("_first._owner")), "duplicate")
        .otherwise("conflict")
    )
    return hashed.join(firsts, "sha256", "left").withColumn("status", status).drop("_at", "_first")


def unique_names(df: DataFrame, name: str, order: list[Column], mark: str = "_", into: str = "unique_name") -> DataFrame:
    """df with a name that no other row has: the first row of a name keeps it, each further one takes the least free suffix 1, 2, ...

    A suffixed form that is a name of the table itself is passed over; no two names have
    a form in common, as its last mark tells name and suffix apart. Null names stay null.
    A name that many rows share is ranked and suffixed by many tasks.
    """
    named = df.where(F.col(name).isNotNull())
    ranked = ranged_rank(named, name, order, "_nth")
    counts = ranked.groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("_n"))
    natural = counts.select(F.col("_name").alias("_form"), F.lit(True).alias("_taken"))
    shape = F.regexp_extract("_form", "(?s)^(.*)" + re.escape(mark) + r"[1-9]\d*$", 1)
    blocked = natural.select(shape.alias("_name")).groupBy("_name").agg(F.count("*").alias("_blocked"))
    # A name needs as many suffixes as it has further rows and forms that are names: listed in chunks.
    needed = counts.where("_n > 1").join(blocked, "_name", "left").select("_name", (F.col("_n") - 1 + F.coalesce("_blocked", F.lit(0))).alias("_m"))
    chunks = needed.select("_name", "_m", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / CHUNK))).alias("_c"))
    spread_out = chunks.where("_m > 0").repartition("_name", "_c").select("_name", F.explode(F.sequence(F.col("_c") * CHUNK + 1, F.least("_m", (F.col("_c") + 1) * CHUNK))).alias("_i"))
    forms = spread_out.withColumn("_form", F.concat("_name", F.lit(mark), F.col("_i").cast("string"))).join(natural, "_form", "left_anti")
    free = salted_rank(forms, "_name", "_i").select(F.col("_name").alias(name), "_form", (F.col("rank") + 1).alias("_nth"))
    joined = ranked.join(free, [name, "_nth"], "left").withColumn(into, F.coalesce("_form", name)).drop("_nth", "_form")
    return joined.select(*df.columns, into).unionByName(df.where(F.col(name).isNull()).withColumn(into, F.lit(None).cast("string")).select(*df.columns, into))


def pending(everything: DataFrame, accepted: DataFrame, extras: DataFrame, key: str) -> DataFrame:
    """Rows of everything whose key is neither accepted nor set aside."""
    return everything.join(accepted.select(key), key, "left_anti").join(extras.select(key), key, "left_anti")


def review_filter(df: DataFrame, score: str, least: float, pattern: str, columns: list[str], name: str, part: str) -> DataFrame:
    """Rows of at least a score whose lower-cased columns match a pattern, and whose name holds a part; a null matches nothing."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).rlike(pattern.lower()), F.lit(False))
    return df.where((F.col(score) >= least) & hit & F.lower(name).contains(part.lower()))


def exists(df: DataFrame, condition: Column) -> bool:
    """Whether any row fulfils a condition; one row is looked for, none are counted."""
    return not df.where(condition).isEmpty()


def nameless(first: str = "firstname", last: str = "lastname") -> Column:
    """Both names null, empty or one blank."""
    blank = lambda c: F.col(c).isNull() | F.col(c).isin("", " ")
    return blank(first) & blank(last)


def cascade_delete(doomed: DataFrame, key: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table without the rows of doomed keys."""
    keys = doomed.select(key).distinct()
    return {name: table.join(keys, key, "left_anti") for name, table in tables.items()}
