"""Near-duplicate texts: circulant MinHash, banding, exact Jaccard verification.

A text is the set of its shingles (runs of consecutive lower-cased words). Two
permutations make the whole signature: the first scatters shingles over the slots,
the second, shifted circularly by k, gives coordinate k as the least value among
the text's slots. Texts with equal sets form a class and are compared once. Bands
of the signature bring classes together; members of bands with many classes go
through an exact prefix filter instead of pairing; every candidate is verified on
the shingle sets. Sets are not carried along: only those of classes with a candidate
are cut from their texts again, so that what is written and shuffled follows the
candidates. Keys that many rows share (a class of copies, a frequent shingle) are
split by salts wherever rows meet.

Defined cases: null and blank texts and texts with fewer words than a shingle form
no class; equal texts form one class whatever their number; rows with the same id
count once; long texts take part whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.llm.splits import propagate_labels
from quellwerk.session import cut_lineage, read_table, spread

BANDS, BAND_ROWS = 48, 5
SLOTS = 1 << 20
SEED = 20_260_101
#: Classes in a band beyond which its members take the prefix filter.
WIDE_BAND = 64
#: Rows of one key that a single task joins with the other rows of the key.
PER_SALT = 1000
#: A set of ids is broadcast up to this number; a larger one is joined by shuffle.
BROADCAST_IDS = 500_000

_WORDS = re.compile(r"(?:\S|[\x1c-\x1f])+")
_state: dict = {}


def circulant_rows(coordinates: int) -> np.ndarray:
    """Row s holds the second permutation's values seen from slot s under shifts 0, 1, ..."""
    if coordinates not in _state:
        values = np.random.default_rng(SEED).permutation(SLOTS).astype(np.int32)
        _state[coordinates] = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:coordinates]]), coordinates)
    return _state[coordinates]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text."""
    words = _WORDS.findall(text.lower())
    if len(words) < width:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = mix(total + codes[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(total)


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    slots = (mix(shingles ^ np.uint64(SEED)) & np.uint64(SLOTS - 1)).astype(np.int64)
    table = circulant_rows(bands * rows)
    signature = np.full(bands * rows, SLOTS, np.int32)
    for part in range(0, len(slots), 4096):  # bounds the memory of very long texts
        signature = np.minimum(signature, table[slots[part : part + 4096]].min(0))
    keys = np.arange(bands, dtype=np.uint64)
    for column in signature.reshape(bands, rows).T.astype(np.uint64):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def sketch(df: DataFrame, id_col: str, text_col: str, width: int, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(id, class BINARY, n INT, bands ARRAY<BIGINT>) of texts with a shingle."""
    source = texts_of(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _state.setdefault("hashes", WordHashes())
        for batch in batches:
            kept, classes, sizes, keys = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                shingles = shingle_set(text, width, hashes)
                if len(shingles):
                    kept.append(i)
                    classes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    sizes.append(len(shingles))
                    keys.append(band_keys(shingles, bands, rows))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            banded = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(kept) + 1, bands, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int32())), pa.array(classes, pa.binary()), pa.array(sizes, pa.int32()), banded], ["id", "class", "n", "bands"])

    return spread(source).mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, class binary, n int, bands array<bigint>")


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") > 2))


def shingle_sets(df: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(class, n, shingles ARRAY<BIGINT>), a row per class of `wanted` (class, id): the sets of the texts with these ids, cut again.

    The ids are broadcast up to BROADCAST_IDS; above, texts are shuffled once to meet them.
    """
    ids = wanted.select("id")
    source = texts_of(df, id_col, text_col).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _state.setdefault("hashes", WordHashes())
        for batch in batches:
            sets = [s for s in (shingle_set(text, width, hashes) for text in batch.column(1).to_pylist()) if len(s)]
            sizes = [len(s) for s in sets]
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(sizes, pa.int32()), lists], ["class", "n", "shingles"])

    return source.mapInArrow(run, "class binary, n int, shingles array<bigint>").join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def salted_pairs(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, column_a, column_b, ...): rows of df with others of the same key, a key of many rows in several tasks."""
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / F.lit(PER_SALT)).cast("int").alias("_salts"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = df.select(key, *columns).join(sizes, key)
    left = rows.select(key, *(F.col(c).alias(f"{c}_a") for c in columns), F.pmod(F.xxhash64(*columns), F.col("_salts").cast("bigint")).cast("int").alias("_salt"))
    right = rows.select(key, *(F.col(c).alias(f"{c}_b") for c in columns), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    return left.join(right, [key, "_salt"]).drop("_salt")


def size_allows(a: str, b: str, threshold: float):
    return F.least(a, b) >= F.greatest(a, b) * F.lit(threshold)


def band_candidates(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float, wide_band: int = WIDE_BAND) -> DataFrame:
    """(a, b) with a < b: pairs of classes that share a band, or pass the prefix filter where bands are wide."""
    spread_out = classes.select("class", "n", F.explode("bands").alias("band"))
    sizes = cut_lineage(spread_out.groupBy("band").agg(F.count("*").alias("classes")).where(F.col("classes") > 1))
    shared = cut_lineage(spread_out.join(sizes, "band"))
    narrow = shared.where(F.col("classes") <= wide_band)
    left = narrow.select("band", F.col("class").alias("a"), F.col("n").alias("n_a"))
    right = narrow.select("band", F.col("class").alias("b"), F.col("n").alias("n_b"))
    pairs = left.join(right, "band").where((F.col("a") < F.col("b")) & size_allows("n_a", "n_b", threshold)).select("a", "b")
    wide = shared.where(F.col("classes") > wide_band).select("class").distinct()
    if not wide.isEmpty():
        pairs = pairs.unionAll(prefix_candidates(sets_of(wide), threshold))
    return pairs.distinct()


def prefix_candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs that share one of their rarest shingles: no pair at the threshold can avoid that. classes: (class, n, shingles)."""
    terms = cut_lineage(classes.select("class", "n", F.explode("shingles").alias("term")))
    counts = terms.groupBy("term").agg(F.count("*").alias("df"))
    ranked = terms.join(counts, "term").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("terms"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    prefix = ranked.select("class", "n", F.explode(F.slice("terms", F.lit(1), length)).alias("t")).where(F.col("t.df") > 1)
    both = salted_pairs(cut_lineage(prefix.select("class", "n", F.col("t.term").alias("term"))), "term", "class", "n")
    return both.where((F.col("class_a") < F.col("class_b")) & size_allows("n_a", "n_b", threshold)).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))


def similar_classes(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float, wide_band: int = WIDE_BAND) -> DataFrame:
    """(a, b): verified pairs of classes, of a sketch; sets_of gives the sets of a frame of classes."""
    classes = rows.select("class", "n", "bands").dropDuplicates(["class"])
    pairs = cut_lineage(band_candidates(classes, sets_of, threshold, wide_band))
    sets = cut_lineage(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()))
    joined = pairs.join(sets.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a")), "a")
    joined = joined.join(sets.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b")), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return joined.where(common >= (F.col("n_a") + F.col("n_b") - common) * F.lit(threshold) - F.lit(1e-9)).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8, wide_band: int = WIDE_BAND) -> tuple[DataFrame, DataFrame]:
    """Members (class, id) and verified links (a, b) between different classes."""
    rows = cut_lineage(sketch(df, id_col, text_col, width))

    def sets_of(classes: DataFrame) -> DataFrame:
        wanted = cut_lineage(rows.join(classes, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id")))
        return shingle_sets(df, id_col, text_col, width, wanted)

    return cut_lineage(rows.select("class", "id").distinct()), cut_lineage(similar_classes(rows, sets_of, threshold, wide_band))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of report ids as TESTDATA.md fixes them: three words, 0.7, equal contents included."""
    members, links = near_duplicates(read_table(spark, sf_dir, "reports"), "report_id", "content", 3, 0.7)
    # Ids of a class of many copies are dealt to salts, and its links to each of them.
    sizes = members.groupBy("class").agg(F.ceil(F.count("*") / F.lit(PER_SALT)).cast("int").alias("salts"))
    dealt = members.join(sizes.where("salts > 1"), "class", "left").select("class", "id", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)).cast("bigint")).cast("int").alias("salt"))
    each = sizes.select("class", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    side = lambda c, x: dealt.select(F.col("class").alias(c), F.col("salt").alias(f"{c}_salt"), F.col("id").alias(x))
    salts = lambda c: each.select(F.col("class").alias(c), F.col("salt").alias(f"{c}_salt"))
    between = links.join(salts("a"), "a").join(salts("b"), "b").join(side("a", "x"), ["a", "a_salt"]).join(side("b", "y"), ["b", "b_salt"]).select("x", "y")
    within = salted_pairs(members, "class", "id").where(F.col("id_a") < F.col("id_b")).select(F.col("id_a").alias("x"), F.col("id_b").alias("y"))
    pairs = between.unionAll(within).where(F.col("x") != F.col("y"))
    return pairs.select(F.least("x", "y").alias("report_id_a"), F.greatest("x", "y").alias("report_id_b")).distinct()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per report: its class of equal contents, its group over all links, and its class's links."""
    members, links = near_duplicates(read_table(spark, sf_dir, "reports"), "report_id", "content", 3, 0.7)
    edges = links.select(F.explode(F.array("a", "b")).alias("entity"), F.concat(F.hex("a"), F.hex("b")).alias("record"))
    labels = propagate_labels(edges)
    counts = edges.groupBy(F.col("entity").alias("class")).agg(F.count("*").alias("links"))
    rows = members.join(labels.withColumnRenamed("entity", "class"), "class", "left").join(counts, "class", "left")
    return rows.select(
        F.col("id").alias("report_id"), F.lower(F.hex("class")).alias("class_id"), F.lower(F.hex(F.coalesce("label", "class"))).alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")
    )
