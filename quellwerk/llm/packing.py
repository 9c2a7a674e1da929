"""Packing of items into containers of fixed capacity.

All planning works on the histogram of lengths, which has at most `capacity` bins
whatever the data's size. Shallow combinations of up to four lengths (some taken
several times) that fill the window [capacity - window, capacity] are enumerated from
pairs, the best by the residual entering an active set; a non-negative least-squares
fit of their repeat counts to the histogram runs until the residual is under TOLERANCE
of the histogram. Counts are rounded to the nearest that the histogram can pay, what
is left is fitted again while that fills containers, first with combinations that fill
a container wholly, then with those of the window, and the rest is packed greedily, a
combination at a time. Rows are matched to planned slots by their rank within their
length; ranks come from salts of bounded size and their offsets, so a length that a
third of all rows share is ranked by as many tasks as it needs.

Defined cases: null, empty and zero-length items go nowhere; an item is split only
if it alone exceeds the capacity, into full pieces and a remainder that is packed
like any other item; items of equal length are ranked by a hash of their id and
then by the id; an empty table gives no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quellwerk.llm.encoding import count_tokens
from quellwerk.session import cut_lineage, read_table

CAPACITY = 2048
WINDOW = 16
#: Rows of one length that a single task ranks.
PER_SALT = 1_000_000
#: The fit ends when its residual is under this part of the histogram (both as Euclidean lengths), or after ROUNDS rounds of new columns.
TOLERANCE, ROUNDS, STEPS = 0.05, 24, 60
#: Pairs of lengths considered, pairs kept a sum, and the least count that keeps a column in the active set.
PAIRS, PAIRS_A_SUM, LEAST_COUNT = 60_000, 4, 0.02
SEED = 5


def parts_of(lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Rows (sum, a, k, b, j), halves of combinations: k items of length a alone, or one of each of two lengths; row 0 is the empty half."""
    times = capacity // lengths
    a = np.repeat(lengths, times)
    k = np.concatenate([np.arange(1, n + 1) for n in times])
    alone = np.stack([a * k, a, k, np.zeros_like(a), np.zeros_like(a)], 1)
    i, j = np.triu_indices(len(lengths), 1)
    i, j = i[keep := lengths[i] + lengths[j] <= capacity], j[keep]
    if len(i) > PAIRS:
        drawn = rng.choice(len(i), PAIRS, replace=False)
        i, j = i[drawn], j[drawn]
    one = np.ones_like(i)
    both = np.stack([lengths[i] + lengths[j], lengths[i], one, lengths[j], one], 1)
    return np.concatenate([np.zeros((1, 5), np.int64), alone, both])


def combinations(parts: np.ndarray, residual: np.ndarray, capacity: int, window: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, copies), four a row with zeros where there are fewer: for each length the combination that lowers the residual most.

    Gains are jittered, or neighbouring lengths would all choose the same partners.
    """
    dot = parts[:, 2] * residual[parts[:, 1]] + parts[:, 4] * residual[parts[:, 3]]
    gain = dot / np.maximum(1.0, np.hypot(parts[:, 2], parts[:, 4])) * rng.random(len(dot)) ** 4
    useful = np.flatnonzero(gain > 0)
    order = useful[np.lexsort((-gain[useful], parts[useful, 0]))]
    sums = parts[order, 0]
    place = np.arange(len(order)) - np.searchsorted(sums, sums)
    order = order[place < PAIRS_A_SUM]
    start = np.searchsorted(parts[order, 0], np.arange(capacity + 2))
    order = np.concatenate([np.zeros(1, np.int64), order])  # the empty half and then by sum
    start[1:] += 1
    sums, joined = parts[order, 0], []
    for waste in range(window + 1):
        wanted = capacity - waste - sums
        low = np.flatnonzero(sums <= wanted)
        for nth in range(PAIRS_A_SUM):
            right = start[wanted[low]] + nth
            good = right < start[wanted[low] + 1]
            joined.append(np.stack([order[low[good]], order[right[good]]], 1))
    left, right = np.concatenate(joined).T
    lengths = np.concatenate([parts[left][:, [1, 3]], parts[right][:, [1, 3]]], 1)
    copies = np.concatenate([parts[left][:, [2, 4]], parts[right][:, [2, 4]]], 1)
    dot = (copies * residual[lengths]).sum(1)
    gain = dot * np.abs(dot) / (copies.astype(float) ** 2).sum(1) * rng.random(len(dot)) ** 4
    best = np.zeros(capacity + 1)
    for column in lengths.T:
        np.maximum.at(best, column, gain)
    best[0] = np.inf
    chosen = np.flatnonzero((gain > 0) & (gain[:, None] == best[lengths]).any(1))
    return lengths[chosen], copies[chosen]


def used_of(lengths: np.ndarray, copies: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Items of each length that the combinations take (A x)."""
    used = np.bincount(lengths.ravel(), (copies * counts[:, None]).ravel(), size)
    used[0] = 0
    return used


def refit(lengths: np.ndarray, copies: np.ndarray, counts: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Counts x >= 0 nearer to the least |A x - histogram|^2 than those given (accelerated projected gradient, restarted where it turns)."""
    size = len(histogram)
    norms = np.sqrt((copies.astype(float) ** 2).sum(1))
    scaled = copies / norms[:, None]
    apply = lambda y: used_of(lengths, scaled, y, size)
    back = lambda r: (scaled * r[lengths]).sum(1)
    v = np.ones(len(counts))
    for _ in range(15):
        v = back(apply(v / np.linalg.norm(v)))
    step = 1 / (1.05 * np.linalg.norm(v))
    y = z = counts * norms
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0, z - step * back(apply(z) - histogram))
        if ((z - new) * (new - y)).sum() > 0:
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, z, t = new, new + (t - 1) / t_new * (new - y), t_new
    return y / norms


def least_squares(histogram: np.ndarray, capacity: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(lengths, copies, counts, residual): the active set of combinations with their repeat counts, and |A x - h| / |h|."""
    rng = np.random.default_rng(SEED)
    h = histogram.astype(float)
    lengths, copies, counts = np.empty((0, 4), np.int64), np.empty((0, 4), np.int64), np.empty(0)
    residual, left = 1.0, h
    parts = parts_of(np.flatnonzero(histogram), capacity, rng)
    for _ in range(ROUNDS):
        more, times = combinations(parts, left, capacity, window, rng)
        if not len(more):
            break
        lengths, copies, counts = np.concatenate([lengths, more]), np.concatenate([copies, times]), np.concatenate([counts, np.zeros(len(more))])
        counts = refit(lengths, copies, counts, h)
        active = counts > LEAST_COUNT
        lengths, copies, counts = lengths[active], copies[active], counts[active]
        left = h - used_of(lengths, copies, counts, len(h))
        residual = np.linalg.norm(left) / np.linalg.norm(h)
        if residual < TOLERANCE:
            break
    return lengths, copies, counts, residual


def plan_containers(histogram: np.ndarray, capacity: int = CAPACITY, window: int = WINDOW, fit: bool = True) -> list[tuple[int, list[tuple[int, int]]]]:
    """(containers, [(length, items of it in each container)]): together exactly the histogram. Without fit, by the greedy rest alone."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan = []

    def take(parts: list[tuple[int, int]], most: int) -> int:
        times = min(most, *(left[length] // copies for length, copies in parts))
        if times > 0:
            for length, copies in parts:
                left[length] -= times * copies
            plan.append((int(times), parts))
        return max(0, int(times))

    bound = (left * np.arange(len(left))).sum() / capacity
    widths = [0, window] if fit else []
    while widths and left.any():
        lengths, copies, counts, _ = least_squares(left, capacity, widths[0])
        filled = 0
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] < 0.5:
                break
            parts: dict[int, int] = {}
            for length, n in zip(lengths[i].tolist(), copies[i].tolist()):
                if length:
                    parts[length] = parts.get(length, 0) + n
            filled += take(sorted(parts.items()), round(counts[i]))
        if filled < 0.02 * bound:
            widths.pop(0)
    # Residual: the longest item first, then always the longest that still fits.
    while left.any():
        space, rest, nonzero = capacity, [], np.flatnonzero(left)
        while space:
            at = np.searchsorted(nonzero, space, "right") - 1
            if at < 0:
                break
            length = int(nonzero[at])
            n = int(min(left[length], space // length))
            rest.append((length, n))
            space -= n * length
            nonzero = nonzero[:at]
        take(rest, int(left.max()))
    return plan


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, copies, first container), sorted: whose item of a rank goes where."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for times, parts in plan:
        for length, copies in parts:
            rows.append((length, used.get(length, 0), copies, container))
            used[length] = used.get(length, 0) + times * copies
        container += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(lengths: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """(container_id BIGINT, doc_id, piece INT, pieces INT, start_token, end_token INT): one row per packed piece."""
    items = lengths.select(F.col(id_col).alias("doc_id"), F.col(length_col).cast("int").alias("n")).where(F.col("n") > 0)
    pieces = F.ceil(F.col("n") / F.lit(capacity)).cast("int")
    cut = items.withColumn("pieces", pieces).select("doc_id", "n", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    start = F.col("piece") * F.lit(capacity)
    cut = cut.select("doc_id", "piece", "pieces", start.alias("start_token"), F.least(F.col("n"), start + F.lit(capacity)).alias("end_token"))
    cut = cut_lineage(cut.withColumn("length", F.col("end_token") - F.col("start_token")))  # read three times below
    spark = lengths.sparkSession
    sizes = cut.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # at most capacity rows
    histogram = np.bincount(sizes["length"], sizes["n"], capacity + 1) if len(sizes) else np.zeros(capacity + 1)
    salts = np.maximum(1, -(-histogram // PER_SALT)).astype(int)
    salted = cut.join(F.broadcast(spark.createDataFrame(list(enumerate(salts.tolist())), "length int, salts int")), "length")  # capacity + 1 rows
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas()  # at most capacity + rows / PER_SALT rows
    ranked = salted.withColumn("within", F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.xxhash64("doc_id"), "doc_id", "piece")) - 1)
    counts = counts.sort_values(["length", "salt"])
    counts["base"] = counts.groupby("length")["n"].cumsum() - counts["n"]
    first = np.concatenate([[0], np.cumsum(salts)])
    base = np.zeros(first[-1], np.int64)
    base[first[counts["length"].to_numpy(int)] + counts["salt"].to_numpy(int)] = counts["base"]
    shared = df_broadcast(spark, (slots(plan_containers(histogram, capacity, window)), first, base))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first, base = shared.value
        key = table[:, 0] * (1 << 40) + table[:, 1]
        for batch in batches:
            column = {name: batch.column(i).to_numpy(False) for i, name in enumerate(batch.schema.names) if name != "doc_id"}
            rank = base[first[column["length"]] + column["salt"]] + column["within"]
            row = table[np.searchsorted(key, column["length"].astype(np.int64) * (1 << 40) + rank, "right") - 1]
            container = row[:, 3] + (rank - row[:, 1]) // np.maximum(row[:, 2], 1)
            yield pa.RecordBatch.from_arrays([pa.array(container), *(batch.column(batch.schema.names.index(n)) for n in names)], ["container_id", *names])

    names = ["doc_id", "piece", "pieces", "start_token", "end_token"]
    key_type = lengths.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"container_id bigint, doc_id {key_type}, piece int, pieces int, start_token int, end_token int")


def df_broadcast(spark: SparkSession, value: object):
    """The plan's tables, bounded by the capacity and not by the data."""
    return spark.sparkContext.broadcast(value)


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(count_tokens(read_table(spark, sf_dir, "documents")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, sf_dir).where(F.col("pieces") > 1).select("doc_id").distinct()


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by fill in percent: how much space stays unused."""
    used = packed_documents(spark, sf_dir).groupBy("container_id").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("used"))
    return used.groupBy(F.floor(F.col("used") * 100 / F.lit(CAPACITY)).cast("int").alias("fill_percent")).agg(F.count("*").alias("containers"))
