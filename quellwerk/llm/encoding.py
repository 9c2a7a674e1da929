"""Encoding of a text column with a public byte-level BPE vocabulary.

Pre-tokenisation runs over code point arrays: every code point has a class, every
class is a transition function over eight scanner states, and functions compose
associatively, so the state at every position comes from a doubling scan instead
of a regular expression. Only stretches that hold a possible contraction need the
scan; elsewhere a class fixes its state. The slices between boundaries are encoded
by rank-ordered pair merging with a cache per worker.

Defined cases: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; texts of any length are encoded whole; repeated
rows give repeated results; columns of the input other than id and text are dropped.
"""

from __future__ import annotations

import os
import base64
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.session import read_table, spread

#: The vocabulary file; another place is named by the environment variable or by the operators' parameter.
VOCABULARY = os.environ.get("QUELLWERK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Code points of the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The vocabulary's contractions after an apostrophe.
SHORT_CONTRACTIONS = "stmd"
LONG_CONTRACTIONS = ["re", "ve", "ll"]

LETTER, DIGIT, OTHER, BLANK, SPACE, GAP, SHORT, LONG = range(8)
FREE, IN_LETTERS, IN_DIGITS, IN_OTHER, IN_BLANK, AFTER_SPACE, TWO_LEFT, ONE_LEFT = range(8)
CHUNK_CHARS = 2_000_000
CACHE_ENTRIES = 400_000

_state: dict = {}


def class_table() -> np.ndarray:
    if "classes" not in _state:
        table = np.full(0x110000, OTHER, np.uint8)
        major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), "S1")
        table[major == b"L"] = LETTER
        table[major == b"N"] = DIGIT
        table[WHITE_SPACE] = BLANK
        table[0x20] = SPACE
        _state["classes"] = table
    return _state["classes"]


def transitions() -> np.ndarray:
    """Row c is the function of class c: state before -> state after."""
    plain = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, OTHER: IN_OTHER, BLANK: IN_BLANK, SPACE: AFTER_SPACE, GAP: FREE}
    table = np.zeros((8, 8), np.uint8)
    for symbol in range(8):
        for state in range(8):
            if state == TWO_LEFT:
                after = ONE_LEFT
            elif state == ONE_LEFT:
                after = FREE
            elif symbol in plain:
                after = plain[symbol]
            elif state in (IN_OTHER, AFTER_SPACE):
                after = IN_OTHER
            else:
                after = ONE_LEFT if symbol == SHORT else TWO_LEFT
            table[symbol, state] = after
    return table


TRANSITIONS = transitions()
#: STARTS[state before, class]: a token begins here (blanks after blanks are settled apart).
STARTS = np.ones((8, 8), bool)
STARTS[[TWO_LEFT, ONE_LEFT], :] = False
for _symbol, _run in ((LETTER, IN_LETTERS), (DIGIT, IN_DIGITS), (OTHER, IN_OTHER), (SHORT, IN_OTHER), (LONG, IN_OTHER)):
    STARTS[[_run, AFTER_SPACE], _symbol] = False


def boundaries(codes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Start offsets of the pre-tokens of concatenated texts; gaps are the separators' offsets."""
    symbol = class_table()[codes]
    symbol[gaps] = GAP
    quote = np.flatnonzero(codes[:-2] == 0x27) if len(codes) > 2 else np.empty(0, np.int64)
    if len(quote):
        first, second, inside = codes[quote + 1], codes[quote + 2], symbol[quote + 1] == LETTER
        symbol[quote[inside & np.isin(first, [ord(c) for c in SHORT_CONTRACTIONS])]] = SHORT
        for pair in LONG_CONTRACTIONS:
            symbol[quote[inside & (first == ord(pair[0])) & (second == ord(pair[1])) & (symbol[quote + 2] == LETTER)]] = LONG
    after = TRANSITIONS[symbol, FREE]
    marked = symbol >= SHORT
    blank = (symbol >= BLANK) & (symbol <= GAP)
    if marked.any():
        stretch = np.cumsum(blank)
        hit = np.zeros(int(stretch[-1]) + 1, bool)
        hit[stretch[marked]] = True
        inside = np.flatnonzero(hit[stretch] & ~blank)
        function = TRANSITIONS[symbol[inside]]
        fresh = np.ones(len(inside), bool)
        fresh[1:] = stretch[inside[1:]] != stretch[inside[:-1]]
        head = np.flatnonzero(fresh)
        before_head = np.where(inside[head] > 0, after[np.maximum(inside[head] - 1, 0)], FREE)
        function[head] = function[head, before_head][:, None]
        longest, step = int(np.diff(np.append(head, len(inside))).max()), 1
        while step < longest:
            function[step:] = np.take_along_axis(function[step:], function[:-step].astype(np.intp), 1)
            step *= 2
        after[inside] = function[:, 0]
    before = np.empty_like(after)
    before[0], before[1:] = FREE, after[:-1]
    start = STARTS[before, symbol]
    following = np.empty_like(symbol)
    following[:-1], following[-1] = symbol[1:], GAP
    run = ((symbol == BLANK) | (symbol == SPACE)) & ((before == IN_BLANK) | (before == AFTER_SPACE))
    last = (following != BLANK) & (following != SPACE) & (following != GAP)
    start[run] = last[run]
    return np.flatnonzero(start)


class Merger(dict):
    """Cache from pre-token to its ids; a miss runs the pair merging."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else self.merge(raw)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Join the adjacent pair of the lowest rank, leftmost first, until none is in the vocabulary."""
        ranks, n = self.ranks, len(raw)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(raw[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n:
                continue
            middle = end[i]
            if end[middle] != stop:
                continue
            alive[middle], end[i] = False, stop
            if stop < n:
                left[stop] = i
                rank = ranks.get(raw[i : end[stop]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            j = left[i]
            if j >= 0:
                rank = ranks.get(raw[j:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, j, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[raw[i : end[i]]])
            i = end[i]
        return tuple(ids)


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def encoder(raw: bytes) -> Merger:
    if _state.get("key") != hash(raw):
        _state["merger"], _state["key"] = Merger(parse_ranks(raw)), hash(raw)
    return _state["merger"]


def encode_block(texts: list[str], merger: Merger) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Ids of all texts in one array, the offsets of each text in it, the pre-tokens, ids per pre-token."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    gaps = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = boundaries(codes, gaps)
    edge = np.append(starts, len(codes)).tolist()
    pieces = [joined[a:b] for a, b in zip(edge, edge[1:])]
    lists = [merger[p] for p in pieces]
    separators = np.searchsorted(starts, gaps)
    for k in separators.tolist():
        lists[k] = ()
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))
    offsets = np.concatenate([[0], np.cumsum(counts)[separators]])
    return ids, offsets, pieces, counts


def blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > CHUNK_CHARS:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text) + 1
    if block:
        yield block


def char_starts(texts: list[str], ids: np.ndarray, offsets: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Code point offset, within its text, at which each id's bytes begin."""
    out = np.empty(len(ids), np.int32)
    for text, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist()):
        if a == b:
            continue
        head = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        byte = np.concatenate([[0], np.cumsum(widths[ids[a : b - 1]])])
        out[a:b] = (np.cumsum(head) - 1)[byte]
    return out


def vocabulary_bytes(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(id, ids ARRAY<INT>[, char_starts ARRAY<INT>]), one row per input row, no shuffle.

    The vocabulary file (under 1 MB, whatever the data) is read by the driver and
    sent to the executors once.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = encoder(shared.value)
        widths = None
        if offsets:
            widths = np.zeros(max(merger.ranks.values()) + 1, np.int64)
            for token, rank in merger.ranks.items():
                widths[rank] = len(token)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            done = 0
            for block in blocks(texts):
                ids, edge, _, _ = encode_block(block, merger)
                columns = [keys.slice(done, len(block)), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids))]
                names = ["doc_id", "ids"]
                if offsets:
                    columns.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(char_starts(block, ids, edge, widths))))
                    names.append("char_starts")
                done += len(block)
                yield pa.RecordBatch.from_arrays(columns, names)

    key_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key_type}, ids array<int>" + (", char_starts array<int>" if offsets else "")
    return spread(source).mapInArrow(run, schema)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., n_tokens INT), one row per input row; null and empty texts have 0."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    source = df.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = encoder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            counts = [np.diff(encode_block(block, merger)[1]) for block in blocks(texts)]
            flat = np.concatenate(counts) if counts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(flat, pa.int32())], [*names, "n_tokens"])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    return spread(source).mapInArrow(run, f"{kinds}, n_tokens int")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the inverse of encode_corpus; a null list gives a null text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    source = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: raw for raw, rank in encoder(shared.value).ranks.items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(map(token.__getitem__, ids)).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents"))


def p6_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and documents by source: partial sums are combined before the shuffle."""
    counts = count_tokens(read_table(spark, sf_dir, "documents"), keep=("source",))
    return counts.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
