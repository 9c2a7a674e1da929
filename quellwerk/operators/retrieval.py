"""Ranked retrieval: character-gram and word BM25, dense similarity, random baseline, combined search.

Scores are rounded to six decimals before ranking and ties go to the smaller id, so a
ranking does not depend on the order in which partial sums meet.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quellwerk.functions.names import porter_stem, stemmed
from quellwerk.functions.text import GRAM_ALPHABET

K1, B = 1.2, 0.75


def gram_counts(docs: DataFrame, id_col: str, text_col: str, n: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., dl, term, tf): counted inside each row in Arrow batches, so nothing is shuffled.

    Measured against exploding char_grams and grouping, which shuffles every gram.
    """
    source = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("_text"))
    names = ["id", *keep]
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column(len(names)).to_pylist()):
                found = grams_of(text, n)
                rows.append(np.full(len(found), i))
                lengths.append(np.full(len(found), found.total()))
                terms += found.keys()
                counts += found.values()
            at = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            length = pa.array(np.concatenate(lengths) if rows else np.empty(0, np.int64), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(names))), length, pa.array(terms, pa.string()), pa.array(counts, pa.int64())], [*names, "dl", "term", "tf"])

    return source.mapInArrow(run, f"{kinds}, dl int, term string, tf bigint")


def word_counts(docs: DataFrame, id_col: str, text_col: str, stem: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, tf, dl, keep...) over words of letters and digits, lower-cased, on demand stemmed."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("id"), *keep, tokens.alias("t")).where(F.size("t") > 0)
    rows = rows.select("id", *keep, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", *keep, "dl", "term").agg(F.count("*").alias("tf"))
    if not stem:
        return rows
    vocabulary = rows.select("term").distinct().withColumn("stem", stemmed("term"))  # every word is stemmed once
    return rows.join(vocabulary, "term").groupBy("id", *keep, "dl", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def top_k(scored: DataFrame, group: list[str], k: int, id_col: str = "id", score: str = "score") -> DataFrame:
    """The k best of each group with rank from 1; Spark prunes each partition to k before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_idf(n: Column, df: Column, floor: bool = False) -> Column:
    """ln((n - df + .5) / (df + .5) + 1); with floor the full-text variant without + 1, at least 1e-6."""
    ratio = (n - df + 0.5) / (df + 0.5)
    return F.greatest(F.log(ratio), F.lit(1e-6)) if floor else F.log(ratio + 1)


_NOT_GRAM = re.compile(GRAM_ALPHABET)


def grams_of(text: str | None, n: int = 3) -> Counter:
    """The counts of char_grams, for work inside Arrow batches."""
    flat = _NOT_GRAM.sub(" ", (text or "").lower()).strip(" ").replace(" ", "_")
    return Counter(flat[i : i + n] for i in range(len(flat) - n + 1)) if len(flat) >= n else Counter([flat] if flat else [])


_WORD = re.compile(r"[^\W_]+")
_stem = lru_cache(1 << 18)(porter_stem)


def words_of(text: str | None) -> Counter:
    """The counts of words, as of word_counts, for work inside Arrow batches."""
    return Counter(_WORD.findall((text or "").lower()))


def stems_of(text: str | None) -> Counter:
    """The counts of stemmed words, as of word_counts with stem, for work inside Arrow batches."""
    return Counter(map(_stem, _WORD.findall((text or "").lower())))


_LETTERS = "0123456789abcdefghijklmnopqrstuvwxyzäöüß_"
_LETTER_CODES = np.zeros(256, np.int64)
_LETTER_CODES[[ord(c) for c in _LETTERS]] = np.arange(1, len(_LETTERS) + 1)
_BASE = len(_LETTERS) + 1
#: Characters of texts that are cut into terms at a time, so that long texts bound no batch's memory.
_CHARS_AT_ONCE = 4_000_000

# (row, code, tf) of distinct terms, sorted by row, and the number of terms of each row.
Cut = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def cut_grams(texts: list[str | None]) -> Cut:
    """The terms of char_grams for n = 3, as codes, for whole lists of texts."""
    flat = [_NOT_GRAM.sub(" ", (t or "").lower()).strip(" ").replace(" ", "_") for t in texts]
    parts, low = [], 0
    while low < len(flat):
        high, chars = low + 1, len(flat[low])
        while high < len(flat) and chars + len(flat[high]) < _CHARS_AT_ONCE:
            chars += len(flat[high])
            high += 1
        sizes = np.array([len(t) for t in flat[low:high]], np.int64)
        codes = _LETTER_CODES[np.frombuffer(("".join(flat[low:high]) + "  ").encode("latin-1"), np.uint8)]
        first = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        gram = (codes[:-2] * _BASE + codes[1:-1]) * _BASE + codes[2:]
        room = sizes[row] - (np.arange(len(row)) - first[row])  # characters of the text from here on
        short = sizes[row] < 3  # a shorter text is one gram
        gram = np.where(short, np.where(room == 2, gram // _BASE * _BASE, gram // _BASE**2 * _BASE**2), gram)
        kept = (room >= 3) | (short & (room == sizes[row]))
        key, tf = np.unique(row[kept] * _BASE**3 + gram[kept], return_counts=True)
        parts.append((key // _BASE**3 + low, key % _BASE**3, tf, np.where(sizes == 0, 0, np.maximum(sizes - 2, 1))))
        low = high
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 4


def cut_by(count: Callable[[str | None], Counter]) -> Callable[[list[str | None]], Cut]:
    """A cutter of lists of texts from a counter of one text's words; a word's code is its hash."""

    def cut(texts: list[str | None]) -> Cut:
        rows, codes, tfs, sizes = [], [], [], []
        for i, text in enumerate(texts):
            found = count(text)
            rows.append(np.full(len(found), i, np.int64))
            codes += map(_word_code, found)
            tfs += found.values()
            sizes.append(found.total())
        return np.concatenate(rows) if rows else np.empty(0, np.int64), np.array(codes, np.int64), np.array(tfs, np.int64), np.array(sizes, np.int64)

    return cut


@lru_cache(1 << 18)
def _word_code(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


cut_stems, cut_words = cut_by(stems_of), cut_by(words_of)


def search_index(docs: DataFrame, id_col: str, text_col: str, cut: Callable[[list], Cut] = cut_grams, keep: tuple[str, ...] = (), only: np.ndarray | None = None) -> DataFrame:
    """(id, keep..., dl INT, codes BINARY, tfs BINARY, more BINARY): the terms of each document where it is read, no shuffle; a row for every document.

    A code takes the bytes of code_kind, a tf one byte; those of 255 and more stand in
    `more`, in order. `only` (sorted codes) leaves out all other terms; dl counts them nevertheless.
    """
    source = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("_text"))
    names, kind = ["id", *keep], code_kind(cut)
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, tf, sizes = cut(batch.column(len(names)).to_pylist())
            if only is not None:
                kept = np.isin(code, only)
                row, code, tf = row[kept], code[kept], tf[kept]
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            blob = lambda x, edge=edge: pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((edge * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            large = tf >= 255
            more = blob(tf[large].astype(np.int32), np.searchsorted(row[large], np.arange(batch.num_rows + 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sizes, pa.int32()), blob(code.astype(kind)), blob(np.minimum(tf, 255).astype(np.uint8)), more], [*names, "dl", "codes", "tfs", "more"])

    return source.mapInArrow(run, f"{kinds}, dl int, codes binary, tfs binary, more binary")


def code_kind(cut: Callable[[list], Cut]) -> type:
    """How search_index writes codes: those of grams are small, those of words are hashes."""
    return np.int32 if cut is cut_grams else np.int64


def asked_terms(queries: DataFrame, text_col: str, cut: Callable[[list], Cut], most: int = 1_000_000) -> np.ndarray | None:
    """The sorted codes of all queries' terms; None for more than `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(cut(batch.column(0).to_pylist())[1]), pa.int64())], ["code"])

    found = queries.select(text_col).mapInArrow(run, "code bigint").distinct().limit(most + 1).toPandas()["code"].to_numpy(np.int64)
    return np.sort(found) if len(found) <= most else None


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of search_index, and the row of each."""
    _, offsets, data = column.buffers()
    edge = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(kind).itemsize
    values = np.frombuffer(data, kind)[edge[0] : edge[-1]] if data is not None else np.empty(0, kind)
    return values, np.repeat(np.arange(len(column)), np.diff(edge))


class QueryBlock:
    """A block of queries as postings: for each (scope, term) the queries that ask for it."""

    def __init__(self, asked: pd.DataFrame, cut: Callable[[list], Cut], mask: str | None):
        row, code, _, _ = cut(asked["text"].tolist())
        self.names, self.kind = asked["query_id"].to_numpy(), code_kind(cut)
        self.scopes = {v: i for i, v in enumerate(asked[mask].dropna().unique())} if mask else {}
        self.terms = np.unique(code)
        scope = asked[mask].map(self.scopes).fillna(-1).to_numpy(np.int64) if mask else np.zeros(len(asked), np.int64)
        key = scope[row] * max(1, len(self.terms)) + np.searchsorted(self.terms, code)
        row, key = row[kept := scope[row] >= 0], key[kept]
        order = np.argsort(key, kind="stable")
        self.query = row[order]
        self.keys, self.start = np.unique(key[order], return_index=True)
        self.start = np.append(self.start, len(order))

    def meet(self, batch: pa.RecordBatch, mask: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in keys, tf) of a batch's terms that the block asks for, and each row's scope (-1: none)."""
        scope = np.zeros(batch.num_rows, np.int64)
        if mask:
            scope = np.array([self.scopes.get(v, -1) for v in batch.column(batch.schema.get_field_index(mask)).to_pylist()], np.int64)
        code, row = _flat(batch.column(batch.schema.get_field_index("codes")), self.kind)
        tf = _flat(batch.column(batch.schema.get_field_index("tfs")), np.uint8)[0].astype(np.int64)
        tf[tf == 255] = _flat(batch.column(batch.schema.get_field_index("more")), np.int32)[0]
        at = np.minimum(np.searchsorted(self.terms, code), max(0, len(self.terms) - 1))
        kept = (scope[row] >= 0) & (self.terms[at] == code) if len(self.terms) else np.zeros(len(code), bool)
        row, tf, key = row[kept], tf[kept], scope[row[kept]] * max(1, len(self.terms)) + at[kept]
        place = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        kept = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
        return row[kept], place[kept], tf[kept], scope


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of search_index in slices of some _TERMS_AT_ONCE terms."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index("tfs"))  # a byte a term
    edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(edge, int(edge[low]) + _TERMS_AT_ONCE, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


class Best:
    """The k best rows (query, score, columns) of each query so far, by score, ties to the smaller value of the first column.

    Rows pile up to _ROWS_HELD, or twice what must be kept, before they are sorted and cut.
    """

    def __init__(self, many: int, k: int):
        self.k, self.least = k, np.zeros(many)  # a row under its query's least can't be among the best
        self.held: list[list[pa.Array]] = []
        self.rows, self.limit = 0, _ROWS_HELD

    def add(self, query: np.ndarray, score: np.ndarray, columns: list[pa.Array]) -> None:
        if len(query):
            self.held.append([pa.array(query.astype(np.int32)), pa.array(score), *columns])
            self.rows += len(query)
            if self.rows > self.limit:
                self.cut()

    def cut(self) -> None:
        columns = [pa.concat_arrays(c) for c in zip(*self.held)]
        table = pa.table(columns, [str(i) for i in range(len(columns))])
        table = table.take(pc.sort_indices(table, sort_keys=[("0", "ascending"), ("1", "descending"), ("2", "ascending")], null_placement="at_start"))
        query = table.column("0").to_numpy()
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = nth == self.k - 1
        self.least[query[last]] = table.column("1").to_numpy()[last]
        self.held = [[pa.concat_arrays(c.chunks) for c in table.filter(pa.array(nth < self.k)).columns]]
        self.rows = len(self.held[0][0])
        self.limit = max(_ROWS_HELD, 2 * self.rows)

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
        if self.held:
            self.cut()
            for low in range(0, self.rows, 100_000):
                query, score, *columns = (c.slice(low, 100_000) for c in self.held[0])
                yield query.to_numpy(), score.to_numpy(), columns


class Scorer:
    """Scores of documents against all queries of a block, without scopes: bounds from a matrix product, then sums for what can be among the best.

    The terms that most pairs share are multiplied in single precision, the others
    added; all summands are positive, so a sum is off by a share of itself at most.
    """

    def __init__(self, postings: QueryBlock, found: np.ndarray, docs: float):
        self.many, self.width = len(postings.names), len(postings.terms)
        sizes = np.diff(postings.start)
        self.postings, self.sizes = postings, sizes
        term = np.repeat(np.arange(self.width), sizes)
        order = np.argsort(postings.query, kind="stable")
        self.term = term[order]  # of each query, in the order of the codes
        self.length = np.bincount(postings.query, minlength=self.many)
        self.first = np.cumsum(self.length) - self.length
        self.slack = 1 - (self.length + 16) * 2.0**-22
        gain = found / max(docs, 1) * sizes / self.many  # summands that a matrix column of the term saves, for each pair
        heavy = np.argsort(-gain, kind="stable")[: max(1, _MATRIX_CELLS // self.many)]
        heavy = np.sort(heavy[gain[heavy] > 0.004])
        self.column = np.full(self.width, -1)
        self.column[heavy] = np.arange(len(heavy))
        self.matrix = np.zeros((self.many, len(heavy)), np.float32)
        inside = self.column[term] >= 0
        self.matrix[postings.query[inside], self.column[term[inside]]] = 1
        self.at_once = max(1, _SCORES_AT_ONCE // max(self.many, self.width))

    def pairs(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, size: int, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the pairs that reach their query's least. At most at_once rows, from 0."""
        weights = np.zeros((size, self.width))
        weights[row, term] = value
        column = self.column[term]
        thick = column >= 0
        dense = np.zeros((size, self.matrix.shape[1]), np.float32)
        dense[row[thick], column[thick]] = value[thick]
        scores = self.matrix @ dense.T
        thin = np.flatnonzero(~thick)
        work = np.cumsum(self.sizes[term[thin]])
        flat = scores.reshape(-1)
        for part in np.split(thin, np.searchsorted(work, np.arange(_SCORES_AT_ONCE, work[-1], _SCORES_AT_ONCE))) if len(thin) else []:
            times = self.sizes[term[part]]
            source = np.repeat(part, times)
            nth = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
            query = self.postings.query[self.postings.start[term[source]] + nth]
            flat += np.bincount(query * size + row[source], value[source], len(flat)).astype(np.float32)
        low = np.maximum((least - 1e-6) * self.slack, 1e-30).astype(np.float32)
        if size > k and not least.any():  # the first documents
            low = np.maximum(low, (np.partition(scores, size - k, axis=1)[:, size - k] * self.slack - 1e-6) * self.slack).astype(np.float32)
        query, at = np.divmod(np.flatnonzero(scores >= low[:, None]), size)
        total = np.zeros(len(query))
        work = np.cumsum(self.length[query])
        begin = 0
        while begin < len(query):
            end = max(begin + 1, int(np.searchsorted(work, (work[begin - 1] if begin else 0) + _SCORES_AT_ONCE)))
            times = self.length[query[begin:end]]
            pair = np.repeat(np.arange(end - begin), times)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
            total[begin:end] = np.bincount(pair, weights[at[begin:end][pair], self.term[self.first[query[begin:end][pair]] + nth]], end - begin)
            begin = end
        total = np.round(total, 6)
        kept = (total >= least[query]) & (total > 0)
        return query[kept], at[kept], total[kept]


#: Queries of a block, on average; their postings take some hundred bytes each on every executor.
BLOCK = 20_000
#: Scores and summands held at a time while documents meet a block, terms of documents, rows before they are cut to the best, cells of the matrix of queries.
_SCORES_AT_ONCE, _TERMS_AT_ONCE, _ROWS_HELD, _MATRIX_CELLS = 1_000_000, 500_000, 100_000, 8_000_000


def bm25_search(index: DataFrame, queries: DataFrame, k: int | None, cut: Callable[[list], Cut] = cut_grams, mask: str | None = None, own: bool = False, floor: bool = False, where: Column | None = None, keep: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(query_id, id, keep..., score, rank): k best documents (all, unranked, for k None) that share a term with a query.

    index: of search_index, best written once; queries: (query_id, text, mask). A query
    meets only documents of its own `mask` value. Statistics hold over all documents, or
    with `own` over those of the mask value; `where` filters what is ranked, not them. No
    document is shuffled: a block of queries goes to the executors as postings, one pass
    counts the documents of each term, a second scores. Each task keeps the k best of each
    query, and only they are shuffled; so a mask value of many rows is no task of its own. Blocks hold BLOCK queries, so only a larger query set takes more passes.
    """
    spark = index.sparkSession
    id_type = index.schema["id"].dataType.simpleString()
    kept = ", ".join(f"`{c}` {index.schema[c].dataType.simpleString()}, " for c in keep).replace(", ,", ",")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {id_type}, {kept.rstrip(', ') + ', ' if keep else ''}score double"
    fields = ["query_id", "text", *([mask] if mask else [])]
    hashed = queries.select(*fields, F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // block)))).alias("_block"))
    parts = []
    for number in sorted(r["_block"] for r in hashed.select("_block").distinct().collect()):
        asked = hashed.where(F.col("_block") == number).select(*fields).toPandas()
        postings = QueryBlock(asked, cut, mask)
        if not len(postings.keys):
            continue
        scopes = max(1, len(postings.scopes)) if own else 1
        shared = spark.sparkContext.broadcast(postings)

        def count(batches: Iterator[pa.RecordBatch], shared=shared, scopes=scopes) -> Iterator[pa.RecordBatch]:
            postings = shared.value
            df, docs, length = (np.zeros(n, np.int64) for n in (len(postings.keys) if own else len(postings.terms), scopes, scopes))
            for batch in (p for b in batches for p in pieces(b)):
                sizes = batch.column(batch.schema.get_field_index("dl")).to_numpy()
                if own or not mask:
                    _, place, _, scope = postings.meet(batch, mask)
                    place = place if own else postings.keys[place]
                else:
                    code, _ = _flat(batch.column(batch.schema.get_field_index("codes")), postings.kind)
                    place = np.minimum(np.searchsorted(postings.terms, code), len(postings.terms) - 1)
                    place, scope = place[postings.terms[place] == code], np.zeros(len(sizes), np.int64)
                df += np.bincount(place, minlength=len(df))
                inside = (scope >= 0) & (sizes > 0)  # documents without a term count nowhere
                docs += np.bincount(scope[inside], minlength=scopes)
                length += np.bincount(scope[inside], sizes[inside], scopes).astype(np.int64)
            at = np.flatnonzero(df)
            many = np.arange(scopes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, -1 - 2 * many, -2 - 2 * many])), pa.array(np.concatenate([df[at], docs, length]))], ["place", "n"])

        counts = index.mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # at most a row a term and scope of the block
        place, n = counts["place"].to_numpy(), counts["n"].to_numpy(float)
        df, docs, length = np.zeros(len(postings.keys) if own else len(postings.terms)), np.zeros(scopes), np.zeros(scopes)
        df[place[place >= 0]] = n[place >= 0]
        for r, total in zip(place[place < 0], n[place < 0]):
            (docs if r % 2 else length)[(-1 - r) // 2] = total
        width = max(1, len(postings.terms))
        own_scope = postings.keys // width if own else np.zeros(len(postings.keys), np.int64)
        found = df if own else df[postings.keys % width]
        ratio = (docs[own_scope] - found + 0.5) / (found + 0.5)
        idf = np.maximum(np.log(np.maximum(ratio, 1e-300)), 1e-6) if floor else np.log(ratio + 1)
        weights = spark.sparkContext.broadcast((idf, np.where(length > 0, length, 1) / np.maximum(docs, 1), found, docs[0]))

        def score(batches: Iterator[pa.RecordBatch], shared=shared, weights=weights) -> Iterator[pa.RecordBatch]:
            postings, (idf, avgdl, found, total) = shared.value, weights.value
            names = pa.array(postings.names)
            many = len(postings.names)
            scorer = Scorer(postings, found, total) if k is not None and not mask else None
            best = Best(many, k) if k is not None else None
            out = lambda q, score, columns: pa.RecordBatch.from_arrays([names.take(pa.array(q)), *columns, pa.array(score)], ["query_id", "id", *keep, "score"])
            for batch in (p for b in batches for p in pieces(b)):
                row, place, tf, scope = postings.meet(batch, mask)
                sizes = batch.column(batch.schema.get_field_index("dl")).to_numpy().astype(float)
                mean = avgdl[np.maximum(scope, 0)] if own else avgdl[0]
                damp = K1 * (1 - B + B * sizes / mean)
                value = idf[place] * (tf * (K1 + 1) / (tf + damp[row]))
                docs, row = np.unique(row, return_inverse=True)
                every = postings.start[place + 1] - postings.start[place]  # queries that ask for the term
                if scorer:
                    edges = [*range(0, len(docs), scorer.at_once), len(docs)]
                else:
                    work = np.cumsum(np.bincount(row, every, len(docs)) + many)
                    edges = [0]
                    while edges[-1] < len(docs):
                        done = work[edges[-1] - 1] if edges[-1] else 0
                        edges.append(max(edges[-1] + 1, int(np.searchsorted(work, done + _SCORES_AT_ONCE))))
                for low, high in zip(edges, edges[1:]):
                    a, b = np.searchsorted(row, [low, high])
                    size = high - low
                    if scorer:
                        q, d, reached = scorer.pairs(row[a:b] - low, place[a:b], value[a:b], size, best.least, k)
                    else:
                        times = every[a:b]
                        source = np.repeat(np.arange(a, b), times)
                        nth = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
                        query = postings.query[postings.start[place[source]] + nth]
                        scores = np.round(np.bincount(query * size + row[source] - low, value[source], many * size), 6).reshape(many, size)
                        q, d = np.nonzero((scores >= best.least[:, None]) & (scores > 0) if best else scores > 0)
                        reached = scores[q, d]
                    at = pa.array(docs[low + d])
                    columns = [batch.column(batch.schema.get_field_index(c)).take(at) for c in ("id", *keep)]
                    if best:
                        best.add(q, reached, columns)
                    elif len(q):
                        yield out(q, reached, columns)
            if best:
                yield from (out(*x) for x in best.parts())

        parts.append((index if where is None else index.where(where)).mapInArrow(score, kinds))
    found = union_of(parts, spark, kinds)
    return found if k is None else top_k(found, ["query_id"], k)


def with_zero_scores(ranking: DataFrame, queries: DataFrame, docs: DataFrame, k: int, mask: str | None = None) -> DataFrame:
    """ranking (query_id, id, score, rank) with rankings of under k filled up by documents that score 0, by id.

    queries: (query_id, mask); docs: (id, mask). Only the k least ids of a mask value are needed, as at most k are missing and fewer are taken.
    """
    short = queries.join(ranking.groupBy("query_id").agg(F.count("*").alias("_found")), "query_id", "left").select("query_id", *([mask] if mask else []), F.coalesce("_found", F.lit(0)).alias("_found")).where(F.col("_found") < k)
    first = docs.select("id", *([mask] if mask else [])).withColumn("_nth", F.row_number().over(Window.partitionBy(*([mask] if mask else [F.lit(0)])).orderBy("id"))).where(F.col("_nth") <= k).drop("_nth")
    offered = short.join(first, mask) if mask else short.join(F.broadcast(first))  # k rows
    offered = offered.join(ranking.select("query_id", "id"), ["query_id", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    filled = offered.withColumn("rank", F.col("_found").cast("int") + place).where(F.col("rank") <= k).select("query_id", "id", F.lit(0.0).alias("score"), "rank")
    return ranking.select("query_id", "id", "score", "rank").unionByName(filled)


def best_of_batch(names: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The k best ids of each query (row of scores) by score, ties to the smaller id; no infinite score."""
    by_id = np.argsort(ids, kind="stable")
    order = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k]]
    q = np.repeat(np.arange(len(names)), order.shape[1])
    out = pd.DataFrame({"query_id": names[q], "id": ids[order.ravel()], "score": scores[q, order.ravel()]})
    return out[np.isfinite(out["score"])]


def union_of(parts: list[DataFrame], spark: SparkSession, kinds: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], kinds)
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def finite(embedding: Column | str) -> Column:
    return F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 20, block: int = 2048, mask: str | None = None, same: Callable[[object], object] = lambda q: q) -> DataFrame:
    """(query_id, id, score, rank): a stated query set against all other finite vectors, in blocks of queries.

    queries: (query_id, embedding, mask); vectors: (id, embedding, mask). Each block, of
    bounded size, goes to the executors once; a matrix product scores a batch of vectors
    against it, for each mask value (a subject, or a model of its own dimension) apart,
    and keeps the k best of each query in the batch, so at most k rows a query and batch
    are shuffled. A query does not find the vector whose id is same(query_id).
    """
    spark = queries.sparkSession
    masks = [mask] if mask else []
    asked = queries.where(finite("embedding"))
    clean = vectors.where(finite("embedding")).select("id", "embedding", *masks)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    hashed = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // block)))))
    parts = []
    for number in sorted(r["_block"] for r in hashed.select("_block").distinct().collect()):
        rows = hashed.where(F.col("_block") == number).select("query_id", "embedding", *masks).toPandas()
        groups = {value: (g["query_id"].to_numpy(), np.array([same(q) for q in g["query_id"]]), np.stack(g["embedding"]).astype(np.float64)) for value, g in (rows.groupby(mask) if mask else [(None, rows)])}
        shared = spark.sparkContext.broadcast(groups)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for value, part in batch.groupby(mask) if mask else [(None, batch)]:
                    if value in shared.value and len(part):
                        names, own, matrix = shared.value[value]
                        ids = part["id"].to_numpy()
                        scores = np.round(matrix @ np.stack(part["embedding"]).astype(np.float64).T, 6)
                        scores[own[:, None] == ids[None, :]] = -np.inf
                        yield best_of_batch(names, ids, scores, k)

        parts.append(clean.mapInPandas(run, kinds))
    return top_k(union_of(parts, spark, kinds), ["query_id"], k)


def embed(df: DataFrame, text_col: str, model: Callable[[list[str]], np.ndarray], into: str = "embedding") -> DataFrame:
    """df with a vector of length 1 of each text by a supplied model, a batch at a time; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.asarray(model(batch[text_col].fillna("").tolist()), np.float32).reshape(len(batch), -1)
            size = np.linalg.norm(found, axis=1, keepdims=True)
            yield batch.assign(**{into: list(found / np.where(size > 0, size, 1))})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, {into} array<float>")


def random_ranks(pairs: DataFrame, seed: int, query: str = "query_id", item: str = "id") -> DataFrame:
    """A seeded permutation rank (from 1) of each query's items; the same seed gives the same ranks."""
    key = F.md5(F.concat_ws("|", F.col(query).cast("string"), F.col(item).cast("string"), F.lit(str(seed))))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(key, item)))


def random_gold_ranks(pool: DataFrame, seeds: list[int]) -> DataFrame:
    """(seed, query_id, r): rank of each query's gold_id (null if it is not in the pool) in the permutations of random_ranks.

    pool: (query_id, id, gold_id). A rank is one more than the number of items before the gold: a count, without sorting the pool.
    """
    key = lambda item: F.md5(F.concat_ws("|", F.col("query_id").cast("string"), F.col(item).cast("string"), F.col("seed").cast("string")))
    drawn = pool.select("query_id", "id", "gold_id", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    before = F.struct(key("id"), "id") < F.struct(key("gold_id").alias("k"), F.col("gold_id").alias("i"))
    held = F.max((F.col("id") == F.col("gold_id")).cast("int")) == 1
    return drawn.groupBy("seed", "query_id").agg(F.when(held, F.count_if(before) + 1).alias("r"))


def combine(left: DataFrame, right: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The best k // 2 of one list and the rest of another, by score; columns that one lacks are null."""
    best = lambda df, n: df.orderBy(F.col("score").desc(), id_col).limit(n)
    return best(best(left, k // 2).unionByName(best(right, k - k // 2), allowMissingColumns=True), k)
