"""Operators on DataFrames: brute force, and nulls, empty tables, repeats, ties, hot groups, clashing columns."""

import collections
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quellwerk.llm")

from quellwerk.llm import encoding, neighbours, packing, pairs, personal, pieces, sentences, splits  # noqa: E402

RNG = random.Random(5)
TEXTS = [(1, None), (2, ""), (3, " "), (4, "Ein Satz. Noch einer."), (4, "Ein Satz. Noch einer."), (None, "x"), (5, "wort " * 2000)]


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    return df.withColumns({"ids": F.lit(1), "n_tokens": F.lit("x"), "length": F.lit(0), "class": F.lit(2), "band": F.lit(3), "piece": F.lit(4)})


def test_encoding_frames(spark, documents):
    rows = encoding.encode_corpus(documents, offsets=True).collect()
    assert len(rows) == len(TEXTS)
    assert [r["ids"] for r in rows if r["doc_id"] in (1, 2)] == [[], []]
    assert all(len(r["ids"]) == len(r["char_starts"]) for r in rows)
    decoded = {r["doc_id"]: r["text"] for r in encoding.decode_ids(encoding.encode_corpus(documents)).collect()}
    assert decoded[4] == "Ein Satz. Noch einer." and decoded[1] == ""
    assert encoding.encode_corpus(documents.limit(0)).count() == 0


def test_packing_frames(spark):
    sizes = [(i, RNG.choice([None, 0, 7, 7, 7, 30, 64, 100, 150])) for i in range(600)]
    lengths = spark.createDataFrame(sizes, "doc_id bigint, n_tokens int")
    rows = packing.pack(lengths, 64, 4).collect()
    used, tokens = collections.Counter(), collections.Counter()
    for r in rows:
        used[r["container_id"]] += r["end_token"] - r["start_token"]
        tokens[r["doc_id"]] += r["end_token"] - r["start_token"]
    assert max(used.values()) <= 64
    assert tokens == collections.Counter({i: n for i, n in sizes if n})
    assert {r["doc_id"] for r in rows if r["pieces"] > 1} == {i for i, n in sizes if n and n > 64}
    assert packing.pack(lengths.limit(0), 64).count() == 0


def test_pieces_frames(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "w " * 350), ("d", "w " * 351), ("d", "w " * 351)], "k string, text string").withColumn("piece", F.lit(1))
    rows = pieces.split_oversized(df, ["k"], "text").collect()
    assert {r["k"] for r in rows} == {"d"} and all(r["word_count"] <= 350 for r in rows)


def test_sentences_frames(documents):
    rows = sentences.sentences(documents).collect()
    assert sorted((r["start_char"], r["end_char"]) for r in rows if r["doc_id"] == 4) == [(0, 9), (0, 9), (10, 21), (10, 21)]
    assert not [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert sentences.sentences(documents.limit(0)).count() == 0


def test_personal_frames(spark):
    df = spark.createDataFrame([("a", "Herr Wolbrink kam."), ("b", None), ("c", "")], "k string, text string").withColumn("start_char", F.lit(1))
    assert [(r["k"], r["pii_type"]) for r in personal.find_personal(df, ["k"], "text").collect()] == [("a", "name")]
    assert {r["k"]: r["text"] for r in personal.redact(df, "text").collect()} == {"a": "Herr [NAME] kam.", "b": None, "c": ""}


def test_pairs_frames(spark):
    inside = [(i, "Was gilt für den Befund?", f"Nachweis von Zyste Nr. {i} am Hilus unverändert.") for i in range(30)]
    extra = [(100, "Was gilt?", "Nachweis von Zyste Nr. 3 am Hi"), (101, "Was gilt?", "Nachweis von Zyste Nr. 3 am Hilus unverändert"), (102, None, None), (102, None, None), (None, "a", None)]
    df = spark.createDataFrame(inside + extra, "qa_id bigint, question string, answer_text string").withColumn("tail", F.lit("x"))
    assert sorted(map(tuple, pairs.defective_pairs(df).collect())) == [(100, "truncated"), (102, "empty")]
    assert pairs.defective_pairs(df.limit(0)).count() == 0


def test_words_of_any_length_are_beginnings(spark):
    long = "x" * 60
    words = spark.createDataFrame([("hilus",), ("hilfe",), (long + "ab",), (long + "c",), (long,)], "word string")
    tails = spark.createDataFrame([("hi", "a"), ("hi", "b"), ("hu", "a"), (long, "a"), (long + "a", "a"), (long + "b", "a"), (long + "c", "a")], "tail string, before string")
    assert sorted(r["tail"] for r in pairs.word_starts(tails, words).collect()) == sorted(["hi", long, long + "a"])


def test_open_words_are_judged_by_rates(spark):
    def found(copies, ended):
        inside = [(i, "Wie war es?", f"Zyste Nr. {i} mit flauer Kontur am Hilus.") for i in range(copies)]
        ends = [(10_000 + i, "Wie war es?", "Schnittfläche breit und flauer.") for i in range(ended)]
        rows = [*inside, *ends, (99_999, "Wie war es?", "Präparat aus Segment VI, Rand mit flauer")]
        return (99_999, "truncated") in [tuple(r) for r in pairs.defective_pairs(spark.createDataFrame(rows, "qa_id bigint, question string, answer_text string")).collect()]

    assert found(60, 0) and found(600, 1) and not found(60, 60)  # one end among many uses does not switch the rule off


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    by_record = collections.defaultdict(list)
    for record, entity in edges:
        if record is not None and entity is not None:
            by_record[record].append(entity)
    for group in by_record.values():
        for other in group[1:]:
            a, b = find(group[0]), find(other)
            parent[max(a, b)] = min(a, b)
    return {e: find(e) for group in by_record.values() for e in group}


def test_label_propagation_is_connected_components(spark):
    chain = [(f"c{i}", e) for i in range(40) for e in (1000 - i, 999 - i)]
    loose = [(f"r{RNG.randrange(60)}", RNG.randrange(120)) for _ in range(120)]
    edges = [*chain, *chain[:3], *loose, (None, 5), ("x", None)]
    got = {r["entity"]: r["label"] for r in splits.propagate_labels(spark.createDataFrame(edges, "record string, entity bigint")).collect()}
    for entity, label in components(edges).items():
        assert got.get(entity, entity) == label
    assert splits.propagate_labels(spark.createDataFrame([], "record string, entity bigint")).count() == 0


def test_assignment_keeps_groups_and_shares(spark):
    records = [(0 if i % 3 == 0 else i // 2, "ab"[i % 2]) for i in range(9000)]
    out = splits.assign_groups(spark.createDataFrame(records, "label bigint, stratum string"), {"train": 0.6, "valid": 0.2, "test": 0.2}).collect()
    assert len({r["group"] for r in out}) == len(out) and sum(r["records"] for r in out) == 9000
    share = collections.Counter()
    for r in out:
        share[r["split_name"]] += r["records"] / 9000
    assert abs(share["train"] - 0.6) < 0.02 and abs(share["valid"] - 0.2) < 0.02


def texts_with_copies():
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(40):
        base = [RNG.choice(words) for _ in range(60)]
        out.append(" ".join(base))
        for edits in (1, 4, 25):
            other = base[:]
            for _ in range(edits):
                other[RNG.randrange(60)] = RNG.choice(words)
            out.append(" ".join(other))
    out += [out[0]] * 30 + ["a b", "", None, " "]  # a hot group of copies
    return [(f"r{i:03d}", t) for i, t in enumerate(out)]


@pytest.mark.parametrize("wide_band", [64, 1])
def test_near_duplicates_by_brute_force(spark, wide_band):
    data = texts_with_copies()
    df = spark.createDataFrame([*data, data[0]], "report_id string, content string").withColumn("n", F.lit("clash")).withColumn("bands", F.lit(0))
    members, links = neighbours.near_duplicates(df, "report_id", "content", 3, 0.7, wide_band)
    group = {r["id"]: bytes(r["class"]) for r in members.collect()}
    linked = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in links.collect()}
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, t in data if t and len(t.split()) > 2}
    assert set(group) == set(sets)
    for a in sets:
        for b in sets:
            if a < b:
                alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                assert (group[a] == group[b] or frozenset((group[a], group[b])) in linked) == (alike >= 0.7), (a, b, alike)
    assert neighbours.near_duplicates(df.limit(0), "report_id", "content")[1].count() == 0


def test_every_query_runs(spark, small):
    from quellwerk.llm.queries import QUERIES

    for name, query in QUERIES.items():
        frame = query(spark, small)
        assert frame.distinct().count() == frame.count(), name
