import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quellwerk.functions import text as text_functions
from quellwerk.functions.names import indel_ratio

from quellwerk.operators import evaluate, items, linkage, ranks, retrieval, rows
from quellwerk.operators.sections import build_chunks, extract_sections, merge_small, overlap_windows
from quellwerk.plans import engine as search_engine
from quellwerk.plans.engine import Engine, SearchRequest
from quellwerk.sources import files
from quellwerk.streaming import sessions


def sections_of(spark, content):
    out = spark.createDataFrame([(content,)], "c string").select(extract_sections("c").alias("s")).first()["s"]
    return [(s["name"], s["body"]) for s in out]


@pytest.mark.parametrize(
    "content, expected",
    [
        ("pre\n## H: x\nbody\n## K foo\nz", [("H", "body"), ("K", "z")]),
        ("## A\n## B: q\ntext", [("B", "text")]),
        ("##\nName\nbody", [("Name", "body")]),
        ("## Only", []),
        ("### C d\nmore", [("#", "more")]),
        ("", []),
        (None, []),
    ],
)
def test_extract_sections(spark, content, expected):
    assert sections_of(spark, content) == expected


def python_merge(sizes, least=50):
    out, held, waiting = [], 0, False
    for i, n in enumerate(sizes):
        if not out:
            out, waiting, held = [i], n < least, n
        elif waiting:
            held += n
            waiting = held < least
        elif n >= least:
            out.append(i)
    return out


@pytest.mark.parametrize("sizes", [[10, 20, 60, 5], [60, 5, 70], [10], [60, 60], [], [5, 60, 60], [49, 1, 50, 3, 80]])
def test_merge_small(spark, sizes):
    found = [(f"N{i}", " ".join(["w"] * n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(found,)], "s array<struct<name: string, body: string>>")
    out = df.select(merge_small(F.col("s")).alias("m")).first()["m"]
    assert [s["name"] for s in out] == [f"N{i}" for i in python_merge(sizes)]
    assert sum(s["body"].split().count("w") for s in out) == sum(sizes)


@pytest.mark.parametrize("n, spans", [(0, 1), (350, 1), (351, 2), (650, 2), (700, 3)])
def test_overlap_windows(spark, n, spans):
    text = " ".join(f"w{i}" for i in range(n))
    out = spark.createDataFrame([(text,)], "t string").select(overlap_windows(F.col("t")).alias("x")).first()["x"]
    assert len(out) == spans
    if n == 700:
        assert [len(x.split()) for x in out] == [350, 350, 100]


def test_build_chunks_falls_back_and_skips(spark):
    data = [("r1", "P1", "Path", "plain text"), ("r2", "P1", "LABOR", "## A\nx"), ("r3", "P1", None, "## A\n" + "x " * 400), ("r4", "P1", "Path", " "), ("r5", "P1", "Path", None)]
    out = build_chunks(spark.createDataFrame(data, "report_id string, patient_id string, report_type string, content string")).orderBy("section_id").collect()
    assert [(r["report_id"], r["section_name"]) for r in out] == [("r1", "Full report"), ("r3", "A (part 1)"), ("r3", "A (part 2)")]
    assert [r["section_id"] for r in out][1] == "r3_sec_1000_A"


def test_rows(spark):
    df = spark.createDataFrame([("a", "x", "P1", 1), ("b", "x", "P1", 2), ("c", "x", "P2", 3), ("d", None, "P2", 4)], "id string, content string, owner string, t int")
    status = {r["id"]: r["status"] for r in rows.duplicate_status(df, "content", "owner", [F.col("t")]).collect()}
    assert status == {"a": "inserted", "b": "duplicate", "c": "conflict", "d": "skipped"}
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n"), (3, "m")], "k int, v string")
    assert sorted(map(tuple, rows.upsert(old, rows.latest(new, ["k"], [F.col("v")]), ["k"]).collect())) == [(1, "o"), (2, "n"), (3, "m")]
    assert sorted(map(tuple, rows.insert_new(old, new, ["k"], [F.col("v")]).collect())) == [(1, "o"), (2, "o"), (3, "m")]
    for wide_bytes in (0, 1 << 40):  # both ways give the same rows
        assert sorted(map(tuple, rows.latest(new.unionAll(spark.createDataFrame([(None, "x")], "k int, v string")), ["k"], [F.col("v").desc()], wide_bytes).collect())) == [(2, "n"), (3, "n")]


def test_unique_names_are_unique(spark):
    given = ["a", "a", "a_1", "a_1_x", "a_1", "a_1_1", "b", "b", "b", "b_2", "hot", None, None, *["hot"] * 500, "hot_7", "hot_400"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(given)], "n string, t int").repartition(6)
    out = {r["t"]: r["unique_name"] for r in rows.unique_names(df, "n", [F.col("t")]).collect()}
    kept = [v for v in out.values() if v is not None]
    assert len(out) == len(given) and len(set(kept)) == len(kept) == len(given) - 2
    assert [out[i] for i in range(10)] == ["a", "a_2", "a_1", "a_1_x", "a_1_2", "a_1_1", "b", "b_1", "b_3", "b_2"]
    assert out[10] == "hot" and out[13] == "hot_1" and "hot_502" in kept and "hot_503" not in kept


def test_checkpoints_need_a_shared_folder():
    from quellwerk import session

    class Cluster:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Unset:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        sparkContext = Cluster
        conf = Unset

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session)


def test_salted_rank_matches_plain_rank(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"))
    ranked = ranks.salted_rank(df, "g", "k", 64).collect()
    for g in ("hot", "cold"):
        keys = sorted((r["k"], r["rank"]) for r in ranked if r["g"] == g)
        assert [r for _, r in keys] == list(range(len(keys)))


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("d0", "abcd"), ("d1", "abce"), ("d2", None)], "id string, t string")
    index = retrieval.search_index(docs, "id", "t")
    for text, expected in (("bcd", {"d0": 0.693147}), ("abc", {"d0": 0.182322, "d1": 0.182322}), ("abcd", {"d0": 0.875469, "d1": 0.182322})):
        found = retrieval.bm25_search(index, spark.createDataFrame([(1, text)], "query_id int, text string"), 5)
        assert {r["id"]: r["score"] for r in found.collect()} == expected
    assert retrieval.bm25_search(index.limit(0), spark.createDataFrame([(1, "abc")], "query_id int, text string"), 5).count() == 0


WORDS = "milz niere leber hilus zyste rundherd befund gicht ödem ß".split()


def brute_bm25(docs, queries, count, own, floor):
    """{(query, id): score} over plain Python counters; a query meets documents of its group."""
    cut = {i: count(t) for i, _, t in docs}
    out = {}
    for q, g, text in queries:
        scope = [c for i, h, _ in docs if (not own or h == g) and (c := cut[i])]
        mean = sum(c.total() for c in scope) / max(1, len(scope))
        for i, h, _ in docs:
            if h == g and g is not None:
                score = 0.0
                for term in count(text).keys() & cut[i].keys():
                    df, tf = sum(term in c for c in scope), cut[i][term]
                    ratio = (len(scope) - df + 0.5) / (df + 0.5)
                    score += (max(math.log(ratio), 1e-6) if floor else math.log(ratio + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * cut[i].total() / mean))
                if score:
                    out[q, i] = round(score, 6)
    return out


@pytest.mark.parametrize("own, floor, words, block", [(False, False, False, 1000), (True, False, False, 7), (False, True, True, 1000), (True, True, True, 3)])
def test_block_search_by_brute_force(spark, own, floor, words, block):
    rng = random.Random(3)
    text = lambda n: None if rng.random() < 0.1 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    docs = [(f"d{i:03d}", rng.choice(["hot", "hot", "hot", "a", "b", None]), text(12)) for i in range(300)]
    queries = [(q, rng.choice(["hot", "a", "none", None]), text(5)) for q in range(20)]
    cut, count = (retrieval.cut_stems, retrieval.stems_of) if words else (retrieval.cut_grams, retrieval.grams_of)
    frame = spark.createDataFrame(docs, "id string, g string, t string").withColumn("codes", F.lit("clash"))
    index = retrieval.search_index(frame, "id", "t", cut, ("g",)).repartition(5)
    asked = spark.createDataFrame(queries, "query_id int, g string, text string")
    wanted = brute_bm25(docs, queries, count, own, floor)
    everything = retrieval.bm25_search(index, asked, None, cut, mask="g", own=own, floor=floor, block=block).collect()
    assert {(r["query_id"], r["id"]) for r in everything} == set(wanted) and all(abs(r["score"] - wanted[r["query_id"], r["id"]]) < 2e-6 for r in everything)
    best = retrieval.bm25_search(index, asked, 4, cut, mask="g", own=own, floor=floor, block=block)
    ranked = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.with_zero_scores(best, asked, frame.select("id", "g"), 4, "g").collect()}
    for q, g, _ in queries:
        pool = sorted(((-wanted.get((q, i), 0.0), i) for i, h, _ in docs if h == g and g is not None))[:4]
        assert [ranked.get((q, n)) for n in range(1, 5)][: len(pool)] == [i for _, i in pool] and (q, len(pool) + 1) not in ranked


@pytest.mark.parametrize("mask", [None, "g"])
def test_a_task_passes_on_the_best_only(spark, monkeypatch, mask):
    monkeypatch.setattr(retrieval, "_SCORES_AT_ONCE", 10)  # one document at a time, under k
    passed, top_k = [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda found, *a: passed.append(found) or top_k(found, *a))
    rng = random.Random(5)
    docs = [(f"d{i:03d}", "x", " ".join(rng.choice(WORDS) for _ in range(4)) if i % 3 else "milz leber") for i in range(90)]
    queries = [(q, "x", text) for q, text in enumerate(["milz", "leber milz", "gicht zyste", "hilus", "befund ödem"])]
    index = retrieval.search_index(spark.createDataFrame(docs, "id string, g string, t string").coalesce(1), "id", "t", keep=("g",))
    best = retrieval.bm25_search(index, spark.createDataFrame(queries, "query_id int, g string, text string"), 4, mask=mask).collect()
    wanted = brute_bm25(docs, queries, retrieval.grams_of, False, False)
    for q, _, _ in queries:
        first = sorted((-s, i) for (p, i), s in wanted.items() if p == q)[:4]  # many documents are equal, so ties reach past k
        assert [r["id"] for r in sorted(best, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in first]
    assert passed[0].count() <= 4 * len(queries)


def test_an_index_is_written_once_and_read_again(spark, tmp_path):
    docs = spark.createDataFrame([("d0", "abcd"), ("d1", "abce")], "id string, t string")
    index = retrieval.search_index(docs, "id", "t")
    index.write.parquet(str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "abcd")], "query_id int, text string")
    again = retrieval.bm25_search(spark.read.parquet(str(tmp_path / "index")), asked, 5)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, retrieval.bm25_search(index, asked, 5).collect()))


def test_an_index_holds_frequent_terms_in_full(spark):
    docs = [("d0", "x", "milz " * 400 + "leber"), ("d1", "x", "milz leber"), ("d2", "x", "leber " * 255), ("d3", "x", None)]
    queries = [(1, "x", "milz"), (2, "x", "leber zyste")]
    frame, asked = spark.createDataFrame(docs, "id string, g string, t string"), spark.createDataFrame(queries, "query_id int, g string, text string")
    for cut, count in ((retrieval.cut_grams, retrieval.grams_of), (retrieval.cut_stems, retrieval.stems_of)):
        only = retrieval.asked_terms(asked, "text", cut)
        assert len(only) == len(set().union(*(count(t) for _, _, t in queries))) and retrieval.asked_terms(asked, "text", cut, 1) is None
        full, part = (retrieval.search_index(frame, "id", "t", cut, ("g",), x) for x in (None, only))
        assert part.agg(F.sum(F.length("codes"))).first()[0] < full.agg(F.sum(F.length("codes"))).first()[0] or cut is retrieval.cut_stems
        for index in (full, part):
            found = {(r["query_id"], r["id"]): r["score"] for r in retrieval.bm25_search(index, asked, 4, cut).collect()}
            wanted = brute_bm25(docs, queries, count, False, False)
            assert set(found) == set(wanted) and all(abs(found[x] - wanted[x]) < 2e-6 for x in wanted)


def test_texts_of_sections_are_shuffled_once(spark, small):
    from quellwerk.plans import search, tables

    rows = tables.sections(spark, small, "section_content", even=True)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(str, rows.collect())) == sorted(map(str, tables.sections(spark, small, "section_content").collect()))
    assert search._section_index(spark, small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_grams_of_lists_equal_those_of_texts():
    texts = [None, "", "a", "Ab", "!!", "Öl-X", "a" * 700, "Ab  c!", "ßä", *("".join(random.Random(i).choices("aÄ ß-9_İ", k=i)) for i in range(40))]
    rows, codes, tfs, sizes = retrieval.cut_grams(texts)
    for i, text in enumerate(texts):
        found = retrieval.grams_of(text)
        assert sizes[i] == found.total() and sorted(tfs[rows == i]) == sorted(found.values())


def test_random_gold_ranks(spark):
    pool = spark.createDataFrame([(q, f"i{k}", f"i{q}") for q in range(3) for k in range(2, 30)], "query_id int, id string, gold_id string")
    got = {(r["seed"], r["query_id"]): r["r"] for r in retrieval.random_gold_ranks(pool, [1, 2]).collect()}
    for seed in (1, 2):
        wanted = {r["query_id"]: r["rank"] for r in retrieval.random_ranks(pool, seed).where("id = gold_id").collect()}
        assert {q: got[seed, q] for q in range(3)} == {q: wanted.get(q) for q in range(3)}


def test_dense_topk(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [float("nan"), 1.0]), (5, None)], "id int, embedding array<float>")
    asked = vectors.where("id = 1").withColumnRenamed("id", "query_id")
    for block in (1, 10):
        out = retrieval.dense_topk(asked, vectors, 2, block).orderBy("rank").collect()
        assert [(r["id"], r["score"]) for r in out] == [(2, 0.6), (3, 0.0)]


def test_metrics_by_hand(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    ranking = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False), (3, 4, True)], "query_id int, rank int, relevant boolean")
    m = evaluate.metrics(evaluate.judged(ranking, asked)).first()
    assert (m["queries"], m["queries_with_hit"], m["recall_1"], m["recall_5"], m["mrr"]) == (3, 2, 0.333333, 0.666667, 0.416667)
    assert m["ndcg_5"] == round((1 + 1 / math.log2(5)) / 3, 6) and m["ndcg_1"] == 0.333333


def test_validate(spark):
    text = "Befund ohne Auffälligkeit, 12 mm."
    cases = [
        ("Wie groß ist der im Text genannte Befund genau?", "numeric", "12 mm", 27, 32, [], []),
        ("Wie groß ist der im Text genannte Befund genau?", "numeric", "12 mm", 0, 5, [], ["substring_mismatch"]),
        ("Wie groß ist der im Text genannte Befund genau?", "numeric", "12 mm", 0, 99, [], ["offset_out_of_bounds"]),
        ("Wie groß ist der im Text genannte Befund genau?", "numeric", "12 mm", None, 5, [], ["invalid_offset_format"]),
        ("Wie groß ist der im Text genannte Befund genau?", "numeric", "12", 27, 29, [], ["answer_too_short"]),
        ("Wie groß ist der im Text genannte Befund genau?", "numeric", "ohne", 7, 11, [], ["numeric_type_no_numbers"]),
        ("Wie groß ist der genannte Befund genau?", "span", "12 mm", 27, 32, [], ["trivial_question", "question_too_short"]),
        (None, "x", None, 0, 0, None, ["empty_question", "invalid_answer_type", "trivial_question", "offset_out_of_bounds", "answer_too_short", "question_too_short"]),
    ]
    df = spark.createDataFrame([(i, *c[:6], "Befund", text) for i, c in enumerate(cases)], "i int, question string, answer_type string, answer_text string, start_char int, end_char int, phenomena array<string>, section_name string, section_content string")
    got = {r["i"]: r["errors"] for r in items.validate(df).collect()}
    for i, c in enumerate(cases):
        assert got[i] == c[6], (i, got[i])


def test_linkage(spark):
    roster = spark.createDataFrame([("P1", "anna", "berg", "1960-07-03"), ("P2", "otto", "hollberg", None), ("P3", "", "", None)], "patient_id string, first string, last string, dob string").withColumn("dob", F.col("dob").cast("date"))
    texts = spark.createDataFrame([("dob", "geb. 03.07.1960"), ("full", "von Anna Berg"), ("both", "Anna Berg 3.7.1960"), ("last", "von Karl Hollberg"), ("none", "nichts"), ("null", None)], "f string, t string")
    got = {r["file_id"]: (r["patient_id"], r["score"]) for r in linkage.best_matches(texts, roster, "f", "t").collect()}
    assert got["dob"] == ("P1", 1.0) and got["full"] == ("P1", 0.8) and got["both"] == ("P1", 1.5)
    assert got["last"] == ("P1", 0.5)  # berg stands inside hollberg, and the smaller id wins
    assert got["none"] == (None, 0.0) and got["null"] == (None, 0.0)


def test_linkage_finds_short_surnames_and_ties(spark):
    people = [("P3", "anna", "li", None), ("P2", "eva", "roth", "1960-07-03"), ("P1", "otto", "zimmer", "1960-07-03"), ("P4", "eva", "roth", "1961-01-01")]
    roster = spark.createDataFrame(people, "patient_id string, first string, last string, dob string").withColumn("dob", F.col("dob").cast("date"))
    texts = spark.createDataFrame([("short", "von Anna Li"), ("tie", "geb. 03.07.1960"), ("both", "Eva Roth, 03.07.1960"), ("other", "Eva Roth, 01.01.1961")], "f string, t string")
    assert {r["file_id"]: (r["patient_id"], r["score"]) for r in linkage.best_matches(texts, roster, "f", "t").collect()} == {"short": ("P3", 0.8), "tie": ("P1", 1.0), "both": ("P2", 1.5), "other": ("P4", 1.5)}


def test_linkage_by_brute_force(spark):
    rng = random.Random(7)
    firsts, lasts = ["anna", "annaa", "hannah", "maximiliane", "maximilianne", "maximilian", "", "karl heinz", "jo"], ["berg", "hollberg", "li", "roth", "", "rothberger"]
    dates = [f"19{y}-0{m}-03" for y in (60, 61) for m in (1, 2)]
    people = [(f"P{i:03d}", rng.choice(firsts), rng.choice(lasts), rng.choice([None, *dates])) for i in rng.sample(range(300), 120)]
    word = lambda: rng.choice(["Anna", "Annaa", "Berg", "Hollberg", "Li", "Roth", "Maximilianne", "Maximiliane", "Ulm", "Jo", "Rothbergers"])
    line = lambda: f"{word()} {word()} " if rng.random() < 0.7 else f"geb. 03.0{rng.choice('123')}.19{rng.choice(['60', '61'])} "
    texts = [(f"f{i}", "\n".join(line() for _ in range(rng.randrange(3)))) for i in range(150)]
    roster = spark.createDataFrame(people, "patient_id string, first string, last string, dob string").withColumn("dob", F.col("dob").cast("date"))
    files = spark.createDataFrame(texts, "f string, t string")
    signals = {r["file_id"]: (r["names"], [str(d) for d in r["dobs"]]) for r in linkage.signals(files, "f", "t").collect()}
    pairs = linkage.candidates(linkage.signals(files, "f", "t"), roster)
    assert pairs.count() < 12 * len(texts)  # a patient for each date or name, not all that share them
    got = {r["file_id"]: (r["patient_id"], r["score"]) for r in linkage.best_matches(files, roster, "f", "t").collect()}
    for f, (found, dobs) in signals.items():
        tokens = {t for n in found for t in n.split(" ")}
        best = (0.0, None)
        for p, first, last, dob in sorted(people):
            name = 0.8 if f"{first} {last}" in found else 0.5 + 0.3 * any(indel_ratio(t, first) >= 90 for t in tokens) if last and any(last in n for n in found) else 0.0
            score = round(min(1.5, (dob in dobs) + name), 6)
            best = (score, p) if score > best[0] else best
        assert got[f] == best[::-1], f


def test_linkage_reads_whole_files(spark):
    roster = spark.createDataFrame([("P1", "anna", "berg", "1960-07-03")], "patient_id string, first string, last string, dob string").withColumn("dob", F.col("dob").cast("date"))
    late = "\n".join(["zeile"] * 130)
    files = spark.createDataFrame([("date", "x", "a.md", late + "\ngeb. 03.07.1960"), ("name", "x", "a.md", late + "\nAnna Berg"), ("folder", "Anna Berg", "a.md", late), ("file", None, "RAD 03.07.1960.md", None)], "f string, d string, n string, t string")
    got = {r["file_id"]: r["score"] for r in linkage.best_matches(files, roster, "f", "t", ("d", "n")).collect()}
    assert got == {"date": 1.0, "name": 0.0, "folder": 0.8, "file": 1.0}  # names count in the first 120 lines only


def test_negatives_come_from_the_best_fifty(spark, monkeypatch):
    from quellwerk.plans import items as plans

    asked = spark.createDataFrame([(1, "5")], "query_id int, gold_id string")
    ranked = spark.createDataFrame([(1, str(i), 100.0 - i, i, i == 5) for i in range(1, 61)], "query_id int, id string, score double, rank int, relevant boolean")
    monkeypatch.setattr(plans, "_patient_ranking", lambda spark, sf_dir, k=20: (asked, ranked.where(F.col("rank") <= k)))
    monkeypatch.setattr(items, "hard_negatives", lambda pool, gold, pool_size=50: pool)
    assert {int(r["id"]) for r in plans.hard_negatives(spark, "").collect()} == set(range(1, 52)) - {5}


def test_rerank_lifts_from_the_best_hundred(spark, monkeypatch):
    from quellwerk.plans import items as plans

    asked = spark.createDataFrame([(1, "milz gross", "99")], "query_id int, question string, gold_id string")
    ranked = spark.createDataFrame([(1, str(i), i) for i in range(1, 121)], "query_id int, id string, rank int")
    texts = spark.createDataFrame([(str(i), "milz gross" if i in (99, 110) else "milz") for i in range(1, 121)], "section_id string, section_content string")
    monkeypatch.setattr(plans, "_patient_ranking", lambda spark, sf_dir, k=20: (asked, ranked.where(F.col("rank") <= k)))
    monkeypatch.setattr(plans, "sections", lambda spark, sf_dir, *columns: texts)
    got = [r["id"] for r in plans.rerank_topk(spark, "").orderBy("rank").collect()]
    assert got[0] == "99" and len(got) == 20 and "110" not in got


def test_csv_lines_keep_a_thousand_characters(spark, small):
    from quellwerk.plans.values import csv_lines

    lines = [r["line"] for r in csv_lines(spark, small).collect()]
    assert max(map(len, lines)) > 120 and not any(len(x) == 120 and x.endswith("...") for x in lines)


def test_word_search_asks_every_question(spark, small):
    from quellwerk.functions.text import fts_terms
    from quellwerk.plans import search

    got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 4)) for r in search.word_search_asked(spark, small).collect()}
    docs = search.sections(spark, small, "section_content", "report_type", "report_date")
    asked = search.asked_items(spark, small).select("query_id", "question").collect()
    rows = [(r["section_id"], "", r["section_content"]) for r in docs.collect()]
    kept = {r["section_id"] for r in docs.where(search._SEC_WHERE).collect()}
    questions = [(r["query_id"], "", " ".join(fts_terms(r["question"] or ""))) for r in asked]
    scored = brute_bm25(rows, questions, retrieval.stems_of, False, True)
    wanted = {}
    for q, _, _ in questions:
        best = sorted((-s, i) for (x, i), s in scored.items() if x == q and i in kept)[:20]
        wanted |= {(q, n): (i, round(-s, 4)) for n, (s, i) in enumerate(best, 1)}
    assert len({q for q, _ in got}) > 1 and got == wanted


def test_engine(spark):
    people = spark.createDataFrame([("P1", "Anna", "Berg", "Anna Berg", "1960-07-03")], "patient_id string, firstname string, lastname string, fullname string, dob string")
    reps = spark.createDataFrame([("r1", "P1", "RAD", "2020-01-01", "Die Milz ist groß")], "report_id string, patient_id string, report_type string, report_date string, content string")
    secs = spark.createDataFrame([("s1", "P1", "Befund", "RAD", None, "Die Milz ist groß"), ("s2", "P1", "Befund", "RAD", "2020-01-01", "Leber klein")], "section_id string, patient_id string, section_name string, report_type string, report_date string, section_content string")
    engine = Engine(spark, people, reps, secs)
    assert {r["id"] for r in engine.search(SearchRequest("Milz")).collect()} == {"r1", "s1"}
    assert engine.search_sections(SearchRequest("Milz", date_from="2019-01-01")).count() == 0
    assert engine.directory("03.07.1960").count() == 1 and engine.directory("zzz").count() == 0
    assert engine.report("r1").count() == 1 and engine.health()["status"] == "ok"


def test_engine_stems(spark):
    secs = spark.createDataFrame([("s1", "P1", "wegen des Bereichs"), ("s2", "P1", "im Bereich"), ("s3", "P1", "Leber klein")], "section_id string, patient_id string, section_content string")
    engine = Engine(spark, None, None, secs)
    assert {r["id"] for r in engine.search_sections(SearchRequest("Bereich")).collect()} == {"s1", "s2"} == {r["id"] for r in engine.search_sections(SearchRequest("Bereichs")).collect()}


def test_sources(spark, tmp_path):
    (tmp_path / "P1" / "sub").mkdir(parents=True)
    (tmp_path / "_skip").mkdir()
    (tmp_path / "P1" / "Brief 03.07.2019.md").write_text("## A\nText")
    (tmp_path / "P1" / "sub" / "Labor.json").write_text('{"a": 1}')
    (tmp_path / "P1" / "copy.md").write_text("## A\nText")
    (tmp_path / "P1" / "blank.md").write_text(" \n")
    (tmp_path / "_skip" / "x.md").write_text("x")
    (tmp_path / "roster.csv").write_text(" id ,firstname,name,birthdate\nP1, Anna ,Berg,03.07.1960\nP1,Anne,Berg,\n")
    roster = files.read_roster(spark, str(tmp_path / "roster.csv"))
    assert [r["fullname"] for r in roster.collect()] == ["Anne Berg"]
    reports, statuses = files.ingest(files.scan_reports(spark, str(tmp_path)), roster)
    assert sorted(r["status"] for r in statuses.collect()) == ["duplicate", "inserted", "inserted"]
    assert {r["report_type"] for r in reports.collect()} == {"Arztbrief", "labor"}


def test_session_stream(spark, tmp_path):
    entry = {"timestamp": "2024-01-01T10:00:00", "session_id": "s", "query": {"question": "a\nb", "settings": {"k": 5, "docTypes": ["x", "y"]}}, "results": {"sources": [{"patient_id": "P1"}, {"patient_id": "P1"}, {"patient_id": "P2"}]}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(entry) + "\n")
    run = sessions.flatten_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    run.awaitTermination()
    row = spark.read.csv(str(tmp_path / "out"), header=True).first()
    assert (row["question"], row["k"], row["doc_types"], row["patient_id"]) == ("a b", "5", "x,y", None)
    assert sessions.hits_by_patient(files.read_sessions(spark, str(tmp_path / "in"))).first()["distribution"] == {"P1": 2, "P2": 1}
    assert len(sessions.flatten(files.read_sessions(spark, str(tmp_path / "in"))).columns) == 20


def test_fallback_finds_patients_without_long_sections(spark, monkeypatch):
    from quellwerk.plans import answers, search

    secs = spark.createDataFrame([("s1", "P1", "Die Milz ist normal groß, ohne Befund, ohne Nachweis einer Zyste."), ("s2", "P2", "Milzen klein"), ("s3", "P2", "Leber")], "section_id string, patient_id string, section_content string")
    asked = spark.createDataFrame([(1, "s1", "Milz?", "P1"), (2, "s2", "Milzen?", "P2"), (3, "x", "Milz?", None)], "query_id bigint, gold_id string, question string, patient_id string")
    for module in (answers, search):
        monkeypatch.setattr(module, "sections", lambda spark, sf_dir, *columns: secs)
        monkeypatch.setattr(module, "asked_items", lambda spark, sf_dir: asked)
    got = sorted((r["query_id"], r["id"], r["method"]) for r in answers.search_with_fallback(spark, "").collect())
    assert got == [(1, "s1", "bm25_char3gram"), (2, "s2", "full_text_search")]


def test_generation_retries_waits_and_cuts(spark, monkeypatch):
    waits = []
    monkeypatch.setattr(items.time, "sleep", waits.append)
    calls = {"n": 0}

    def flaky(text):
        calls["n"] += 1
        if "never" in text or calls["n"] == 1:
            raise RuntimeError("busy")
        return '[{"q": 1}, {"q": 2}, {"q": 3}]'

    chunks = pd.DataFrame({"section_id": ["a", "b"], "section_content": ["x", "never"]})

    class Frame:
        select = staticmethod(lambda *columns: Frame)
        mapInPandas = staticmethod(lambda run, kinds: pd.concat(run(iter([chunks]))))

    out = items.generate(Frame, flaky, delay=2.0, most=2)
    assert [None if pd.isna(x) else json.loads(x) for x in out["raw"]] == [[{"q": 1}, {"q": 2}], None]
    assert len(waits) == 3 and all(1.5 <= w <= 2.5 for w in waits)


def test_generation_runs_on_frames(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", None)], "section_id string, section_content string")
    assert {r["section_id"]: r["raw"] for r in items.generate(chunks, lambda t: f"<{t}>", delay=0.0).collect()} == {"a": "<x>", "b": "<None>"}


def test_embed_and_masked_dense_search(spark):
    docs = spark.createDataFrame([(1, "aab", "m"), (2, "ab", "m"), (3, None, "m"), (4, "b", "n")], "id int, t string, g string")
    found = retrieval.embed(docs, "t", lambda texts: np.array([[x.count("a"), x.count("b")] for x in texts]))
    vectors = {r["id"]: list(r["embedding"]) for r in found.collect()}
    assert vectors[2] == pytest.approx([0.5**0.5] * 2) and vectors[3] == [0.0, 0.0]
    rows_found = retrieval.dense_topk(found.where("id = 1").withColumnRenamed("id", "query_id"), found, 5, mask="g").orderBy("rank").collect()
    assert [r["id"] for r in rows_found] == [2, 3] and retrieval.dense_topk(found.limit(0).withColumnRenamed("id", "query_id"), found, 5, mask="g").count() == 0


def test_json_items(spark):
    texts = ['[{"q": "a"}, 1, "x", {"q": "b"}]', '{"q": "c"}', "7", "nichts", None, "[]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text_functions.json_items("t", "q string").alias("x")).collect()
    assert [[i["q"] for i in r["x"]] for r in got] == [["a", "b"], ["c"], [], [], [], []]


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("f1", "move+rename", "P1", "/x/a b.md", "2020-01-01", "Arztbriefe"), ("f2", "move+rename", "P1", "/x/c (RAD).md", "2020-01-01", "Arztbriefe"), ("f3", "skip", "P1", "/x/d.md", "", "Arztbriefe"), ("f4", "move+rename", "P2", "/x/e.md", "", "anders")], "source string, action string, patient_id string, new_path string, date string, folder_prefix string")
    path = files.write_audit(df, str(tmp_path), "20240101_120000")
    assert path.endswith("audit_20240101_120000")
    assert sorted(r["target"] for r in files.rename_plan(files.read_audit(spark, path)).collect()) == ["a b (Arztbrief).md", "e (Unknown).md"]
    files.write_metrics(spark.createDataFrame([(0.5, 3)], "recall_10 double, queries int"), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first()["recall_10"] == 0.5
    files.append_json(df.select("source"), str(tmp_path / "log"))
    files.append_json(df.select("source"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 8
    assert {r["size"] > 0 for r in files.log_files(spark, str(tmp_path / "log")).collect()} == {True}
    files.write_rebuilt(df, str(tmp_path / "t"), "source")
    files.write_rebuilt(df.limit(1), str(tmp_path / "t"), "source")
    df.createOrReplaceTempView("known")
    assert {k: v.count() for k, v in files.read_tables(spark, {"a": "known", "b": "attached.known", "c": str(tmp_path / "t")}).items()} == {"a": 4, "b": 4, "c": 1}
    assert files.preview(spark, "known", 2).count() == 2
    with pytest.raises(ValueError):
        files.preview(spark, "unknown")
    assert files.browse(spark, "SELECT * FROM {t}", {"t": df}, 3).count() == 3
    (tmp_path / "roster.csv").write_text("id,name\nP1,Berg\n")
    with pytest.raises(ValueError, match="birthdate"):
        files.read_roster(spark, str(tmp_path / "roster.csv"), ("firstname", "name", "birthdate"))
    long = files.embeddings_long(spark.createDataFrame([("s", [1.0, 0.0], [float("nan")])], "section_id string, embedding_a array<double>, embedding_b array<double>"))
    assert [(r["section_id"], r["model"]) for r in long.collect()] == [("s", "a")]
    assert rows.exists(df, F.col("source") == "f1") and not rows.exists(df, F.col("source") == "f9")


def test_answers_have_a_status_and_are_logged(spark, tmp_path):
    secs = spark.createDataFrame([("s1", "P1", "Die Milz ist groß")], "section_id string, patient_id string, section_content string")
    engine = Engine(spark, None, secs.withColumnsRenamed({"section_id": "report_id", "section_content": "content"}), secs)
    asked = []
    ask = lambda prompt: asked.append(prompt) or "Antwort"
    out = engine.answer(SearchRequest("Milz", level="sections"), ask, "{context} // {question}")
    assert (out["status"], out["cited"], out["text"]) == ("ok", ["s1"], "Antwort") and "Milz" in asked[0] and out["latency"]["total"] >= 0
    assert engine.answer(SearchRequest("Niere", level="sections"), ask, "{context}", "leer: {question}")["status"] == "insufficient" and asked[-1] == "leer: Niere"
    assert engine.answer(SearchRequest("Milz", level="sections"), lambda p: 1 / 0, "{context}")["status"] == "error"
    with pytest.raises(ValueError):
        engine.search(SearchRequest("Milz", level="pages"))
    entry = {"timestamp": "2024-01-01T10:00:00", "session_id": "s"}
    (tmp_path / "in.json").write_text(json.dumps(entry))
    engine.log(files.read_sessions(spark, str(tmp_path / "in.json")), str(tmp_path / "out"))
    assert engine.sessions(str(tmp_path / "out")).first()["session_id"] == "s" and spark.read.csv(str(tmp_path / "out" / "csv"), header=True).count() == 1
    assert search_engine.answer_prompt("{context}-{question}", F.lit("c"), F.lit("q")) is not None and search_engine.index_version("combined", 5, True) == "quellwerk-combined-5-group"


def test_question_rate_with_late_entries(spark):
    entries = spark.createDataFrame([("2024-01-01T10:01:00",), ("2024-01-01T10:09:00",), ("2024-01-01T10:11:00",), ("kein Datum",), (None,)], "timestamp string")
    got = {str(r["start"])[11:16]: r["questions"] for r in sessions.question_rate(entries).collect() if r["start"]}
    assert got == {"10:00": 2, "10:10": 1}


def test_command_line(spark, small, tmp_path, monkeypatch):
    import quellwerk.__main__ as command

    monkeypatch.setattr(command, "build_session", lambda: spark)
    command.main(["table_counts", small, str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_review_filter_and_pending(spark):
    df = spark.createDataFrame([(1, 0.9, "Anna RAD", None, "Berg"), (2, 0.9, None, None, "Berg"), (3, 0.1, "RAD", "x", "Berg"), (4, 0.9, "rad", "x", None)], "id int, score double, a string, b string, n string")
    assert [r["id"] for r in rows.review_filter(df, "score", 0.5, "R.D", ["a", "b"], "n", "BER").collect()] == [1]
    assert [r["id"] for r in rows.pending(df, df.where("id = 1"), df.where("id in (2, 3)"), "id").collect()] == [4]
