import datetime

import pytest
from pyspark.sql import functions as F

from quellwerk.functions import dates, naming, text
from quellwerk.functions.names import fold, fuzzy_ratio, indel_ratio, porter_stem
from quellwerk.operators.retrieval import grams_of


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, day",
    [
        ("Brief 03.07.2019.md", datetime.date(2019, 7, 3)),
        ("Brief 03.07.19.md", datetime.date(2019, 7, 3)),
        ("x 05.06.25.md", datetime.date(2025, 6, 5)),
        ("x 05.06.26.md", datetime.date(1926, 6, 5)),
        ("x 31.02.2020.md", None),
        ("Brief_03.07.2019.md", None),
        ("plain.md", None),
        (None, None),
    ],
)
def test_date_from_filename(spark, name, day):
    assert one(spark, dates.date_from_filename("f"), f=name) == day


@pytest.mark.parametrize(
    "name, kind", [("Flow Cytometry 1.md", "Flow cytometry"), ("flow.md", "Flow"), ("Pathologie.md", "Path"), ("Grad 2.md", "RAD"), ("Laborwerte.json", "labor"), ("foo.md", "Arztbrief"), (None, "Arztbrief")]
)
def test_report_type(spark, name, kind):
    assert one(spark, naming.report_type_of("f"), f=name) == kind


def test_safe_id(spark):
    assert one(spark, naming.safe_id("p", "f"), p="P1", f="a  b (c).md") == "P1_a_b__c_"


@pytest.mark.parametrize("value, grams", [("Ab  c!", ["ab_", "b_c"]), ("ab", ["ab"]), ("!!", []), (None, []), ("Öl-X", ["öl_", "l_x"]), ("", [])])
def test_char_grams(spark, value, grams):
    assert one(spark, text.char_grams("t"), t=value) == grams
    assert sorted(grams_of(value).elements()) == sorted(grams)


def test_words_split_at_unicode_blanks(spark):
    assert one(spark, text.word_count("t"), t="a\xa0b c  ") == 3
    assert one(spark, text.word_count("t"), t=None) == 0
    assert one(spark, text.word_count("t"), t=" \n") == 0


def test_birth_dates(spark):
    assert one(spark, dates.birth_date("t"), t="3.7.1960") == datetime.date(1960, 7, 3)
    assert one(spark, dates.birth_date("t"), t="1960-07-03") == datetime.date(1960, 7, 3)
    assert one(spark, dates.birth_date("t"), t="31-02-1960") is None
    assert one(spark, dates.german_text("t"), t="1960-07-03") == "03.07.1960"


def test_fuzzy_ratio(spark):
    assert indel_ratio("maria", "marie") == 80
    assert indel_ratio("anna", "anne") == 75
    assert round(indel_ratio("alexander", "alexandr"), 2) == 94.12
    assert one(spark, fuzzy_ratio("a", "b"), a="maria", b="marie") == 80
    assert one(spark, fuzzy_ratio("a", "b"), a=None, b="marie") is None


def test_fold(spark):
    assert one(spark, fold("t"), t=" Größe É ") == "groe e"
    assert one(spark, fold("t"), t=None) is None


def test_porter():
    words = "caresses ponies relational conditional hopping motoring happy adjustable formaliti triplicate probate controll".split()
    assert [porter_stem(w) for w in words] == "caress poni relat condit hop motor happi adjust formal triplic probat control".split()


def test_fts_terms():
    assert text.fts_query('Was ist der "Befund"?') == '"Was" OR "ist" OR "der" OR "Befund"'
    assert text.fts_query("Befund") == '"Befund"'
    assert text.fts_query("ab") == "ab"
    assert text.fts_query("ab cd") == "ab cd"


def test_tags_redaction_and_lines(spark):
    assert one(spark, text.phenomena_tags(F.col("a"), F.col("c")), a="12 mm", c="Kein Befund im Vergleich") == ["comparison", "negation", "numeric"]
    assert one(spark, text.phenomena_tags(F.col("a"), F.col("c")), a=None, c=None) == []
    assert one(spark, text.redact_patterns("a", ["a.c"]), a="abc a.c") == "abc ___"
    assert one(spark, text.clean_csv("a", 10), a=" x\r\ny " + "z" * 20) == "x y zzz..."
    assert one(spark, text.fenced_json("a"), a='```json\n[{"a": 1}]\n```') == '[{"a": 1}]'
    assert one(spark, text.highlight(F.col("a"), F.col("b")), a="vor eins zwei drei vier fuenf nach", b="eins zwei drei vier fuenf") == "vor <mark>eins zwei drei vier fuenf</mark> nach"
