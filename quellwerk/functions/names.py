"""Name folding, fuzzy ratio and stemming: the few functions that need Python, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition, ASCII only, lower case, stripped; null stays null."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower().strip())


@F.pandas_udf(StringType())
def compose(texts: pd.Series) -> pd.Series:
    """Compatibility composition, stripped."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).strip())


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit vector row a character."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        match = row & where.get(c, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 for equal texts, less by insertions and deletions relative to the total length."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_subsequence(a, b) / total


@F.pandas_udf(DoubleType())
def fuzzy_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else indel_ratio(a, b) for a, b in zip(left, right)], dtype="float64")


# Suffix rules of the published Porter algorithm, steps 2 to 4.
STEP_2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _consonants(word: str) -> list[bool]:
    kinds: list[bool] = []
    for i, c in enumerate(word):
        kinds.append(c not in "aeiou" and not (c == "y" and i > 0 and kinds[i - 1]))
    return kinds


def _measure(stem: str) -> int:
    kinds = _consonants(stem)
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _short_end(word: str) -> bool:
    kinds = _consonants(word)
    return len(word) >= 3 and kinds[-1] and not kinds[-2] and kinds[-3] and word[-1] not in "wxy"


def _replace(word: str, rules: dict[str, str], least: int) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) > least else word
    return word


def porter_stem(word: str) -> str:
    """Stem of a lower-case word by the published Porter algorithm."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and not all(_consonants(stem)):
                if stem.endswith(("at", "bl", "iz")):
                    stem += "e"
                elif len(stem) > 1 and stem[-1] == stem[-2] and _consonants(stem)[-1] and stem[-1] not in "lsz":
                    stem = stem[:-1]
                elif _measure(stem) == 1 and _short_end(stem):
                    stem += "e"
                word = stem
                break
    if word.endswith("y") and not all(_consonants(word[:-1])):
        word = word[:-1] + "i"
    word = _replace(word, dict(zip(STEP_2[::2], STEP_2[1::2])), 0)
    word = _replace(word, STEP_3, 0)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else porter_stem(w))
