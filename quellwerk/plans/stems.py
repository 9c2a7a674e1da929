"""SQL that stems words by the published Porter algorithm, for the queries that check stemmed searches."""

from __future__ import annotations

# Suffix rules of the published algorithm (suffix, replacement), longest suffix first.
SECOND = [("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e")]
THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
FOURTH = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _forms(x: str) -> str:
    """x with each y that follows a consonant written as a vowel."""
    return f"regexp_replace({x}, '([^aeiouy])y', '\\1i', 'g')"


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_forms(x)}, '[aeiou]+[^aeiou]+'))"


def _vowel(x: str) -> str:
    return f"regexp_matches({_forms(x)}, '[aeiou]')"


def _short_end(x: str) -> str:
    return f"regexp_matches({_forms(x)}, '[^aeiou][aeiou][^aeiouwxy]$')"


def _cut(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def _mended(x: str) -> str:
    """A stem after -ed or -ing was cut off."""
    return f"""CASE WHEN regexp_matches({x}, '(at|bl|iz)$') THEN {x} || 'e' WHEN length({x}) > 1 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) AND regexp_matches({_forms(x)}, '[^aeioulsz]$') THEN {_cut(x, 1)}
        WHEN {_measure(x)} = 1 AND {_short_end(x)} THEN {x} || 'e' ELSE {x} END"""


def _rules(x: str, rules: list[tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN suffix({x}, '{old}') THEN CASE WHEN {_measure(_cut(x, len(old)))} > 0 THEN {_cut(x, len(old))} || '{new}' ELSE {x} END" for old, new in rules)
    return f"CASE {cases} ELSE {x} END"


def sql_stems(words: str, name: str) -> str:
    """Common table expressions that end in `name` (w, stem); words: a query of distinct lower-case words w."""
    fourth = " ".join(
        f"WHEN suffix(x, '{old}') THEN CASE WHEN {_measure(_cut('x', len(old)))} > 1{' AND regexp_matches(' + _cut('x', 3) + ', $$[st]$$$)' if old == 'ion' else ''} THEN {_cut('x', len(old))} ELSE x END" for old in FOURTH
    ).replace("$$[st]$$$", "'[st]$'")
    steps = [
        f"CASE WHEN suffix(x, 'sses') OR suffix(x, 'ies') THEN {_cut('x', 2)} WHEN suffix(x, 's') AND NOT suffix(x, 'ss') THEN {_cut('x', 1)} ELSE x END",
        f"CASE WHEN suffix(x, 'eed') THEN CASE WHEN {_measure(_cut('x', 3))} > 0 THEN {_cut('x', 1)} ELSE x END WHEN suffix(x, 'ed') AND {_vowel(_cut('x', 2))} THEN {_mended(_cut('x', 2))} WHEN suffix(x, 'ing') AND {_vowel(_cut('x', 3))} THEN {_mended(_cut('x', 3))} ELSE x END",
        f"CASE WHEN suffix(x, 'y') AND {_vowel(_cut('x', 1))} THEN {_cut('x', 1)} || 'i' ELSE x END",
        _rules("x", SECOND),
        _rules("x", THIRD),
        f"CASE {fourth} ELSE x END",
        f"CASE WHEN suffix(x, 'e') AND ({_measure(_cut('x', 1))} > 1 OR ({_measure(_cut('x', 1))} = 1 AND NOT {_short_end(_cut('x', 1))})) THEN {_cut('x', 1)} ELSE x END",
        f"CASE WHEN suffix(x, 'll') AND {_measure('x')} > 1 THEN {_cut('x', 1)} ELSE x END",
    ]
    out = [f"{name}_0 AS MATERIALIZED (SELECT w, w AS x FROM ({words}))"]
    for i, step in enumerate(steps):
        out.append(f"{name}_{i + 1} AS MATERIALIZED (SELECT w, CASE WHEN length(w) <= 2 THEN w ELSE {step} END AS x FROM {name}_{i})")
    return ", ".join([*out, f"{name} AS MATERIALIZED (SELECT w, x AS stem FROM {name}_{len(steps)})"])
