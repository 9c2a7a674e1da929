"""Functions on single texts, against other implementations, brute force or stated cases."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("quellwerk.llm")

from quellwerk.llm import encoding, neighbours, packing, pairs, personal, pieces, sentences  # noqa: E402

RNG = random.Random(7)


@pytest.fixture(scope="module")
def reference_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_encoding_equals_the_public_library(reference_tokenizer):
    merger = encoding.encoder(encoding.vocabulary_bytes())
    texts = ["", " ", "\n", "don't we'll I've", "'s's ''s it's 's", "<|endoftext|> ok", "日本語。テスト", "é​ 😷", "a" * 3000, "x  \n\n  y\t'd"]
    texts += ["".join(RNG.choice("'''srtevlmd aA1 \n\t.ä日") for _ in range(RNG.randint(1, 40))) for _ in range(800)]
    wanted = [e.ids for e in reference_tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, edge, _, _ = encoding.encode_block(texts, merger)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(edge)] == wanted


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_encoding_round_trip(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    merger = encoding.encoder(encoding.vocabulary_bytes())
    back = {rank: raw for raw, rank in merger.ranks.items()}
    ids, edge, _, _ = encoding.encode_block(texts, merger)
    assert [b"".join(back[i] for i in ids[a:b].tolist()).decode() for a, b in itertools.pairwise(edge)] == texts


def test_plan_uses_exactly_the_histogram():
    lengths = np.clip(np.random.default_rng(1).lognormal(4, 1, 20_000).astype(int), 1, 512)
    for histogram in (np.bincount(lengths, minlength=513), np.zeros(513), np.eye(513)[512] * 9, np.eye(513)[1] * 1000):
        plan = packing.plan_containers(histogram, 512, 8)
        used = np.zeros(513)
        for times, parts in plan:
            assert sum(length * copies for length, copies in parts) <= 512
            for length, copies in parts:
                used[length] += times * copies
        assert (used == histogram).all()


def test_least_squares_fill_most_containers_and_no_more_than_greedy():
    rng = np.random.default_rng(1)
    for size, capacity in ((20_000, 512), (400_000, 512), (20_000, 2048)):
        lengths = np.clip(rng.lognormal(np.log(capacity) - 2, 0.9, size).astype(int), 1, capacity)
        histogram = np.bincount(lengths, minlength=capacity + 1)
        _, _, counts, residual = packing.least_squares(histogram, capacity, 0)
        assert residual < 0.1 and (counts > 0).all()
        fitted = packing.plan_containers(histogram, capacity)
        greedy = sum(times for times, _ in packing.plan_containers(histogram, capacity, fit=False))
        total = sum(times for times, _ in fitted)
        whole = sum(times for times, parts in fitted if sum(length * copies for length, copies in parts) == capacity and len(parts) <= 4)
        assert total <= greedy and whole > 0.9 * total


def text_of(kinds: str) -> str:
    """w: word, s: word that ends a sentence, p: paragraph break, l: list entry."""
    out = {"w": "wort ", "s": "Ende. ", "p": "\n\n", "l": "\n- "}
    return "Wort " + "".join(out[k] for k in kinds)


@settings(max_examples=40, deadline=None)
@given(st.text("wwwwwwwwspl", min_size=80, max_size=400))
def test_pieces_cover_in_order_within_the_limit(kinds):
    text = text_of(kinds)
    spans = pieces.word_spans(text)
    cut = pieces.cut_text(text, 40, 6)
    if len(spans) <= 40:
        assert cut == []
        return
    first, last = {a: i for i, (a, _) in enumerate(spans)}, {b: i for i, (_, b) in enumerate(spans, 1)}
    ranges = [(first[a], last[b]) for a, b, _ in cut]
    assert ranges[0][0] == 0 and ranges[-1][1] == len(spans)
    assert all(b - a <= 40 and words == b - a for (a, b), (_, _, words) in zip(ranges, cut))
    assert all(0 <= b - c <= 6 and b < d for (_, b), (c, d) in itertools.pairwise(ranges))


def total_cost(kinds: np.ndarray, cuts: list[int], limit: int, overlap: int) -> float:
    """Cost of a chain of cuts as the dynamic program counts it; infinite if a piece is too long."""
    n, start, cost = len(kinds), 0, 0.0
    count = max(2, -(-(n - overlap) // (limit - overlap)))
    target = (n + (count - 1) * overlap) / count
    for cut in [*cuts, n]:
        size = cut - start
        if size > limit:
            return float("inf")
        cost += pieces.SIZE_WEIGHT * ((size - target) / target) ** 2
        if cut < n:
            starts, start_cost = pieces.best_starts(kinds, np.array([cut]), overlap)
            cost += pieces.PENALTY[kinds[cut]] + start_cost[0]
            start = int(starts[0])
    return cost


def test_pieces_are_the_cheapest_by_brute_force():
    for seed in range(15):
        rng = np.random.default_rng(seed)
        kinds = rng.choice([0, 1, 2, 4, 5], 22, p=[0.1, 0.2, 0.1, 0.3, 0.3]).astype(np.int8)
        kinds[0] = 0
        chosen = [b for _, b in pieces.choose_pieces(kinds, 10, 3)][:-1]
        natural = [i for i in range(1, 22) if kinds[i] != 5]
        best = min(total_cost(kinds, list(c), 10, 3) for r in range(1, 6) for c in itertools.combinations(natural, r))
        assert total_cost(kinds, chosen, 10, 3) <= best + 1e-9


def test_boundaries_of_every_kind():
    text = "Ein Satz ist da. Noch einer ca. hier\n## Kopf\nZeile\n- Eintrag\n\nAbsatz"
    spans = pieces.word_spans(text)
    kinds = dict(zip((text[a:b] for a, b in spans), pieces.boundary_kinds(text, spans)))
    assert (kinds["Noch"], kinds["hier"], kinds["##"], kinds["Zeile"], kinds["-"], kinds["Absatz"]) == (4, 5, 0, 3, 2, 1)


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=25), st.text("abc", max_size=25))
def test_suffix_automaton_covers_what_brute_force_covers(question, answer):
    inside = set()
    for a in range(len(answer)):
        for b in range(a + 3, len(answer) + 1):
            if answer[a:b] in question:
                inside |= set(range(a, b))
    assert pairs.SuffixAutomaton(question).covered(answer, 3) == len(inside)


@pytest.mark.parametrize(
    "question, answer, defect",
    [
        ("Was gilt?", None, "empty"),
        ("Was gilt?", " \xa0​", "empty"),
        ("Was gilt?", "(leer)", "empty"),
        ("Was gilt?", "k. A.", "empty"),
        ("Was gilt?", "leer (Nüchternwert)", None),
        ("Was gilt?", "nein", None),
        ("Was gilt?", "nicht beurteilbar", None),
        ("Was gilt?", "12 mm", None),
        ("Was gilt?", "Dazu kann ich leider keine Auskunft geben", "refusal"),
        ("Was gilt?", "I am sorry, but I cannot answer this question.", "refusal"),
        ("Was gilt?", "Der Patient lehnte die Untersuchung ab.", None),
        ("Was gilt?", "Die Patientin gab an: „Ich kann nachts nicht schlafen.“", None),
        ("Wie wird der Befund genau beschrieben?", "wie wird der Befnud genau beschrieben", "copies_question"),
        ("Wie wird der Befund genau beschrieben?", "Der Befund ist wie folgt beschrieben: Zyste am Hilus mit 3 mm, unverändert.", None),
        ("Was gilt für den Verlauf in diesem Bericht?", "The patient was admitted with fever.", "other_language"),
        ("Was gilt für den Verlauf in diesem Bericht?", "Нужен ли контроль через 50 недель?", "other_language"),
        ("What does the report say about it?", "Der Patient wurde mit Fieber aufgenommen.", "other_language"),
        ("What does the report say about it?", "The patient was admitted.", None),
        ("Was gilt für den Verlauf in diesem Bericht?", "Status quo", None),
        ("Was gilt?", "Die Visite am", "truncated"),
        ("Was gilt?", "Bekannt sind Gicht,", "truncated"),
        ("Was gilt?", "Zyste (bis 3", "truncated"),
        ("Was gilt?", "Der Patient lehnte die Gabe am 3.4.2010 ab", None),
        ("Was gilt?", "Entlassung am 3.4.2010 geplant ...", None),
        (None, "12 mm", None),
        (None, None, "empty"),
    ],
)
def test_pair_defects(question, answer, defect):
    assert pairs.judge(question, answer) == defect


@pytest.mark.parametrize(
    "text, found",
    [
        ("Mail an a.b+c (at) haus-x.example, bitte", [("a.b+c (at) haus-x.example", "email")]),
        ("Serie 3 @ 135 kV, Raum 9", []),
        ("Tel.: (040) 66 969 451, Fax +49 (0)221 4710 766.", [("(040) 66 969 451", "phone"), ("+49 (0)221 4710 766", "phone")]),
        ("Auftragsnr. 2016-6532, SN 0456-12345678 vom 09.10.2021", []),
        ("KVNR: B 909 204 271, Implantat Ref. A641245564", [("B 909 204 271", "id_number")]),
        ("Patientenkennung P3938472, Steuer-ID 55 288 349 394", [("55 288 349 394", "id_number")]),
        ("wohnhaft Am Alten Tor 12 b, D-00321 Bad Wolsen.", [("Am Alten Tor 12 b, D-00321 Bad Wolsen", "address")]),
        ("Anschrift: Lindenstr. 7-9\n00591 Wolbrück\nTel.", [("Lindenstr. 7-9\n00591 Wolbrück", "address")]),
        ("Entlassung nach Wolbrück. Am Hilus 12 mm", []),
        ("Herr von Wolfen, Frau Dr. med. K. Roth-Sand und Dr. SAND, Eva,", [("von Wolfen", "name"), ("K. Roth-Sand", "name"), ("SAND, Eva", "name")]),
        ("Frau Kollegin aus der Urologie, Morbus Velten, Zielke-Syndrom", []),
        ("Herr Stein kam. Stein im Hilus. Stein gibt Husten nach 3 Metern an.", [("Stein", "name"), ("Stein", "name")]),
        ("Herr Wolbrink kam. Später wurde Wolbrink entlassen.", [("Wolbrink", "name"), ("Wolbrink", "name")]),
        ("", []),
        (" \n", []),
    ],
)
def test_personal_places(text, found):
    assert [(text[a:b], kind) for a, b, kind in personal.personal_places(text)] == found
    left = personal.redacted(text)
    assert all(place not in left for place, kind in found if kind in ("email", "phone", "id_number"))


# Mentions without a signal word: another's name, its genitive, another case, one edit, an initial, a part.
UNSIGNALLED = [
    ("Herr Müller kam. Müllers Befund liegt vor.", "Müllers"),
    ("Patient: Meier, Hans. Meyer wünscht Rückruf", "Meyer"),
    ("Herr Wolbrink kam. wolbrink sagte nichts.", "wolbrink"),
    ("Herr Stein. Stein wurde entlassen.", "Stein"),
    ("Frau Roth-Sand kam. Sand war da.", "Sand"),
    ("Frau Zimzow kam. Unklar blieb, ob Zimzow das wusste.", "Zimzow"),
    ("Herr Thilo Biegnagel kam. Danach sprach ZIMZOW, dann Thilo Biegnagel.", "Thilo Biegnagel"),
    ("Frau Pölz kam. K. Pölz hat zugestimmt.", "K. Pölz"),
    ("Für Dr. Uhlritz. Rückfragen an UHLRITZ", "UHLRITZ"),
]


def test_skip_edges_find_mentions_without_a_signal():
    def recall(skip_weight):
        return np.mean([any(text[a:b] == name and a > 0 for a, b, _ in personal.personal_places(text, skip_weight) if a >= text.rindex(name)) for text, name in UNSIGNALLED])

    assert recall(personal.SKIP_WEIGHT) == 1.0 and recall(0.0) < 0.5


@pytest.mark.parametrize(
    "text, places",
    [
        ("Max Mustermann kam heute in die Ambulanz. Max Mustermann klagte nicht.", 2),
        ("Herr Zielke. Zielke-Zeichen negativ, Morbus Zielke, der Zielke am Hilus.", 1),
        ("Mail: " + "a" * 90 + "@haus.example", 1),
        ("Stein" + " " * 90 + "gibt Husten nach " + "sehr " * 30 + "vielen Metern an.", 1),
        ("Anschrift:" + " " * 50 + "Am Tor 3", 1),
        ("Die Max. Länge beträgt 3 mm. Max Länge 4 mm", 0),
        ("Max Mustermann liegt auf Station 3. Später klagte über Husten auch Max Mustermann.", 0),
        ("Max Mustermann liegt auf Station 3. Max Mustermann klagte über Husten.", 2),
    ],
)
def test_personal_contexts_of_any_length(text, places):
    assert len(personal.personal_places(text)) == places


def test_message_passing_is_exact_on_trees():
    text = "aa bb cc dd"
    P = personal.Place
    places = [P(0, 5, "name", 1.0, frozenset(["x"])), P(3, 8, "address", 0.5), P(9, 11, "name", -1.0, frozenset(["x"]))]
    fields = [{"": 1, "name": np.e}, {"": 1, "name": np.e, "address": np.e**0.5}, {"": 1, "address": np.e**0.5}, {"": 1, "name": 1 / np.e}]
    edges = {(0, 1): personal.CHAIN_WEIGHT, (1, 2): personal.CHAIN_WEIGHT, (1, 3): personal.SKIP_WEIGHT}
    total, sums = 0.0, [{k: 0.0 for k in f} for f in fields]
    for labels in itertools.product(*fields):
        weight = np.prod([f[x] for f, x in zip(fields, labels)]) * np.exp(sum(2 * w for (i, j), w in edges.items() if labels[i] == labels[j]))
        total += weight
        for i, x in enumerate(labels):
            sums[i][x] += weight
    wanted = [(sums[0]["name"] + sums[1]["name"]) / 2 / total, (sums[1]["address"] + sums[2]["address"]) / 2 / total, sums[3]["name"] / total]
    assert np.allclose(personal.marginals(places, text), wanted, atol=1e-3)


@pytest.mark.parametrize(
    "text, units",
    [
        ("", []),
        (" \n\t", []),
        ("Ein Satz ohne Ende", ["Ein Satz ohne Ende"]),
        ("Z. n. Gicht am 3. Mai 2010. Gabe von 2 mg p. o. Ende.Neu hier.", ["Z. n. Gicht am 3. Mai 2010.", "Gabe von 2 mg p. o.", "Ende.", "Neu hier."]),
        ("Er sagte: „Es reicht!“ und ging. „Gut so.“ Dann Ruhe.", ["Er sagte: „Es reicht!“ und ging.", "„Gut so.“", "Dann Ruhe."]),
        ("Befund:\nErster\nSatz. Zweiter.\n\n- eins. Zwei\n- drei", ["Befund:", "Erster\nSatz.", "Zweiter.", "- eins. Zwei", "- drei"]),
        ("Temp. bei 38 °C ... später 37 °C. Ruhe … Danach Ende.", ["Temp. bei 38 °C ... später 37 °C.", "Ruhe …", "Danach Ende."]),
        ("他说：“咳嗽。”随后好转。复查！\n下一行", ["他说：“咳嗽。”随后好转。", "复查！", "下一行"]),
        ("ให้ยา 5 มก. วันละครั้ง ผู้ป่วยดีขึ้น", ["ให้ยา 5 มก. วันละครั้ง", "ผู้ป่วยดีขึ้น"]),
        ("बुखार था। डॉ. मेहरन आए। क्या?", ["बुखार था।", "डॉ. मेहरन आए।", "क्या?"]),
        ("Gicht Typ 2. Serie 3 nach i. v. Gabe. Bis einschl. 20. November 2022.", ["Gicht Typ 2.", "Serie 3 nach i. v. Gabe.", "Bis einschl. 20. November 2022."]),
        ('Er kam."Neu hier." Weiter.', ["Er kam.", '"Neu hier."', "Weiter."]),
        ('Rohr 5" lang. Dann Ende. Und so weiter.', ['Rohr 5" lang.', "Dann Ende.", "Und so weiter."]),
        ("Verzögerung 5 s, Auftragsnr. 2012-6960. Ende.", ["Verzögerung 5 s, Auftragsnr. 2012-6960.", "Ende."]),
        ("Dr. A. Roth saw it, e.g. at 5 p.m. today. Next!", ["Dr. A. Roth saw it, e.g. at 5 p.m. today.", "Next!"]),
    ],
)
def test_sentence_units(text, units):
    assert [text[a:b] for a, b in sentences.sentence_units(text)] == units


@settings(max_examples=150, deadline=None)
@given(st.text("aA. \n!?„“\"()1-:。ก…", max_size=120))
def test_units_cover_all_but_blanks(text):
    at = 0
    for a, b in sentences.sentence_units(text):
        assert a >= at and b > a and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


QUOTING = [
    "Am 3. Mai kam A. Roth. „Ja. Gut.“ sagte er. Ca. 5 mm bzw. mehr. Nein! doch. Typ 2. Z. n. Gicht usw. Ende.",
    'Er rief: "Nein! Nie." Dann (Abb. 3. Dort.) ging er. Ende.',
    'Rohr 5" lang. Er sagte: "Ja. Gut so." Dann ging er. Ende.',
]


def total_score(text, chosen, found, gains):
    """Score of a set of cuts, the best way to give up one straight quotation mark included."""
    ends = [0, *sorted(chosen), len(text)]
    levels, counts = sentences.open_levels(text, 0, len(text), ends)
    fixed = sum(gains[e] for e in chosen) + sum(sentences.span_score(text, a, b) for a, b in itertools.pairwise(ends)) - sum(2 * sentences.OPEN_COST * n for n in levels[1:-1])
    values = []
    for given_up in [None, *(i for i in range(1, len(ends)) if counts[i] % 2)] if counts[-1] % 2 else [None]:
        cost = 0.0
        for i in range(1, len(ends)):
            after = given_up is not None and i > given_up
            if i == given_up:
                cost += sentences.STRAY_COST
            elif (counts[i] + after) % 2:
                cost += 2 * sentences.OPEN_COST if i < len(ends) - 1 else sentences.STRAY_COST
        values.append(fixed - cost)
    return max(values)


@pytest.mark.parametrize("text", QUOTING)
def test_best_spans_by_brute_force(text):
    found = sentences.candidates(text, 0, len(text))
    gains = dict(found)
    best = max(total_score(text, c, found, gains) for r in range(len(found) + 1) for c in itertools.combinations([e for e, _ in found], r))
    chosen = [b for _, b in sentences.spans(text, 0, len(text))][:-1]
    assert abs(total_score(text, chosen, found, gains) - best) < 1e-9


@pytest.mark.parametrize("text", QUOTING)
def test_whole_spans_decide_more_than_single_gains(text):
    by_gain = {e for e, g in sentences.candidates(text, 0, len(text)) if g > 0}
    assert {b for _, b in sentences.spans(text, 0, len(text))} - {len(text)} != by_gain


def test_quotations_and_headings_of_any_length():
    text = "Er sagte: „" + "Das ist so. " * 100 + "“ und ging. Danach Ruhe."
    assert len(sentences.sentence_units(text)) == 2
    head = "Die lange Überschrift mit weit mehr als sechs Wörtern und mehr als achtzig Zeichen zum Befund von gestern:"
    assert sentences.sentence_units(head + "\nText hier. Zwei.")[0] == (0, len(head))
    spaced = "Termin am 3." + " " * 100 + "Mai 2010. Ende."  # the word before a mark is looked for over any distance
    assert len(sentences.sentence_units(spaced)) == 2


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 250).astype(np.uint64)
        a, b = base[:200], base[50:]  # similarity 150 / 250
        keys = [neighbours.band_keys(np.unique(x), 200, 1) for x in (a, b)]
        agree.append((keys[0] == keys[1]).mean())
    assert abs(np.mean(agree) - 0.6) < 0.03
