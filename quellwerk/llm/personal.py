"""Personal information in free text: finding and typed placeholders.

A skip-chain conditional random field over tokens. An automaton over signal words and
anchored patterns propose stretches of text for a type; a proposal gives its tokens a
potential for that type from its form and its context. Every word that equals a name
found so far, or resembles it (genitive, case, a part of a double name, one edit), is
proposed as well, with a potential below zero. Chain edges join neighbouring tokens of
a proposal, skip edges join distant tokens with the same number, street or surname,
the weaker the less they resemble each other, and loopy sum-product message passing
gives the probability of each type for each token. A proposal is found if its type
has more than half of the probability over its tokens; of overlapping proposals the
likeliest is taken.

Tokens that no proposal covers have no node: with their negative potential and no
edge they could only end as ordinary text. Proposals that meet no contrary evidence
(no other type, no edge to one of the other sign) are decided by their own sign, which
is what message passing would give.

Potentials are set by hand, as there are no labelled places to fit them to.

Defined cases: null and blank texts have no place; overlapping proposals that are
equally likely are settled by the longest, then in the order e-mail, address, number,
name; the same place is reported once however often a row is delivered; texts are
read whole, and no context is limited by a number of characters.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.llm.pieces import report_texts

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
RANK = {"email": 0, "address": 1, "id_number": 2, "phone": 3, "name": 4}

H = r"[ \t\xa0  ]"
UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪİĶŁĻŃŅŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽ"
CAP = rf"(?>[{UP}][\w’']*(?:-[{UP}][\w’']*)*)"
INITIAL = rf"[{UP}]\."
# Particles of surnames.
PARTICLE = rf"(?>(?i:von{H}+und{H}+zu|von{H}+der|von{H}+dem|von{H}+den|van{H}+der|van{H}+den|van{H}+de|de{H}+la|de{H}+los|von|van|vom|zum|zur|zu|del|della|de|di|da|dos|du|ten|ter|el|al|bin|ibn))"
_GIVEN = rf"(?!{PARTICLE}{H})(?:{INITIAL}{H}*|{CAP}{H}+)"
ONE_NAME = rf"(?:{_GIVEN}(?:{_GIVEN})?(?:{PARTICLE}{H}+)?|{PARTICLE}{H}+)?{CAP}"
LISTED_NAME = rf"(?:{PARTICLE}{H}+)?{CAP},{H}+(?:{CAP}|{INITIAL})(?:{H}+(?:{INITIAL}|{CAP}))?"
ONE = re.compile(ONE_NAME)
LISTED = re.compile(LISTED_NAME)
# Titles between a signal word and the name.
TITLES = re.compile(
    rf"(?:(?:Herrn?|Frau|HERRN?|FRAU|Fr\.|Hr\.|Kolleg(?:in|en|e)|Prof(?:essor(?:in)?)?\.?|PD|Priv\.-Doz\.|Dr(?:es)?\.?|Dipl\.-\w+\.?|med\.|dent\.|rer\.|nat\.|phil\.|univ\.|habil\.|h\.{H}?c\.|mult\.|OÄ|OA|CÄ|CA|Ober(?:arzt|ärztin)|Chef(?:arzt|ärztin)|Assistenz(?:arzt|ärztin)|Fach(?:arzt|ärztin)|Sr\.|Sra\.|Dra\.)(?:{H}+|(?<=\.)))+"
)
# Capitalised words that are no names after a signal word.
NO_NAMES = frozenset(
    """Patient Patientin Patienten Kollegin Kollege Kollegen Kolleginnen Herr Herrn Frau Doktor Professor Angehörige Angehörigen Angehöriger Eltern Familie Ehepartner Ehemann Ehefrau Mutter Vater Sohn Tochter Bruder Schwester Hausarzt Hausärztin Team Station Chirurgie Radiologie
    Neurologie Kardiologie Urologie Nephrologie Hämatologie Onkologie Pneumologie Gastroenterologie Notaufnahme Pathologie Gynäkologie Anästhesie Innere Medizin Ambulanz Klinik Praxis Zentrum Institut Abteilung Labor Telefon Tel Fax Mobil Geb Geburtsdatum Anschrift Adresse Aufnahme
    Befund Befunde Bericht Diagnose Diagnosen Therapie Medikation Verlauf Anamnese Indikation Technik Beurteilung Procedere Der Die Das Den Dem Des Ein Eine Er Sie Es Wir Ich Ihr Ihre Ihm Ihnen Im Am In An Auf Bei Mit Nach Vor Seit Unter Von Zum Zur Zu Und Oder Kein Keine
    Damen Name Nr Kontrolle Rückfragen Damen Pflege Kopie Diabetes Pneumonie Asthma Gicht Anämie Osteoporose Hypertonie Arterielle Chronische Morbus Tumorkonferenz Leitlinie Personalausweis Steuer""".split()
)
# Everyday words that are also surnames; alone they need more evidence.
COMMON_SURNAMES = frozenset(
    "stein berg winter sommer herz lang kurz klar rose fuchs vogel baum wolf stark groß klein alt jung roth rot weiß schwarz braun grün blume kern wald feld bach engel könig kaiser richter kraft frank gut hart hell reich frisch fromm hahn hase hirsch kranz kreuz krone licht linde mai march meister ritter sauer scharf stern stock sturm süß teich thal wirth wunder zahn zeit kopf".split()
)

STREET_ENDS = "straße strasse str. Straße Strasse Str. STRASSE weg Weg gasse Gasse allee Allee promenade ring Ring pfad Pfad kamp Kamp platz Platz damm Damm ufer steig stieg chaussee Chaussee graben hof Hof markt Markt wall Wall berg feld wiese garten park twiete zeile winkel bogen redder brücke tor".split()
HOUSE = rf"\d{{1,4}}(?:{H}?[a-hA-H](?!\w|\.{H}?[A-Z]?[a-z]+\.))?(?:{H}?[-–/]{H}?\d{{1,4}}(?:{H}?[a-h](?!\w))?)?"
UNITS = rf"(?!\w)(?![.,:/]\d)(?!{H}?(?:mm|cm|ml|mg|µg|g|kg|IE|%|°|x\b|[gGUmµn]\w*/|Uhr|Tag|Woche|Monat|Jahr|Stunde|Minute|Zyk|Meter|kV|mAs|MHz|Gy))"
HOUSE_AFTER = re.compile(rf"{H}*({HOUSE}){UNITS}")
STREET_WORD = re.compile(rf"(?:(?:Alte[nr]?|Neue[nr]?|Große[nr]?|Kleine[nr]?|Obere[nr]?|Untere[nr]?|Lange[nr]?|Hohe[nr]?|Breite[nr]?|Am|An der|Zum|Zur){H}+)?(?:{CAP}|(?:Dr|St|Prof)\.(?:-{CAP})+|[{UP}][\w’'.-]*)$")
NAMED_STREET = re.compile(
    rf"(?:Am|Im|An{H}+de[rnm]|Auf{H}+de[rnm]|Hinter{H}+de[rmn]|Unter{H}+de[nrm]|Vor{H}+de[mrn]|Bei{H}+de[rmn]|In{H}+de[rn]|Zum|Zur|Platz{H}+de[rs]){H}+{CAP}(?:{H}+{CAP})?{H}+{HOUSE}{UNITS}"
)
TOWN = rf"(?:(?:Bad|Sankt|St\.|Neu|Alt|Klein|Groß|Ober|Unter|Hohen|Markt){H}+)?{CAP}(?:{H}+(?:a\.{H}?d\.|an{H}+der|am|im|in{H}+der|ob{H}+der|bei|vor{H}+der){H}+{CAP})?"
CODE_TOWN = rf"(?:D{H}?-{H}?)?(?<!\d)\d{{5}}{H}+{TOWN}"
TOWN_AFTER = re.compile(rf",?(?:{H}+|{H}*\r?\n{H}*){CODE_TOWN}")
TOWN_BEFORE = re.compile(rf"(?<![\w-])({CODE_TOWN}),?(?:{H}+|{H}*\r?\n{H}*)$")
ADDRESS_SIGNS = re.compile(rf"(?:wohnhaft|wohnt|Anschrift|Adresse|Haus|lautet{H}+jetzt|Wohnort|Straße)[:\s]*(?:in\s+)?$")

AFTER_AT = re.compile(rf"(?:@|[(\[{{]{H}?(?:at|AT|ät|Ät|@){H}?[)\]}}]){H}?[\w-]+(?:(?:\.|{H}?[(\[{{](?:dot|DOT|punkt|Punkt)[)\]}}]{H}?)[\w-]+)*(?:\.|{H}?[(\[{{](?:dot|DOT|punkt|Punkt)[)\]}}]{H}?)[^\W\d_]{{2,}}(?![\w-])")

PHONE = re.compile(
    rf"(?<![\w.,/+-])(?:\+\d{{2,3}}|00\d\d(?=[\d\-/.\s(])|\(\+?\d{{2,6}}\)|0\d{{2,4}}(?=[\s/.-]))(?:{H}?\(0\))?(?:{H}?[/-]{H}?|[. \t\xa0 ])?\d+(?:(?:[/.-]|{H})\d+)*(?!\w)"
)
PHONE_SIGNS = re.compile(r"(?:Tel(?:efon)?|Fax|[Mm]obil|Handy|Rückruf|unter|kontakt|Durchwahl|erreichbar|Telefax|phone|tél)\W*(?:der|Nr)?\W*$", re.IGNORECASE)
CODE_SIGNS = re.compile(r"(?:SN|Nr|Charge|Ref|Los|Auftrag\w*|Zeichen|Protokoll|Probe|Block|Chargennr|Kennung|kennung|Aktenzeichen|Az|Messung)\W{0,3}$")

ID_LABELS = "KVNR KV-Nr Versichertenn Versicherten-N Versichertennummer Steuer-ID Steueridentifikation Steuernummer IdNr RV-N SV-N Rentenversicherung Sozialversicherung Krankenversicherung Krankenkassen Personalausweis Ausweis-N Ausweisn Reisepass Karte".split()
ID_AFTER_LABEL = re.compile(r"[\w.-]*(?:\s(?:eingelesen|Nr\.?|Nummer|lautet|:))?[\s:(.]{0,4}")
ID_FORMS = re.compile(
    rf"[A-Z]{H}?\d{{3}}{H}?\d{{3}}{H}?\d{{3}}(?!\w)|\d{{2}}{H}?\d{{6}}{H}?[A-Z]{H}?\d{{3}}(?!\w)|\d{{2}}{H}?\d{{3}}{H}?\d{{3}}{H}?\d{{3}}(?!\w)|(?=[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z][A-Z0-9]{{8,9}}(?!\w)"
)

# Signal word -> (pattern between it and the name, unary potential of the name).
_COLON = re.compile(rf"(?:in|en)?{H}*(?::|\"{H}*:{H}*\"){H}*")
_DOTS = re.compile(rf"{H}*(?:[.:…]+){H}*")
_SPACE = re.compile(rf"n?{H}+")
_DOCTOR = re.compile(rf"(?:\.|a\.)?(?:{H}+|(?<=\.))")
_OPEN = re.compile(rf"(?:in)?{H}*(?:[(:,]{H}*|{H})(?:(?:Frau|Herrn?){H}+)?")
_WORDS = re.compile(rf":?{H}+")
_NONE = re.compile("")
NAME_SIGNS: dict[str, tuple[re.Pattern, float]] = {
    **dict.fromkeys(["Patient", "patient", "PATIENT", "Versicherter", "Versicherte"], (_COLON, 4.0)),
    **dict.fromkeys(["Name", "NAME", "Nachname", "Vorname", "name\""], (_DOTS, 4.0)),
    **dict.fromkeys(["Herr", "Frau", "HERR", "FRAU"], (_SPACE, 4.0)),
    **dict.fromkeys(["Dr", "Prof", "DR", "PROF", "Dra", "Sr", "Sra", "Mr", "Mrs", "Mme"], (_DOCTOR, 4.0)),
    **dict.fromkeys(["Kollegin", "Kollege", "Kollegen"], (_SPACE, 3.0)),
    **dict.fromkeys(
        "Schwager Schwägerin Ehemann Ehefrau Nachbar Nachbarin Bruder Schwester Onkel Tante Vater Mutter Sohn Tochter Enkel Enkelin Neffe Nichte Großmutter Großvater Lebensgefährte Lebensgefährtin Partner Partnerin Betreuer Vormund Hausarzt Hausärztin Schwiegersohn Schwiegertochter Oberarzt Oberärztin Pfleger".split(),
        (_OPEN, 2.5),
    ),
    **dict.fromkeys(["Praxis", "Betrifft", "Betr.:"], (_WORDS, 2.5)),
    **dict.fromkeys(["Gespräch mit", "Verwechslung mit", "Telefonat mit", "Rücksprache mit", "Diktiert von", "diktiert von", "gez.", "Gez.", "berichten über", "Unterschrift"], (_WORDS, 3.0)),
    "**": (_NONE, 2.0),
}
SPEAKER = re.compile(rf"(?:^|[.!?:;“\"]\s+|[\n\r]\s*(?:[-*•]|\d+\.)?\s*|[-•]\s+)((?:{PARTICLE}{H}+)?{CAP}){H}+$")
SPEAKS = re.compile(rf"klagt{H}+über|berichtet{H}+über|verneint{H}+")
STATES = re.compile(rf"gibt{H}+[^.\n]")
STATED = re.compile(rf"[.\n]|{H}an\b")
CLOSED_BOLD = re.compile(r"\s*\*\*")
# Frequent given names; with a surname after them they need no signal word.
GIVEN_NAMES = """Alexander Andreas Angela Anja Anna Anton Barbara Bernd Birgit Brigitte Christian Christine Claudia Daniel Dieter Elisabeth Emma Erika Eva Felix Franziska Friedrich Gabriele Georg Gerhard Gisela Günter Hannah Hans Heike Heinrich Heinz Helga Helmut Horst Ingrid Jan Johann Johanna Johannes Josef
    Julia Jürgen Karin Karl Katharina Katrin Klaus Laura Lena Leon Lukas Manfred Maria Marie Markus Martin Martina Matthias Max Michael Monika Nicole Nina Paul Peter Petra Rainer Renate Sabine Sandra Sarah Simone Sophie Stefan Stefanie Susanne Thomas Tim Tobias Ursula Ute Uwe Werner Wolfgang
    John Mary James Robert Linda William Susan David Jean Pierre José Juan Carmen Luis Mehmet Ali Fatma Ayşe Ahmed Mohammed Ivan Olga""".split()
FULL_NAME = re.compile(rf"{CAP}{H}+(?:{INITIAL}{H}*|{CAP}{H}+(?={CAP}{H}))?(?:{PARTICLE}{H}+)?{CAP}(?![-\w])")
# What persons do, after a name.
ACTS = re.compile(
    r"\s+(?:gibt|gab|klagt|klagte|berichtet|berichtete|verneint|verneinte|kam|kommt|erschien|lehnt|lehnte|wünscht|wünschte|bittet|bat|leidet|litt|sagt|sagte|stellt\s+sich|stellte\s+sich|(?:wurde|wird|ist)\s+(?:\w+\s+){0,3}?(?:entlassen|aufgenommen|verlegt|vorgestellt|einbestellt|aufgeklärt|informiert))\b"
)
IS = re.compile(r"\s+(?:wurde|wird|ist|hat|war|hatte)\b")
PLACED = re.compile(r"\s+(?:im|am|in|an|mit|bei|des|der|von)\b|\s+\d|-|\s+und\s+\w+-")
NOT_A_PERSON = re.compile(r"(?:\b(?:[IiAa]m|[Ii]n|[Dd](?:er|ie|as|em|en|es)|Morbus|M\.|[Ee]in(?:e[mnrs]?)?))\s+$")
INITIAL_BEFORE = re.compile(rf"{INITIAL}{H}*")
OUTER = ".,;:!?()[]{}<>\"'„“”‚‘»«*_/|…"
SOLID = re.compile(r"\S+")

_state: dict = {}


#: Blanks of other widths, as the signal words are written with plain ones.
OTHER_BLANKS = "\t\xa0\u202f\u2009\u2007"


def automaton() -> ahocorasick.Automaton:
    if "automaton" not in _state:
        words: dict[str, set] = {}
        for sign in NAME_SIGNS:
            words.setdefault(sign, set()).add("name")
        for kind, listed in (("speaker", ["gibt", "klagt", "berichtet", "verneint"]), ("street", STREET_ENDS), ("id", ID_LABELS), ("at", ["@", "(at", "[at", "{at", "(AT", "[AT", "( at", "[ at"])):
            for word in listed:
                words.setdefault(word, set()).add(kind)
        for word in GIVEN_NAMES:
            words.setdefault(word, set()).add("given")
        for word in "Am Im Zum Zur Hinter Unter Vor Auf An Bei In Platz".split():
            words.setdefault(word, set()).add("named")
        built = ahocorasick.Automaton()
        for word, kinds in words.items():
            built.add_word(word, (word, tuple(sorted(kinds))))
        built.make_automaton()
        _state["automaton"] = built
    return _state["automaton"]


class Place:
    """A proposal: a stretch for a type with its potential, the keys it shares with others and how much it resembles them."""

    __slots__ = ("start", "end", "kind", "score", "keys", "alike")

    def __init__(self, start: int, end: int, kind: str, score: float, keys: frozenset = frozenset(), alike: float = 1.0):
        self.start, self.end, self.kind, self.score, self.keys, self.alike = start, end, kind, score, keys, alike


def back(text: str, at: int, words: int, low: int = 0) -> int:
    """Where the last `words` words before `at` begin."""
    for _ in range(words):
        while at > low and text[at - 1].isspace():
            at -= 1
        while at > low and not text[at - 1].isspace():
            at -= 1
    return at


def find_email(text: str, at: int) -> Place | None:
    m = AFTER_AT.match(text, at)
    if not m:
        return None
    end = at - 1 if at and re.match(H, text[at - 1]) else at
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
        start -= 1
    while start < end and text[start] in ".-%+":
        start += 1
    return Place(start, m.end(), "email", 8.0) if start < end and text[end - 1] not in ".-%" else None


def with_town(text: str, start: int, end: int) -> tuple[int, int, bool]:
    """Postcode and town next to a street, before or after it."""
    after = TOWN_AFTER.match(text, end)
    if after:
        return start, after.end(), True
    before = TOWN_BEFORE.search(text, back(text, start, 9), start)
    return (before.start(1), end, True) if before else (start, end, False)


def find_street(text: str, end: int) -> Place | None:
    """A street whose name ends at `end`, with its house number."""
    house = HOUSE_AFTER.match(text, end)
    if not house:
        return None
    low = back(text, end, 4)
    low = max(low, text.rfind("\n", low, end) + 1)
    name = STREET_WORD.search(text, low, end)
    if not name:
        return None
    start = name.start()
    while start > low and (text[start - 1] in ".-" or text[start - 1].isalnum()):
        start -= 1
    while not text[start].isupper():
        start += 1
        if start >= end:
            return None
    first, last, town = with_town(text, start, house.end())
    sign = bool(ADDRESS_SIGNS.search(text, back(text, first, 3), first))
    if len(house.group(1)) > 3 and house.group(1).isdigit() and not (town or sign):
        return None
    return Place(first, last, "address", 5.5 + town + sign, frozenset([text[start : house.end()].lower()]))


def find_named_street(text: str, start: int) -> Place | None:
    m = NAMED_STREET.match(text, start)
    if not m or (start and (text[start - 1].isalnum() or text[start - 1] == "-")):
        return None
    first, last, town = with_town(text, start, m.end())
    sign = bool(ADDRESS_SIGNS.search(text, back(text, first, 3), first))
    alone = (first == 0 or text[first - 1] in "\n\r") and (last == len(text) or text[last] in "\n\r")
    listed = text[max(0, first - 2) : first] == ", " and text[last : last + 1] in ",.\n\r"
    return Place(first, last, "address", -2.0 + 7 * town + 7 * sign + 7 * alone + 6.5 * listed, frozenset([m.group().lower()]))


def find_phones(text: str, found: list[Place]) -> None:
    for m in PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        if not 8 <= digits <= 15:
            continue
        before = text[back(text, m.start(), 3) : m.start()]
        score = 1.0 + 3 * bool(PHONE_SIGNS.search(before)) - 6 * bool(CODE_SIGNS.search(before))
        found.append(Place(m.start(), m.end(), "phone", score, frozenset(["".join(c for c in m.group() if c.isdigit())])))


def find_id(text: str, end: int) -> Place | None:
    gap = ID_AFTER_LABEL.match(text, end)
    m = ID_FORMS.match(text, gap.end())
    return Place(m.start(), m.end(), "id_number", 4.0, frozenset([re.sub(r"\s", "", m.group())])) if m else None


def surname_keys(name: str) -> frozenset:
    """Folded surname of a name, for skip edges."""
    last = name.split(",")[0] if "," in name else name.split()[-1]
    return frozenset([last.split()[-1].lower()])


def find_name(text: str, start: int, score: float, stop: int) -> Place | None:
    """A name at `start`, after titles; `stop` is where an address or e-mail begins."""
    titles = TITLES.match(text, start)
    if titles:
        start = titles.end()
    m = LISTED.match(text, start, stop)
    if m and (m.group().split(",")[1].split()[0].rstrip(".") in NO_NAMES or re.compile(rf"{H}*\d").match(text, m.end())):
        m = None
    m = m or ONE.match(text, start, stop)
    if not m:
        return None
    end = m.end()
    words = list(re.compile(rf"[^\s,]+").finditer(text, start, end))
    for k, w in enumerate(words):
        if w.group() in NO_NAMES:
            if k == 0:
                return None
            end = words[k - 1].end()
            break
    if end < len(text) and text[end] == "-" and text[end + 1 : end + 2].isalpha():
        return None
    if len(text[start:end].strip(" .,")) < 2 or text[start:end].endswith("."):
        return None
    return Place(start, end, "name", score, surname_keys(text[start:end]))


def statements(text: str) -> tuple[list[int], list[str]]:
    """Where sentences end and where the word that closes `gibt ... an` stands."""
    found = [(m.start(), m.group()[-1]) for m in STATED.finditer(text)]
    return [at for at, _ in found], [c for _, c in found]


def find_speaker(text: str, at: int, marks: tuple[list[int], list[str]]) -> Place | None:
    states = STATES.match(text, at)
    if states:
        k = bisect_left(marks[0], states.end())
        if k == len(marks[0]) or marks[1][k] != "n":
            return None
    elif not SPEAKS.match(text, at):
        return None
    low = back(text, at, 4)
    m = SPEAKER.search(text, max(0, low - 1), at)
    if not m or m.group(1) in NO_NAMES:
        return None
    return Place(m.start(1), m.end(1), "name", 2.5, surname_keys(m.group(1)))


def find_given(text: str, at: int) -> Place | None:
    """A frequent given name at `at` with a surname after it, likelier where a person acts."""
    if at and (text[at - 1].isalnum() or text[at - 1] in "-.@_"):
        return None
    m = FULL_NAME.match(text, at)
    if not m or any(w in NO_NAMES for w in m.group().split()):
        return None
    acts = ACTS.match(text, m.end())
    return Place(at, m.end(), "name", 2.0 if acts else -0.5, surname_keys(m.group()))


def edits(a: str, b: str) -> bool:
    """One character replaced, inserted or left out."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def resemblance(word: str, known: str) -> float:
    """How much a word resembles a surname, both in lower case: 1 equal, 0 not at all."""
    if word == known:
        return 1.0
    if known in COMMON_SURNAMES or len(known) < 3:
        return 0.0
    if word in (known + "s", known + "’s", known + "'s", known + "’", known + "'"):
        return 0.95
    if "-" in known and len(word) > 3 and word in known.split("-"):
        return 0.9
    return 0.75 if len(known) > 4 and len(word) > 4 and "-" not in word and edits(word, known) else 0.0


def mention_score(text: str, start: int, end: int, word: str, known: str, alike: float) -> float:
    """Potential of a word that resembles a known surname and has no signal of its own; below zero unless a person acts."""
    if text[end : end + 1] == "-" or text[start - 1 : start] == "-":
        return -8.0
    score = -1.0 if alike > 0.9 else -2.0
    if known in COMMON_SURNAMES:
        score -= 2.5
    if text[start].islower():
        score -= 0.5 if known not in COMMON_SURNAMES else 4.0
    if ACTS.match(text, end):
        score += 3.0
    elif IS.match(text, end):
        score += 1.0
    if PLACED.match(text, end):
        score -= 2.0
    if NOT_A_PERSON.search(text, back(text, start, 1), start):
        score -= 3.0
    return score


def mentions(text: str, places: list[Place]) -> list[Place]:
    """Words that resemble the surnames proposed with a signal, wherever they stand, with an initial before them."""
    known: dict[str, list[str]] = {}
    given: set[str] = set()
    named = sorted((p.start, p.end) for p in places if p.kind == "name" and p.score > 0)
    for p in places:
        if p.kind == "name" and p.score > 0:
            given.update(w.strip(OUTER) for w in text[p.start : p.end].lower().split())
            for key in p.keys:
                if len(key) > 2:
                    for part in {key[0], *(x[0] for x in key.split("-") if x)}:
                        known.setdefault(part, []).append(key)
    if not known:
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    forms: dict[str, tuple[str, float]] = {}
    for token in set(low.split()):
        word = token.strip(OUTER)
        for key in known.get(word[:1], ()):
            alike = resemblance(word, key)
            if alike > forms.get(word, ("", 0.0))[1]:
                forms[word] = key, alike
    begins, reach = [a for a, _ in named], [0]
    for _, end in named:
        reach.append(max(reach[-1], end))
    found = []
    for word, (key, alike) in forms.items():
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            signed = reach[bisect_left(begins, at + 1)] >= end  # part of a name with a signal
            if not signed and not (at and text[at - 1].isalnum()) and not text[end : end + 1].isalnum():
                score = mention_score(text, at, end, word, key, alike)
                if score > -6:
                    start, before = at, back(text, at, 1)
                    if INITIAL_BEFORE.fullmatch(text, before, at) or (text[before:at].strip().lower() in given and text[before:at].strip().lower() != key):
                        start, score = before, score + 1.0
                    found.append(Place(start, end, "name", score, frozenset([key]), alike))
            at = low.find(word, end)
    return found


# A skip edge between equal tokens lifts a mention by twice its weight at most; less than one signal word.
SKIP_WEIGHT, CHAIN_WEIGHT, ROUNDS, SETTLED = 0.9, 1.0, 50, 1e-4


def components(places: list[Place]) -> list[list[int]]:
    """Proposals (sorted by start) that overlap or share a key, over any number of steps."""
    parent = list(range(len(places)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    holder, reach, keyed = 0, -1, {}
    for i, p in enumerate(places):
        if p.start < reach:
            parent[find(i)] = find(holder)
        if p.end > reach:
            holder, reach = i, p.end
        for key in p.keys:
            j = keyed.setdefault((p.kind, key), i)
            parent[find(i)] = find(j)
    groups: dict[int, list[int]] = {}
    for i in range(len(places)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def marginals(places: list[Place], text: str, skip_weight: float = SKIP_WEIGHT) -> list[float]:
    """Probability of each proposal's type over its tokens, by loopy sum-product on the token graph. places: sorted by start."""
    cuts = sorted({x for p in places for x in (p.start, p.end)})
    tokens: list[tuple[int, int]] = []
    reach = -1
    for p in places:
        for m in SOLID.finditer(text, max(p.start, reach), max(p.end, reach)):
            a, b = m.span()
            inner = [a, *cuts[bisect_left(cuts, a + 1) : bisect_left(cuts, b)], b]
            tokens += zip(inner, inner[1:])
        reach = max(reach, p.end)
    starts = [a for a, _ in tokens]
    covered = [range(bisect_left(starts, p.start), bisect_left(starts, p.end)) for p in places]
    fields: list[dict[str, float]] = [{"": 1.0} for _ in tokens]
    edges: dict[tuple[int, int], float] = {}
    keyed: dict[tuple[str, str], list[tuple[int, float]]] = {}
    for p, own in zip(places, covered):
        weight = math.exp(max(-20.0, min(20.0, p.score)))
        for i in own:
            fields[i][p.kind] = max(weight, fields[i].get(p.kind, 0.0))
        for i in own[1:]:
            edges[i - 1, i] = CHAIN_WEIGHT
        for key in p.keys:
            # the token that holds the surname: the one before the comma of "Last, First", else the last
            comma = text.find(",", p.start, p.end)
            at = own[0] if p.kind != "name" else own[-1] if comma < 0 else bisect_left(starts, comma) - 1
            keyed.setdefault((p.kind, key), []).append((at, p.alike))
    for group in keyed.values() if skip_weight else ():
        sure = [x for x in group if x[1] == 1.0] or group
        for (i, x), (j, y) in [*zip(group, group[1:]), *((s, m) for m in group if m[1] < 1.0 for s in (sure[0], sure[-1])), (group[0], group[-1])]:
            if i != j:
                edges[min(i, j), max(i, j)] = max(edges.get((min(i, j), max(i, j)), 0.0), skip_weight * min(x, y))
    joined: list[list[int]] = [[] for _ in tokens]
    message: dict[tuple[int, int], dict[str, float]] = {}
    for i, j in edges:
        joined[i].append(j)
        joined[j].append(i)
        message[i, j] = dict.fromkeys(fields[j], 1.0)
        message[j, i] = dict.fromkeys(fields[i], 1.0)

    def belief(i: int, without: int = -1) -> dict[str, float]:
        out = dict(fields[i])
        for k in joined[i]:
            if k != without:
                for label, value in message[k, i].items():
                    out[label] *= value
        total = sum(out.values())
        return {label: value / total for label, value in out.items()}

    for _ in range(ROUNDS):
        change, fresh = 0.0, {}
        for i, j in message:
            own = belief(i, j)
            agree = math.exp(2 * edges[min(i, j), max(i, j)]) - 1
            new = {label: 1.0 + agree * own.get(label, 0.0) for label in fields[j]}
            total = sum(new.values())
            new = {label: value / total for label, value in new.items()}
            change = max(change, *(abs(new[label] - value) for label, value in message[i, j].items()))
            fresh[i, j] = new
        message.update(fresh)
        if change < SETTLED:
            break
    beliefs = [belief(i) for i in range(len(tokens))]
    return [sum(beliefs[i][p.kind] for i in own) / max(1, len(own)) for p, own in zip(places, covered)]


def chosen(places: list[Place], text: str, skip_weight: float = SKIP_WEIGHT) -> list[Place]:
    """The proposals found, without overlaps."""
    unique: dict[tuple[int, int, str], Place] = {}
    for p in places:
        held = unique.get((p.start, p.end, p.kind))
        if held is None or p.score > held.score:
            unique[p.start, p.end, p.kind] = p
    places = sorted(unique.values(), key=lambda p: (p.start, p.end))
    found: list[Place] = []
    for group in components(places):
        own = [places[i] for i in group]
        if len({p.kind for p in own}) == 1 and (all(p.score > 0 for p in own) or all(p.score <= 0 for p in own)):
            chances = [1.0 if p.score > 0 else 0.0 for p in own]
        else:
            chances = marginals(own, text, skip_weight)
        ranked = sorted(((c, p) for c, p in zip(chances, own) if c > 0.5), key=lambda x: (-round(x[0], 2), x[1].start - x[1].end, RANK[x[1].kind]))
        kept: list[Place] = []
        for _, p in ranked:
            k = bisect_left(kept, p.start, key=lambda q: q.start)
            if not (k and kept[k - 1].end > p.start) and not (k < len(kept) and kept[k].start < p.end):
                kept.insert(k, p)
        found += kept
    return sorted(found, key=lambda p: p.start)


def proposals(text: str) -> list[Place]:
    """Stretches with a signal or a form of their own, and the words that resemble the names among them."""
    hits: dict[str, list[tuple[int, str]]] = {}
    plain = text
    for blank in OTHER_BLANKS:
        if blank in text:
            plain = plain.replace(blank, " ")
    for last, (word, kinds) in automaton().iter(plain):
        for kind in kinds:
            hits.setdefault(kind, []).append((last + 1, word))
    places: list[Place | None] = []
    for end, word in hits.get("at", ()):
        places.append(find_email(text, end - len(word)))
    for end, _ in hits.get("street", ()):
        c = text[end : end + 1]
        if c and (c.isspace() or c.isdigit()):
            places.append(find_street(text, end))
    for end, word in hits.get("named", ()):
        if text[end : end + 1].isspace():
            places.append(find_named_street(text, end - len(word)))
    found = [p for p in places if p]
    blocked = sorted((p.start, p.end) for p in found if p.score > 0)
    begins = [a for a, _ in blocked]
    places = [find_id(text, end) for end, _ in hits.get("id", ())]
    find_phones(text, found)
    for end, word in hits.get("name", ()):
        if word not in ("**", 'name"') and end > len(word) and text[end - len(word) - 1].isalnum():
            continue
        between, score = NAME_SIGNS[word]
        gap = between.match(text, end)
        if not gap:
            continue
        k = bisect_left(begins, gap.end())
        if k and blocked[k - 1][1] > gap.end():
            continue  # inside an address
        place = find_name(text, gap.end(), score, begins[k] if k < len(begins) else len(text))
        if place and (word != "**" or CLOSED_BOLD.match(text, place.end)):
            places.append(place)
    if "speaker" in hits:
        marks = statements(text)
        places += [find_speaker(text, end - len(word), marks) for end, word in hits["speaker"]]
    places += [find_given(text, end - len(word)) for end, word in hits.get("given", ())]
    found += [p for p in places if p]
    return found + mentions(text, found) if found else found


def personal_places(text: str, skip_weight: float = SKIP_WEIGHT) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal information in a text."""
    return [(p.start, p.end, p.kind) for p in chosen(proposals(text), text, skip_weight)]


def redacted(text: str) -> str:
    """The text with each place replaced by its type's placeholder, all else as it is."""
    out, at = [], 0
    for start, end, kind in personal_places(text):
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join(out) + text[at:]


def find_personal(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys..., start_char INT, end_char INT, pii_type), a row per place; no shuffle."""
    source = df.select(*keys, F.col(text_col).alias("text")).where(F.length("text") > 3)
    fields = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends, kinds = [], [], [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                for start, end, kind in personal_places(text):
                    rows.append(i)
                    starts.append(start)
                    ends.append(end)
                    kinds.append(kind)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(len(keys))), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.string())], [*keys, "start_char", "end_char", "pii_type"]
            )

    return source.mapInArrow(run, f"{fields}, start_char int, end_char int, pii_type string")


def redact(df: DataFrame, text_col: str) -> DataFrame:
    """df with text_col redacted; nulls stay null. Other columns pass through unchanged."""
    position = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if t is None else redacted(t) for t in batch.column(position).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == position else c for k, c in enumerate(batch.columns)], schema=pa.schema([f if k != position else pa.field(f.name, pa.string()) for k, f in enumerate(batch.schema)]))

    return df.mapInArrow(run, df.schema)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(report_texts(spark, sf_dir), ["source_table", "record_key"], "text").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, record_key, text) with placeholders, redelivered rows once."""
    return redact(report_texts(spark, sf_dir), "text").distinct()
