"""Sentence units of texts in any language and script.

Blank lines, headings, list entries and, in scripts that write no blanks between
words, line breaks settle unit ends by layout. Inside the stretches between them a
semi-Markov dynamic program chooses whole spans between candidate ends. The score of
a span joins its opening word (after the mark before it), its closing word and mark,
its length and content (a short span without a word or of one clipped word is hardly
a sentence), and its quotations: every quotation or bracket that is open at its start
or its end counts against it, however long the quotation is. Which straight quotation
marks belong together is part of the program's state, so that a stray one (an inch
sign) is found together with the spans. The program is exact and linear in the number
of candidates, as only short and long spans depend on where they began.

Defined cases: null and blank texts have no unit; a text without any end mark is one
unit a paragraph; the stated language is not used; texts of any length are read
whole; repeated ids give the units of each of their rows.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.session import read_table, spread

WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
SOLID = re.compile(f"[^{WS}]")
BLANKS = re.compile(f"[{WS}]+")
MARK = re.compile("[.!?…]+|[。！？｡．؟।॥]+")
FULL_MARKS = "。！？｡؟।॥"
STRAIGHT = re.compile('"')
CLOSE_RUN = re.compile("(?:[\"'”“’»«)\\]）」』》]|[ \xa0\u2009\u202f]»)+")
PAIRS = re.compile("[\"„“”«»()\\[\\]（）「」『』《》]")
CLOSES = {")": "(", "]": "[", "）": "（", "」": "「", "』": "『", "》": "《", "”": "“„"}
DENSE = "฀-๿぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
DENSE_CHAR = re.compile(f"[{DENSE}]")
THAI = re.compile("[฀-๿]")
LETTER = re.compile(r"[^\W\d_]")
NEXT_WORD = re.compile(r"\W*(\w[\w\-]*)")
TAIL = re.compile(r"[A-Za-z0-9.\-]*$")
BULLET = re.compile(rf"(?:[-*•–—‣▪◦·●○■□✓+o]|\(?[a-z]\)|\(?\d{{1,3}}\))[{WS}]+[^{WS}]")
NUMBERED = re.compile(rf"(\d{{1,3}})\.[{WS}]+[^{WS}]")
CLIPPED = re.compile(r"[^\W\d_]{1,3}\.$")
WORD = re.compile(r"\w+")
COUNTED = re.compile(rf"\d+(?:[.,]\d+)*[{WS}]+(\w)")
ROMAN = re.compile(r"[IVX]+$")
NUMBER = re.compile(r"\d+$")
DATE = re.compile(r"\d{1,2}\.\d{1,2}\.(?:\d{2}|\d{4})$|\d{4}[-/]\d\d[-/]\d\d$")
DOTTED = re.compile(r"(?:[^\W\d_]\.-?)+[^\W\d_]$|.*\.[^\W\d_]$")

# Abbreviations that do not end a sentence, without their last full stop, lower-cased.
INNER = frozenset(
    """dr drs prof nr nrn no ca bzw z z.b d.h v.a z.n i.d.f i.d.r u.u s.u vgl abb tab lt med abt bd s zi temp max min inkl exkl einschl evtl ggf gem geb abs art str hr fr hrn st sog bed ref bez dipl ing
    approx fig figs vs cf e.g i.e mr mrs ms jr vol pp sec env c.-à-d mme mlle m sr sra dra dres ud p.ej ej pág núm v ff.s g.g.f resp rd stk kl jg hl jh
    ок рис см т.е т.д проф им стр гл ул д-р акад напр дом кв डॉ श्री प्रो د นพ พญ""".split()
)
# Months and nouns that, after a number and a full stop, make it an ordinal whatever stands before.
ORDINAL_NOUNS = frozenset(
    """januar februar märz april mai juni juli august september oktober november dezember jänner tag tage tages zyklus zyklen lebensjahr lebensjahres lebensmonat lebenswoche og ug etage stock jahrhundert
    quartal postoperativen schwangerschaftswoche ssw trimenon""".split()
)
#: Ends of compound nouns that are clipped like the word alone: Auftragsnr., Lindenstr.
CLIPPED_ENDS = ("nr", "str")
ORDINAL_HEADS = frozenset("am im vom zum dem der den des das die beim ins ans jeder jedem jeden bis seit ab ein einer einem".split())

#: Cost of each quotation or bracket that is open at one end of a span, and of a straight quotation mark left without its partner.
OPEN_COST, STRAY_COST = 4.5, 6.0
#: A span of at most SHORT characters is scored by its content; one of more than LONG is less likely a single sentence.
SHORT, LONG = 12, 600
#: A cut of at least this gain always pays, as two spans become at most so much worse by being cut.
SURE = 6.0
#: A cut below this gain can never pay, as two spans become at most so much better by being cut.
LEAST_GAIN = -3.5


def pairs_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(open, close) offsets of quotations and brackets of two forms that are closed within [start, end)."""
    stack: list[tuple[str, int]] = []
    found = []
    for m in PAIRS.finditer(text, start, end):
        c, i = m.group(), m.start()
        if c == '"':
            continue
        wanted = CLOSES.get(c)
        if c == "“":
            wanted = "„"
        elif c in "«»":
            wanted = "»" if c == "«" else "«"
        k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in wanted), -1) if wanted else -1
        if k >= 0:
            found.append((stack[k][1], i))
            del stack[k:]
        elif c not in ")]）」』》”":
            stack.append((c, i))
    return found


def words_before(text: str, start: int, mark: int) -> tuple[str, str]:
    """The word that ends at `mark` and the one before it; of a word of over 64 characters only the end, which no rule tells apart from the whole."""
    if mark <= start or text[mark - 1] in WS_SET:
        return "", ""
    size = 64
    while True:
        low = max(start, mark - size)
        parts = text[low:mark].rsplit(None, 2)
        if low == start or len(parts) > 1 or len(parts[-1]) >= 64:
            return parts[-1][-64:], parts[-2] if len(parts) > 1 else ""
        size *= 2


def closing_score(text: str, start: int, mark: int, end: int) -> float:
    """How well the word and mark at text[mark:end] close a sentence."""
    marks = text[mark:end]
    if marks[0] in FULL_MARKS or "!" in marks or "?" in marks:
        return 3.0
    if "…" in marks or ".." in marks:
        return 1.5
    word, previous = words_before(text, start, mark)
    word = word.lstrip("(„\"«[“‚'")
    if not word.isascii() and DENSE_CHAR.search(word):
        word, previous = TAIL.search(word).group() or word[-1], ""
    if not word:
        return 1.0
    noun = ""
    if len(word) <= 2:
        following = NEXT_WORD.match(text, end)
        noun = following.group(1) if following else ""
    return closing_word(word, previous if len(word) <= 4 else "", noun)


@lru_cache(1 << 16)
def closing_word(word: str, previous: str, noun: str) -> float:
    """Score of a word before a full stop; the word before it and the one after it tell only about short words."""
    if word[-1] in ")]）\"”“»%°":
        return 3.0
    lower = word.lower()
    after_number = bool(previous) and (previous[-1].isdigit() or bool(ROMAN.match(previous)))
    if NUMBER.match(word):
        if len(word) > 2:
            return 3.0
        if noun.lower() in ORDINAL_NOUNS or previous.lower() in ORDINAL_HEADS:
            return -6.0
        return 1.5 if previous else -2.0
    if DATE.match(word):
        return 3.0
    if len(word) == 1:
        if not word.isalpha() or after_number:
            return 2.0
        joined = previous.lower() + lower
        if previous.endswith(".") and joined in ("p.o", "s.c", "i.m", "s.l", "s.o", "s.u", "o.b", "u.a", "i.v", "b.w", "a.m", "p.m", "q.d"):
            return 1.5 if joined != "i.v" or noun not in ("Gabe", "Injektion", "Kontrastmittel", "Kontrastmittelgabe") else -6.0
        return -6.0
    if (lower in INNER or lower.endswith(CLIPPED_ENDS)) and not (after_number and lower in ("см", "m", "s", "v", "min", "no", "d")):
        return -6.0
    if DOTTED.match(lower):
        return 1.0
    if lower in ("usw", "etc", "ff", "tgl", "wö", "stdl", "тыс", "сут", "г", "mg", "ml"):
        return 1.5
    if len(word) <= 3 and word.islower() and not after_number and not re.search("[aeiouyäöüéèêàáíóúаеёиоуыэюя]", lower) and word.isascii():
        return -2.0
    return 3.0


def opening_score(text: str, end: int, stop: int, marks: str, spaced: bool) -> float:
    """How well the text from `end` opens a sentence after the given mark."""
    i = end
    while i < stop and not (text[i].isalnum() or text[i] in WS):
        if text[i] in ",;:)]»”’'/-–—=+%" and i == end:
            return -8.0
        i += 1
    opener = i > end and text[end] in "„“\"«¡¿‚‘([（「『»"
    if i >= stop or text[i] in WS:
        # A mark or symbol on its own: look at what follows it.
        j = i
        while j < stop and not text[j].isalnum():
            j += 1
        if j >= stop:
            return 1.0 if opener else -1.0
        i = j
    c = text[i]
    full = marks[0] in FULL_MARKS
    if full:
        return 4.0
    if c.isdigit():
        if not spaced:
            return -8.0
        m = COUNTED.match(text, i, stop)
        return 2.0 if m and m.group(1).isalpha() and (m.group(1).isupper() or "!" in marks or "?" in marks) else -2.5
    if c.islower():
        word = WORD.match(text, i, stop).group()
        return 0.0 if spaced and re.search(r"[A-Z\d]", word) and "." in marks and len(marks) == 1 else (-8.0 if not opener else -3.0)
    if c.isupper() or c.istitle():
        if spaced:
            return 3.0
        word = WORD.match(text, i, stop).group()
        return 1.5 if len(word) > 1 or opener else -2.0
    if DENSE_CHAR.match(c):
        return 2.0 if "!" in marks or "?" in marks or spaced else -6.0
    return 3.0 if spaced or "!" in marks or "?" in marks else -6.0


def candidates(text: str, start: int, stop: int) -> list[tuple[int, float]]:
    """(end offset, gain) of a stretch, without its own end: how well what stands before a mark closes and what follows opens a sentence.

    Marks inside quotations are candidates like others. Closing marks right after an
    end mark belong to it; a straight quotation mark there may close or open one, so
    that both ends are offered.
    """
    found = []
    reached = start
    for m in MARK.finditer(text, start, stop):
        mark, end = m.span()
        if mark < reached:
            continue
        marks = m.group()
        c = text[end] if end < stop else ""
        if marks == "." and (c.isdigit() or (c.islower() and c.isascii())):
            continue
        closed = CLOSE_RUN.match(text, end, stop)
        ends = [end]
        if closed:
            last = closed.end()
            ends = [end, last] if c in '"“«' and last < stop and text[last] not in WS_SET else [last]
        closing = None
        for end in ends:
            if end >= stop:
                break
            quoted = end > m.end()
            spaced = text[end] in WS_SET
            i = end
            while i < stop and text[i] in WS_SET:
                i += 1
            if i >= stop:
                break
            if quoted and ((text[i].isalpha() and not (text[i].isupper() or text[i].islower())) or text[i] in "，、,；;：:—–-。"):
                continue  # without case, words after a quotation belong to its sentence
            if closing is None:
                closing = closing_score(text, start, mark, m.end())
            gain = closing + opening_score(text, i, stop, marks, spaced)
            if not spaced and not quoted and marks == "." and gain > 0:
                word = words_before(text, start, mark)[0]
                if len(word) < 2 or not (word[-1].islower() or word[-1].isdigit() or word[-1] in ")%"):
                    gain = -4.0
            reached = end
            if gain >= LEAST_GAIN:
                found.append((end, gain))
    if THAI.search(text, start, stop):
        for m in BLANKS.finditer(text, start, stop):
            a, b = m.span()
            if a == start or b >= stop:
                continue
            left, right = text[a - 1], text[b]
            if any(c.isdigit() or c == "." or (c.isalpha() and c < "ɐ") for c in (left, right)):
                continue
            if THAI.match(left) or THAI.match(right):
                found.append((a, 8.0))
        found = sorted(dict(found).items())
    return found


def span_score(text: str, start: int, end: int) -> float:
    """What a span's length and content say, opening and closing word apart; never above 0 and never under -3."""
    size = end - start
    if size > LONG:
        return -1.0
    if size > SHORT:
        return 0.0
    part = text[start:end].strip()
    if not LETTER.search(part):
        return -3.0  # figures and marks alone
    return -1.5 if CLIPPED.match(part) else -0.5 if size < 6 else 0.0


def open_levels(text: str, start: int, stop: int, ends: list[int]) -> tuple[list[int], list[int]]:
    """At each end: closed quotations and brackets that it stands in, and straight quotation marks before it."""
    events = sorted(x for o, c in pairs_of(text, start, stop) for x in ((o, 1), (c, -1)))
    straight = [m.start() for m in STRAIGHT.finditer(text, start, stop)] if '"' in text[start:stop] else []
    depth, k, s, levels, counts = 0, 0, 0, [], []
    for end in ends:
        while k < len(events) and events[k][0] < end:
            depth += events[k][1]
            k += 1
        while s < len(straight) and straight[s] < end:
            s += 1
        levels.append(depth)
        counts.append(s)
    return levels, counts


def spans(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """Best sequence of spans that cover the stretch.

    An end outside quotations whose gain no span across it could make up for is always
    cut at, so that the program runs between such ends; the result is the same.
    """
    found = candidates(text, start, stop)
    if not found:
        return [(start, stop)]
    ends = [start, *(e for e, _ in found), stop]
    gains = [0.0, *(g for _, g in found), 0.0]
    last = len(ends) - 1
    levels, counts = open_levels(text, start, stop, ends) if PAIRS.search(text, start, stop) else (None, None)
    even = counts is None or counts[last] % 2 == 0
    cuts, low = [], 0
    for j in range(1, last + 1):
        if j == last or (gains[j] >= SURE and (counts is None or (not levels[j] and (counts[j] % 2 == 0 if even else counts[j] == 0)))):
            if j == low + 1:
                cuts.append((ends[low], ends[j]))
            else:
                own = slice(low, j + 1)
                size = j + 1 - low
                cuts += best_spans(text, ends[own], gains[own], levels[own] if levels else [0] * size, counts[own] if counts else [0] * size)
            low = j
    return cuts


def best_spans(text: str, ends: list[int], gains: list[float], levels: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """The semi-Markov program from the first of the ends to the last.

    A layer of the program is the number (0 or 1) of straight quotation marks given up
    as stray so far; with it their parity tells whether one is open at an end.
    """
    last = len(ends) - 1
    layers = (0, 1) if counts[last] % 2 else (0,)
    best = [[-1e9] * (last + 1) for _ in layers]
    came = [[(0, 0)] * (last + 1) for _ in layers]
    best[0][0] = 0.0
    for layer in layers:
        score = best[layer]
        window: deque[int] = deque()  # starts of spans of middle length, best first
        middle, far, far_at = 0, -1e9, 0  # next start to enter the window; best start of a long span
        for j in range(1, last + 1):
            end = ends[j]
            top, at = -1e9, 0
            while end - ends[middle] > SHORT:
                while window and score[window[-1]] <= score[middle]:
                    window.pop()
                window.append(middle)
                middle += 1
            while window and end - ends[window[0]] > LONG:
                i = window.popleft()
                if score[i] > far:
                    far, far_at = score[i], i
            if window:
                top, at = score[window[0]], window[0]
            if far - 1.0 > top:
                top, at = far - 1.0, far_at
            for i in range(middle, j):
                value = score[i] + span_score(text, ends[i], end)
                if value > top:
                    top, at = value, i
            inner = j < last
            opened = (counts[j] + layer) % 2
            value = top + gains[j] - 2 * OPEN_COST * levels[j] * inner
            kept = value - (2 * OPEN_COST if inner else STRAY_COST) * opened
            if kept > score[j]:
                score[j], came[layer][j] = kept, (layer, at)
            if layer == 0 and len(layers) > 1 and opened:
                best[1][j], came[1][j] = value - STRAY_COST, (0, at)
    layer = max(layers, key=lambda n: best[n][last])
    cuts, j = [], last
    while j:
        before, i = came[layer][j]
        cuts.append((ends[i], ends[j]))
        layer, j = before, i
    return cuts[::-1]


def is_heading(line: str, done: bool) -> bool:
    """A line that ends with a colon and holds no end mark, where nothing is unfinished before it; elsewhere only a single word without figures."""
    if line[-1] not in ":：" or MARK.search(line, 0, len(line) - 1):
        return False
    return done or not any(c.isdigit() or c in WS_SET for c in line)


def dense(line: str) -> bool:
    if max(line) < "\u0e00":
        return False
    letters = len(LETTER.findall(line))
    return letters > 0 and len(DENSE_CHAR.findall(line)) * 2 >= letters


def stretches(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): layout's pieces of a text; whole pieces are units as they are."""
    open_at, open_end, last_line, last_dense, listed, number = -1, 0, "", False, False, -1
    at, size = 0, len(text)
    while at <= size:
        m = LINE.search(text, at)
        end, following = (m.start(), m.end()) if m else (size, size + 1)
        first = SOLID.search(text, at, end)
        if not first:
            if open_at >= 0:
                yield open_at, open_end, False
            open_at, listed, number, last_line = -1, False, -1, ""
            at = following
            continue
        a = first.start()
        line = text[a:end].rstrip()
        b = a + len(line)
        fresh = open_at < 0
        bullet = BULLET.match(line)
        numbered = NUMBERED.match(line)
        done = fresh or bool(MARK.search(last_line[-3:]))
        entry = bool(bullet) and done or bool(bullet) and line[0] in "•‣▪◦●*"
        if numbered and (fresh or (number >= 0 and int(numbered.group(1)) == number + 1)):
            entry = True
        is_dense = dense(line)
        if entry or is_heading(line, done):
            if open_at >= 0:
                yield open_at, open_end, False
            yield a, b, True
            open_at, listed = -1, entry
            number = int(numbered.group(1)) if entry and numbered else -1
            last_line = ""
        else:
            if open_at >= 0 and (is_dense or last_dense):
                yield open_at, open_end, False
                open_at = -1
            if open_at < 0:
                open_at = a
            open_end, last_line, number = b, line, -1
        last_dense = is_dense
        at = following
    if open_at >= 0:
        yield open_at, open_end, False


def sentence_units(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text in code points."""
    units = []
    for start, stop, whole in stretches(text):
        for a, b in [(start, stop)] if whole else spans(text, start, stop):
            while a < b and text[a] in WS_SET:
                a += 1
            while b > a and text[b - 1] in WS_SET:
                b -= 1
            if a < b:
                units.append((a, b))
    return units


WS_SET = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WS}]", c))


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_char INT, end_char INT), one row per sentence unit; no shuffle."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, flat = [], []
            for text in batch.column(1).to_pylist():
                units = sentence_units(text)
                counts.append(len(units))
                flat += units
            rows = np.repeat(np.arange(batch.num_rows), counts)
            edge = np.array(flat, np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(edge[:, 0].copy()), pa.array(edge[:, 1].copy())], ["doc_id", "start_char", "end_char"])

    return spread(source).mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, start_char int, end_char int")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(read_table(spark, sf_dir, "documents"))


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units by length class (powers of two of their characters)."""
    size = F.floor(F.log2(F.col("end_char") - F.col("start_char"))).cast("int")
    return p8_found(spark, sf_dir).groupBy(size.alias("log2_chars")).agg(F.count("*").alias("units"))
