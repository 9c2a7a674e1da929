"""Defects of question-answer pairs.

The question's suffix automaton is walked with the answer to measure how much of the
answer it covers and how much of the question comes back; an automaton over phrases
finds refusals; stopword and script votes name the languages; delimiter stacks and the
state of the last clause find answers that break off. Where an answer without an end
mark shows neither, its last word is judged by all pairs: a word that nobody writes
but that begins known words is cut off, and a word far likelier inside a text than
before an end mark leaves its clause open. The likelihood ratio is one of rates, so
that it settles as the table grows. Counts of words are added up within batches and
joined back by word; nothing grows on the driver.

Defined cases: a null answer is `empty`; a null or blank question copies nothing
and has no language; a pair gets the first type that applies in the order of TYPES;
repeated rows of one qa_id give one row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quellwerk.session import cut_lineage, read_table, spread

TYPES = ("empty", "refusal", "copies_question", "other_language", "truncated")

# Answers that say nothing, lower-cased, without white space and outer punctuation.
PLACEHOLDERS = frozenset(
    "none null nil nan n/a na n.a n.v k.a ka leer empty todo tbd tba xxx xx x unbekannt unknown keineangabe keineangaben keineantwort ohneangabe ohneangaben entfällt noanswer noresponse missing fehlt platzhalter placeholder undefined".split()
)

# Refusing phrases that need no further sign.
REFUSALS = """
als ki-assistent|als ki |als künstliche intelligenz|als assistent|als sprachmodell|nur ein sprachmodell|bin ein sprachmodell|meine befugnisse|mangels befugnis|nicht befugt|nicht berechtigt
kann ich keine auskunft|darf ich keine auskunft|keine auskunft geben|von mir erhalten sie|von mir unbeantwortet|die beantwortung ablehnen|muss ich ablehnen|lehne ich ab|ich lehne|anfrage komme ich nicht nach|komme ich nicht nach|kann ich nicht nachkommen
nicht beantworten kann|nicht beantworten darf|kann ich leider nicht|kann ich nicht beantworten|kann ich das nicht|darf ich nicht|darf ich nichts|nichts dazu sagen|möchte ich mich nicht|möchte ich nicht|will ich nicht|werde ich nicht|kann ich ihnen nicht|kann ich hier nicht|kann ich dazu|kann ich hierzu|kann ich nicht|ich kann nicht|ich kann das nicht|ich kann leider|ich kann diese|ich kann dazu|ich kann hierzu|ich darf|nicht weiterhelfen|nicht behilflich
verweigere ich|ich verweigere|sehe ich mich nicht|bin ich nicht in der lage|ich bin nicht in der lage|ist es mir nicht|ist mir nicht möglich|mir nicht erlaubt|mir nicht gestattet|steht mir nicht zu|mir fehlt die berechtigung|ich muss passen|enthalte ich mich|ich enthalte mich|dazu sage ich nichts|hierzu sage ich nichts|äußere ich mich nicht|gebe ich keine|ich gebe keine|erteile ich keine|mache ich keine angaben
as an ai|as an assistant|as a language model|i am sorry|i'm sorry|i am unable|i'm unable|i cannot|i can't|i can not|i am not able|i'm not able|i will not|i won't|i must decline|i decline|i am not allowed|i'm not allowed|i am not authorized|i'd rather not|i would rather not|cannot answer this|unable to answer|unable to help|can't help with|cannot help with|not comfortable answering
je ne peux|je ne suis pas en mesure|je suis désolé|je regrette, mais|je refuse|je préfère ne pas|je ne souhaite pas|en tant qu'assistant|en tant qu’assistant|en tant qu'ia
no puedo responder|no puedo ayudar|no puedo contestar|no puedo proporcionar|no puedo dar|lo siento|no me es posible|no estoy autorizado|como asistente|como modelo de lenguaje|prefiero no
não posso responder|não posso ajudar|non posso rispondere|mi dispiace|ik kan deze vraag|het spijt me
не могу ответить|не могу помочь|не могу дать|к сожалению, я|извините|я не вправе|как ассистент|отказываюсь
お答えできません|回答できません|申し訳|お手伝いできません|回答を控え
无法回答|不能回答|抱歉|无法提供|无法帮助|拒绝回答
لا أستطيع|لا يمكنني|أعتذر|عذرا|आसमर्थ|उत्तर नहीं दे सकता|क्षमा करें|माफ़ कीजिए|ไม่สามารถตอบ|ขออภัย
"""
# Signs that count only together, one of each line.
SELF_SIGNS = "ich |mir |mich |meine| ki-|assistent|sprachmodell|leider|bedaure|bedauere|tut mir leid|entschuldig"
FIRST_PERSON = " kann ich | darf ich | möchte ich | will ich | werde ich | gebe ich | erteile ich | mache ich | sage ich | beantworte ich | äußere ich | nehme ich | leiste ich | treffe ich | ich kann | ich darf | ich möchte | ich will | ich werde | ich gebe | ich erteile | ich mache | ich sage | ich beantworte | ich äußere | ich nehme | ich treffe "
NEGATIONS = " nicht | nicht.| nicht,| nicht!| nichts | nichts.| keine | keinen | keinerlei | kein "
DECLINE_SIGNS = "nicht beantwort|unbeantwortet|keine antwort|keine auskunft|keine einschätzung|keine aussage|keine stellung|nichts sagen|nichts mitteilen|nicht äußern|nicht weiterhelfen|nicht helfen|ablehnen|nicht beurteilen|nicht einschätzen|nicht möglich, eine|nicht zuständig|nicht erlaubt|nicht gestattet|nicht nachkommen|komme ich nicht nach"

# Frequent function words by language; a word of several languages votes for each.
STOPWORDS = {
    "de": "der die das den dem des ein eine einer eines einem einen und oder ist sind war wurde wird werden mit von vom im in am an auf aus bei zur zum zu für über unter nach seit bis ab vor kein keine keinen nicht auch als wie wurden sich es er sie wir ich welche gilt welcher wieder deutlich zeigt bereits gegenüber jedoch sowie durch ohne dort davon zuletzt gut links rechts erstmals kam",
    "en": "the a an and or is are was were be been of in on at to for with from by during after before under over no not without since then than this that which what how she he it they said please bring was once if occurs report return there has have had does improved measures used see given recommended evidence between about",
    "fr": "le la les un une des du de et ou est sont était a été au aux en dans par pour avec sans depuis sur ce cette il elle je nous vous ne pas plus que qui se son sa ses cela la l’ d’ avant après plus pendant puis lors sous faut-il a-t-on",
    "es": "el la los las un una unos de del y o es son fue ha se al en con sin por para desde su sus no que a lo le me si más antes tras durante hay está este esta debe debido cuando hasta luego frente",
    "it": "il lo la gli le un una di del della e è sono con senza per da nel nella non che si paziente stato",
    "pt": "o os as um uma de do da e é são foi com sem por para em no na não que se ao",
    "nl": "de het een en van is zijn was met voor op niet bij naar uit door werd",
}
# Letters and marks that only one of these languages writes.
MARKS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "„": "de", "¡": "es", "¿": "es", "ñ": "es", "ó": "es", "í": "es", "ú": "es", "á": "es", "è": "fr", "ê": "fr", "à": "fr", "ç": "fr", "é": "fr", "œ": "fr", "î": "fr", "û": "fr", "ù": "fr", "ã": "pt", "õ": "pt"}
SCRIPTS = [("ru", "Ѐ", "ӿ"), ("el", "Ͱ", "Ͽ"), ("he", "֐", "׿"), ("ar", "؀", "ۿ"), ("hi", "ऀ", "ॿ"), ("th", "฀", "๿"), ("ja", "぀", "ヿ"), ("ko", "가", "힣"), ("zh", "一", "鿿")]

# Words after which a German, English, French or Spanish clause cannot end.
OPEN_WORDS = frozenset(
    "der die das dem den des ein eine einer eines einem einen und oder sowie bzw wurden mit von vom im in am bei zur zum zu für über unter nach seit bis vor aus auf an ab durch gegen ohne um als wie wird wurde dass weil sowie zwischen gegenüber laut lt ca max vgl z the a an of in on at to for with from by and or is was were le la les un une du et au en dans par pour avec el los las una del y con sin por para se".split()
)
#: A separable prefix may end a clause if its verb stands before it.
PREFIX_VERBS = {"ab": r"\b(?:lehn|nahm|nimmt|nehmen|kl[aä]ng|kling|fiel|fäll|setz|brach|bricht|schlo|schlie|wich|weich)", "an": r"\b(?:gab|gibt|geben|hielt|hält|steig|stieg|sprach|spricht|schlo|schlie|ordne)", "auf": r"\b(?:trat|tritt|wach|nahm|nimmt|klär|fiel|fäll|such)", "zu": r"\b(?:nahm|nimmt|nehmen|stimm|sag|hör|ließ|läss)", "aus": r"\b(?:schlo|schlie|fiel|fäll|sah|sieht|reich|lös)", "vor": r"\b(?:lag|liegt|lagen|liegen|stell|sah|sieht|nahm|nimmt)", "ein": r"\b(?:stell|trat|tritt|nahm|nimmt|leit|setz|tr[aä]f)", "mit": r"\b(?:teil|brach|bring|nahm|nimmt)", "nach": r"\b(?:lie|läss|komm|weis|wies)", "bei": r"\b(?:trug|träg|behielt|behäl)", "durch": r"\b(?:führ|lief|läuf)", "um": r"\b(?:stell|ging|geh)"}

END_MARK = re.compile(r"[.!?。！？؟।%)\]}\"'“”»«’』」]\s*$")
BROKEN = re.compile(r"(?:\.\.+|…)[\])\"'”“]*\s*$|[\[(]\s*(?:\.\.\.|…)\s*[\])]\s*$")
PART_DATE = re.compile(r"\b(?:am|vom|zum|bis|seit|dem|den|ab|on)\s+\d{1,2}(?:\.\d{0,2})?\.?$")
PARTICIPLE = re.compile(r"\b(?:\w*ge\w+(?:en|t)|\w+iert|(?:ver|be|ent|er|zer)\w+(?:en|t)) \w+$")
CLAUSE_END = re.compile(r"\b(?:usw|etc|ge\w+(?:en|t)|\w+iert|(?:ver|be|ent|er|zer)\w+(?:en|t))$")
NOTHING = re.compile(r"[\W_]+", re.UNICODE)
QUOTED = re.compile(r"„[^“”\"]*[“”\"]|«[^»]*»|\"[^\"]*\"")
SPACES = re.compile(r"\s+")
TOKEN_EDGE = "\"'“”„»«’‚‘()[]{}<>¡¿.,;:!?…"
NUMBER = re.compile(r"\d+")
OPENERS = {"(": ")", "[": "]", "{": "}", "„": "“”\"", "«": "»", "「": "」", "（": "）"}
CLOSERS = {")": "([{（", "]": "[", "}": "{", "“": "„", "”": "„", "»": "«", "」": "「", "）": "（("}

_state: dict = {}


class SuffixAutomaton:
    """All substrings of a text; states have a transition table, a link and a length."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def covered(self, text: str, least: int) -> int:
        """Characters of text inside matches of at least `least` characters."""
        state, size, until, total = 0, 0, 0, 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
                if size >= least:
                    total += i + 1 - max(until, i + 1 - size)
                    until = i + 1
            else:
                size = 0
        return total


def automata():
    if "automata" not in _state:
        built = ahocorasick.Automaton()
        for line in REFUSALS.strip().splitlines():
            for phrase in line.split("|"):
                built.add_word(phrase, 4)
        for phrase in SELF_SIGNS.split("|"):
            built.add_word(phrase, 1)
        for signs, value in ((DECLINE_SIGNS, 2), (FIRST_PERSON, 8), (NEGATIONS, 16)):
            for phrase in signs.split("|"):
                if phrase not in built:
                    built.add_word(phrase, value)
        built.make_automaton()
        words: dict[str, list[str]] = {}
        for language, listed in STOPWORDS.items():
            for word in dict.fromkeys(listed.split()):
                words.setdefault(word, []).append(language)
        _state["automata"] = built, words
    return _state["automata"]


def says_nothing(answer: str) -> bool:
    bare = unicodedata.normalize("NFKC", answer).lower()
    return not NOTHING.sub("", bare) or SPACES.sub("", bare).strip(TOKEN_EDGE + "-–—*#=_/|") in PLACEHOLDERS


def refuses(answer: str) -> bool:
    found = 0
    own = QUOTED.sub(" ", answer)  # what a quoted patient says refuses nothing
    for _, sign in automata()[0].iter(" " + SPACES.sub(" ", own.lower()) + " "):
        found |= sign
    return bool(found & 4) or found & 3 == 3 or found & 24 == 24


def plain(text: str) -> str:
    return NOTHING.sub(" ", unicodedata.normalize("NFKC", text).lower()).strip()


def copies(question: str, answer: str) -> bool:
    """The answer lies in the question almost wholly, and most of the question comes back."""
    q, a = plain(question), plain(answer)
    if len(q) < 4 or len(a) < 0.5 * len(q) or len(a) > 2 * len(q) + 20:
        return False
    least = 4
    wanted = max(0.65 * len(q), 0.72 * len(a))
    # A run of four characters covers four at most: too few of them spare the walk.
    runs = {q[i : i + least] for i in range(len(q) - least + 1)}
    if least * sum(a[i : i + least] in runs for i in range(len(a) - least + 1)) < wanted:
        return False
    covered = prompt_automaton(q).covered(a, least)
    return covered >= wanted and len(a) - covered <= max(10, 0.3 * len(q))


@lru_cache(4096)
def prompt_automaton(question: str) -> SuffixAutomaton:
    return SuffixAutomaton(question)


def votes(text: str) -> dict[str, float]:
    """Votes by language; letters of another script outvote words."""
    count: dict[str, float] = {}
    _, stopwords = automata()
    for token in text.replace("’", "’ ").split():
        if len(token) <= 4 and token.strip(TOKEN_EDGE).isupper() and len(text) > 12:
            continue  # abbreviations
        token = token.lower()
        for language in stopwords.get(token.strip(TOKEN_EDGE), ()):
            count[language] = count.get(language, 0) + 1
    if text.isascii():
        return count
    lower = text.lower()
    for mark, language in MARKS.items():
        if mark in lower:
            count[language] = count.get(language, 0) + min(2, lower.count(mark)) * 0.75
    if max(lower) <= "ʯ":
        return count
    letters = 0
    scripts: dict[str, int] = {}
    for c in lower:
        if c.isalpha():
            letters += 1
            if c > "ʯ":
                for language, low, high in SCRIPTS:
                    if low <= c <= high:
                        scripts[language] = scripts.get(language, 0) + 1
                        break
    if scripts and letters:
        if "ja" in scripts:
            scripts["ja"] += scripts.pop("zh", 0)
        best = max(scripts, key=scripts.get)
        if scripts[best] >= 0.3 * letters and scripts[best] >= 4:
            count[best] = count.get(best, 0) + 10
    return count


def other_language(question: str, answer: str) -> bool:
    asked, said = votes(question), votes(answer)
    if not asked or not said:
        return False
    most = max(asked.values())
    likely = [language for language, count in asked.items() if count == most]
    best = max(said, key=said.get)
    return best not in likely and said[best] >= 1.75 and said[best] > 1.5 * max(said.get(x, 0) for x in likely) + 0.5


def unclosed(answer: str) -> bool:
    """A bracket or quotation is still open at the end."""
    stack = []
    for i, c in enumerate(answer):
        if c in OPENERS:
            stack.append(c)
        elif c in CLOSERS:
            if stack and stack[-1] in CLOSERS[c]:
                stack.pop()
            elif c == "“" and not stack:
                stack.append("“")
        elif c == '"' and stack and stack[-1] == "„":
            stack.pop()
    return bool(stack)


def breaks_off(answer: str) -> bool:
    """Signs within the answer itself that it is not complete."""
    end = answer.rstrip()
    if BROKEN.search(end):
        before = re.sub(r"[\s\[\](){}.…]+$", "", end)
        gap = end[len(before) : len(before) + 1]
        # An ellipsis set off by a blank after a clause's last word may be the sentence's own.
        return not (gap == " " and CLAUSE_END.search(before))
    if end[-1:] in ",;(/[{„«&+" or (end[-1:] in "-–" and end[-2:-1].isalpha()):
        return True
    if unclosed(end):
        return True
    if END_MARK.search(end) and not PART_DATE.search(end):
        return False
    if PART_DATE.search(end):
        return True
    last = end.split()[-1].strip(TOKEN_EDGE).lower()
    if last in ("wird", "wurde", "wurden") and PARTICIPLE.search(end):
        return False
    if last in OPEN_WORDS and not end.split()[-1].isupper():
        verb = PREFIX_VERBS.get(last)
        return not (verb and re.search(verb, end, re.IGNORECASE)) and len(end.split()) > 1
    return False


def word_uses(text: str) -> tuple[list[str], list[str]]:
    """Words of a text inside its sentences, and words before an end mark; each word before those also marked by >."""
    inside, ends = [], []
    tokens = [t for t in text.split() if t.strip("…") and t != "..."]
    closed = bool(END_MARK.search(text)) or text.rstrip().endswith((" ...", " …"))
    shapes = NUMBER.sub("0", " ".join(tokens).lower()).split(" ")
    before, last = "", len(tokens) - 1
    for i, token in enumerate(tokens):
        word = shapes[i].strip(TOKEN_EDGE)
        if not word:
            continue
        final = i == last
        if not final or closed:
            listed = ends if final or (token[-1] in ".!?" and tokens[i + 1][0].isupper() and len(word) > 2) else inside
            listed.append(word)
            if before:
                listed.append(before + ">")
        before = word
    return inside, ends


def shape(token: str) -> str:
    return NUMBER.sub("0", token.strip(TOKEN_EDGE).lower())


def judge(question: str | None, answer: str | None) -> str | None:
    if answer is None or says_nothing(answer):
        return "empty"
    if refuses(answer):
        return "refusal"
    if question and copies(question, answer):
        return "copies_question"
    if question and other_language(question, answer):
        return "other_language"
    return "truncated" if breaks_off(answer) else None


#: How much likelier a last word must be inside a text than before an end mark (as rates over all pairs) to leave its clause open.
OPEN_RATIO = 3.0
#: Beginnings of words are listed up to this length; longer ones are compared with their neighbour in order.
LISTED_START = 39


def judged_pairs(df: DataFrame, id_col: str = "qa_id", question_col: str = "question", answer_col: str = "answer_text") -> DataFrame:
    """Rows of two kinds: (qa_id, defect_type, tail, before, longer), verdicts of single pairs, and (word, mid, end), uses of a word in a batch."""
    source = df.select(F.col(id_col).alias("qa_id"), F.col(question_col).alias("question"), F.col(answer_col).alias("answer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            defects, tails, mid, end = [], [], Counter(), Counter()
            for question, answer in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                defect = judge(question, answer)
                defects.append(defect)
                tokens = []
                if defect is None:
                    inside, ends = word_uses(answer)
                    mid.update(inside)
                    end.update(ends)
                    tokens = answer.split()
                open_end = len(tokens) > 1 and not END_MARK.search(answer)
                tails.append([shape(tokens[-1]), shape(tokens[-2]), len(tokens) > 3] if open_end else None)
                if question:
                    mid.update(word_uses(question)[0])
            words = list(mid.keys() | end.keys())
            rows, more = batch.num_rows, len(words)
            padded = lambda values, kind: pa.array([*values, *[None] * more], kind)
            last, before, longer = (padded([t[i] if t else None for t in tails], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.bool_())))
            ids = pa.concat_arrays([batch.column(0), pa.nulls(more, batch.column(0).type)])
            uses = [pa.array([*[None] * rows, *values], kind) for values, kind in ((words, pa.string()), ([mid[w] for w in words], pa.int64()), ([end[w] for w in words], pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, padded(defects, pa.string()), last, before, longer, *uses], ["qa_id", "defect_type", "tail", "before", "longer", "word", "mid", "end"])

    kind = source.schema["qa_id"].dataType.simpleString()
    return spread(source).mapInArrow(run, f"qa_id {kind}, defect_type string, tail string, before string, longer boolean, word string, mid bigint, end bigint")


def word_starts(tails: DataFrame, words: DataFrame) -> DataFrame:
    """(tail): tails that begin a longer word. tails: (tail); words: (word), distinct.

    Short beginnings are listed; a longer tail begins a word if it begins the next
    one in order among all that share its first characters, so no pairs are formed.
    """
    head = lambda c: F.substring(c, 1, LISTED_START)
    listed = words.select(F.explode(F.expr(f"transform(sequence(1, least(length(word) - 1, {LISTED_START})), i -> substring(word, 1, i))")).alias("tail")).distinct()
    short = tails.select("tail").distinct().where(F.length("tail") <= LISTED_START).join(listed, "tail", "left_semi")
    long_tails = tails.select(F.col("tail").alias("word"), F.lit(True).alias("asked")).distinct().where(F.length("word") > LISTED_START)
    both = words.where(F.length("word") > LISTED_START).select("word", F.lit(False).alias("asked")).unionAll(long_tails)
    both = both.groupBy("word").agg(F.max("asked").alias("asked"))
    following = F.lead("word").over(Window.partitionBy(head("word")).orderBy("word"))
    long = both.withColumn("following", following).where("asked").where(F.col("following").startswith(F.col("word"))).select(F.col("word").alias("tail"))
    return short.unionAll(long)


def defective_pairs(df: DataFrame, id_col: str = "qa_id", question_col: str = "question", answer_col: str = "answer_text") -> DataFrame:
    """(qa_id, defect_type), one row per defective pair.

    An answer without an end mark is truncated if its last word is only the beginning
    of known words, or if this word is OPEN_RATIO times likelier inside a text than
    before an end mark, unless the word before it is often the last but one.
    """
    judged = cut_lineage(judged_pairs(df, id_col, question_col, answer_col))
    pairs = judged.where("word is null").select("qa_id", "defect_type", "tail", "before", "longer")
    uses = cut_lineage(judged.where("word is not null").groupBy("word").agg(F.sum("mid").alias("mid"), F.sum("end").alias("end")))
    tails = pairs.where("defect_type is null and tail != ''").select("tail", "before").distinct()
    totals = uses.where(~F.col("word").endswith(">")).agg(F.sum("mid").alias("all_mid"), F.sum("end").alias("all_end"))  # one row
    one = uses.select(F.col("word").alias("tail"), F.col("mid").alias("mid1"), F.col("end").alias("end1"))
    follow = uses.where(F.col("word").endswith(">")).select(F.expr("substring(word, 1, length(word) - 1)").alias("before"), F.col("mid").alias("mid2"), F.col("end").alias("end2"))
    long_words = uses.where((F.length("word") > 1) & ~F.col("word").rlike("[0>]")).select("word")
    starts = word_starts(tails, long_words).withColumn("begins", F.lit(True))
    known = tails.join(one, "tail", "left").join(follow, "before", "left").join(starts, "tail", "left").na.fill(0).na.fill(False).crossJoin(F.broadcast(totals))
    in_word = (F.col("mid1") + F.col("end1") == 0) & F.col("begins")
    ratio = (F.col("mid1") + 0.5) / (F.col("end1") + 0.5) * (F.col("all_end") + 1) / (F.col("all_mid") + 1)
    in_clause = (ratio >= OPEN_RATIO) & (F.col("end2") < (F.col("mid2") + F.col("end2")) * 0.2)
    cut = known.select("tail", "before", in_word.alias("in_word"), in_clause.alias("in_clause")).where("in_word or in_clause")
    found = pairs.join(cut, ["tail", "before"], "left")
    late = F.when(F.col("in_word") | (F.col("in_clause") & F.col("longer")), "truncated")
    found = found.select("qa_id", F.coalesce("defect_type", late).alias("defect_type")).where("defect_type is not null and qa_id is not null")
    return found.groupBy("qa_id").agg(F.min("defect_type").alias("defect_type"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(read_table(spark, sf_dir, "qa_items"))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs by type and recorded status."""
    items = read_table(spark, sf_dir, "qa_items").groupBy("qa_id").agg(F.max("validation_status").alias("validation_status"))
    return p1_found(spark, sf_dir).join(items, "qa_id").groupBy("defect_type", "validation_status").agg(F.count("*").alias("pairs"))
