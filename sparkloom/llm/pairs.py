"""Broken prompt and response pairs: which answers fail, and how.

* ``empty``: nothing is said, or a user message at the end has no answer;
* ``refusal``: every sentence aligns with a refusal or with a mere courtesy around one;
* ``copied``: the answer aligns with the user message before it (shared shingles, then
  the longest common subsequence);
* ``wrong_language``: function words of question and answer point to other languages;
* ``truncated``: the answer lacks its end. An answer that stops inside a bracket, or after
  a comma or dash, does; another one without a final mark is held against the corpus: the words it stops with are complete where answers elsewhere go
  on to a new sentence after them. The counts behind that are taken over all answers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.align import containment, lcs_length
from sparkloom.llm.arrow import message_rows
from sparkloom.llm.canonical import fold, role_of, words
from sparkloom.llm.lang import language_counts
from sparkloom.plans.durable import durable

DEFECTS = ("empty", "truncated", "refusal", "copied", "wrong_language")

# What stands in for an answer that isn't there.
STAND_INS = frozenset(
    "null none nil na nan n/a empty blank noanswer noresponse notavailable notapplicable tbd tba todo undefined missing noreply emptyresponse unanswered noanswergiven noanswerprovided "
    "sinrespuesta nohayrespuesta vacío vacio ninguna nulo pasderéponse aucuneréponse vide néant aucune keineantwort leer nichts keine entfällt".split()
)
# Sentences that decline; * stands for what they decline.
REFUSALS = tuple(
    tuple(line.split())
    for line in """
i can t help with that request
i cannot help with that
i can not help you with this
i cannot assist with questions about *
i am unable to help with that
i m unable to assist with this request
i am not able to give medical advice
i cannot give medical advice
i can t provide medical advice
i cannot provide that information
i am not able to answer that
i can t answer that question
i cannot discuss health matters
as an ai model i cannot discuss health matters
as an ai language model i cannot answer
i must refrain from responding
no answer can be provided here
i don t feel comfortable addressing this
i do not feel comfortable answering
this is something i have to decline
i have to decline this request
i must decline to answer
i won t be answering this question
i will not answer this
my guidelines prevent me from replying
my guidelines do not allow me to answer
it would not be appropriate for me to comment
that falls outside what i am allowed to talk about
this is outside what i can discuss
i am not allowed to talk about *
we do not respond to queries on *
we do not answer questions about *
i can t do that
i cannot do this
i won t do that
i can t assist with that
i m not able to help with that
i cannot fulfil this request
i cannot fulfill your request
i cannot comply with this request
i m not allowed to do that
as an ai i can t help with this
that is against my policy
this goes against my guidelines
i decline to answer
no puedo hacer eso
eso va en contra de mis normas
je ne peux pas faire cela
cela va à l encontre de mes règles
das kann ich nicht tun
das verstößt gegen meine richtlinien
я не могу ответить на этот вопрос
я не могу помочь с этим
я не могу давать медицинские советы
我无法回答这个问题
我不能提供医疗建议
我无法提供帮助
no puedo ayudarle con esa consulta
no puedo ayudarte con eso
no puedo responder a esa pregunta
no puedo dar consejos médicos
no estoy autorizado para responder
no me es posible opinar sobre *
debo rechazar esta pregunta
como modelo de lenguaje no doy consejos médicos
prefiero no responder
je ne peux pas répondre à cette demande
je ne peux pas vous aider
je ne suis pas autorisé à donner un avis
je ne suis pas en mesure de répondre
je dois décliner cette question
je ne donne pas de conseils médicaux
en tant que modèle de langage je ne donne pas de conseils médicaux
il ne m est pas possible de me prononcer sur *
je ne me prononce pas sur *
je refuse de répondre
ich muss diese anfrage ablehnen
ich kann dabei nicht helfen
ich kann ihnen nicht helfen
ich darf diese frage nicht beantworten
ich kann diese frage nicht beantworten
als sprachmodell gebe ich keine medizinischen ratschläge
ich gebe keine medizinischen ratschläge
zu * äußere ich mich nicht
dazu äußere ich mich nicht
""".strip().splitlines()
)
# Courtesies that may stand around a refusal.
COURTESIES = tuple(
    tuple(line.split())
    for line in """
i m sorry
i am sorry
sorry
i apologise
i apologize
hello
hi
dear patient
unfortunately
i understand your worry
thank you for your message
thank you for your question
thank you for your understanding
i hope you understand
and i hope you understand
please consult a qualified professional
please see a doctor
please ask a professional
please contact a doctor
try asking someone who is licensed to do so
is there anything else you need
can i help with anything else
this conversation will be closed
lo siento
disculpe
lamentablemente
gracias por su comprensión
consulte a un profesional
consulte a su médico
désolé
je suis désolé
je regrette
malheureusement
merci de votre compréhension
consultez un professionnel
consultez un médecin
entschuldigung
es tut mir leid
leider
leider gilt
danke für ihr verständnis
bitte wenden sie sich an eine fachperson
bitte wenden sie sich an einen arzt
извините
к сожалению
обратитесь к врачу
很抱歉
对不起
请咨询医生
""".strip().splitlines()
)
_LEADS = tuple(
    tuple(x.split())
    for x in "i m afraid|i am afraid|i m sorry but|i am sorry but|sorry but|sorry|i apologise but|i apologize but|hello|hi|unfortunately|i understand your worry however|i understand your concern but|however|but|lo siento pero|disculpe pero|disculpe|lamentablemente|désolé mais|je suis désolé mais|je regrette mais|je regrette|malheureusement|entschuldigung aber|entschuldigung|es tut mir leid aber|leider gilt|leider".split(
        "|"
    )
)
_TAILS = tuple(tuple(x.split()) for x in "and i hope you understand|i hope you understand".split("|"))
# Endings of letters and notes that need no mark after them.
SIGN_OFFS = (
    "all the best|take care|best wishes|best regards|kind regards|warm regards|regards|sincerely|yours sincerely|yours|get well soon|good luck|thank you|thanks|many thanks|cheers|"
    "kind regards the care team|the care team|saludos|un saludo|atentamente|cuídese|mejórese|gracias|cordialement|bien à vous|bon rétablissement|merci|bonne journée|"
    "mit freundlichen grüßen|viele grüße|gute besserung|alles gute|danke"
).split("|")
_SIGN_OFFS = frozenset(SIGN_OFFS)

_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]*_]*(?:\s+|\Z)|[\r\n]+")
_END_NOISE = re.compile(r"[\s​‌‍⁠﻿\"'“”’»*_`~#>←-⯿️\U0001f000-\U0001faff]+\Z")
_ASKS = re.compile(
    r"\b(?:in|into|auf|ins|en|al|à|a|em)\s+(?:\w+\s+)?(english|spanish|french|german|russian|chinese|englisch|spanisch|französisch|deutsch|inglés|español|castellano|francés|alemán|anglais|espagnol|français|allemand)\b"
    r"|\b(?:translate|übersetz\w*|traduzca|traduce|traduis\w*|traduire)\b",
    re.I,
)
# Names of languages.
_CALLED = dict(
    zip(
        "english spanish french german russian chinese englisch spanisch französisch deutsch inglés español castellano francés alemán anglais espagnol français allemand".split(),
        "en es fr de ru zh en es fr de en es es fr de en es fr de".split(),
    )
)
_DIGITS = re.compile(r"\d+")


def _nothing(content: str | None) -> bool:
    if not content:
        return True
    if len(list(islice(filter(str.isalnum, content), 61))) > 60:  # more letters than any stand-in has
        return False
    plain = "".join(words(fold(content)))
    return not plain or plain in STAND_INS


class _Templates:
    """Templates by their words: a sentence is aligned only with those that share enough words with it."""

    def __init__(self, templates: tuple[tuple[str, ...], ...]) -> None:
        self.fixed = [[w for w in t if w != "*"] for t in templates]
        # * takes up to six words.
        self.most = [len(f) + (6 if "*" in t else 1 + len(f) // 6) for t, f in zip(templates, self.fixed)]
        self.longest = max(self.most)
        self.of: dict[str, list[int]] = {}
        for i, f in enumerate(self.fixed):
            for w in set(f):
                self.of.setdefault(w, []).append(i)

    def aligned(self, sentence: list[str], least: float = 0.8) -> bool:
        """Whether a sentence is one of the templates, give or take a word."""
        if len(sentence) > self.longest:
            return False
        shared: Counter = Counter()
        for w in sentence:
            shared.update(self.of.get(w, ()))
        for i, n in shared.items():
            fixed = self.fixed[i]
            if n >= least * len(fixed) and len(fixed) * least <= len(sentence) <= self.most[i] and lcs_length(sentence, fixed) >= least * len(fixed):
                return True
        return False


_REFUSALS, _COURTESIES = _Templates(REFUSALS), _Templates(COURTESIES)


def _sentences(text: str) -> Iterator[str]:
    """The sentences and lines of a text, one after another: the first that says something else ends the look at a long answer."""
    start = 0
    for end in _SENTENCE.finditer(text):
        yield text[start : end.start()]
        start = end.end()
    yield text[start:]


def is_refusal(content: str) -> bool:
    """Whether an answer declines and gives nothing else: each sentence aligns with a refusal or a courtesy, at least one with a refusal."""
    folded = fold(content.replace("’", "'"))
    declined = False
    for sentence in map(words, _sentences(folded)):
        if not sentence:
            continue
        if _COURTESIES.aligned(sentence) and not _REFUSALS.aligned(sentence, 1.0):
            continue
        for lead in _LEADS:
            if tuple(sentence[: len(lead)]) == lead:
                sentence = sentence[len(lead) :]
                break
        for tail in _TAILS:
            if tuple(sentence[-len(tail) :]) == tail:
                sentence = sentence[: -len(tail)]
                break
        if not sentence:
            continue
        if not _REFUSALS.aligned(sentence):
            return False
        declined = True
    return declined


def is_copy(question: list[str], answer: list[str]) -> bool:
    """Whether the words of an answer are but those of the question, perhaps slightly changed, repeated or introduced."""
    if not question or len(answer) < 0.6 * len(question) or containment(answer, question, 3) < 0.3:
        return False
    common = lcs_length(answer, question)
    if common < 0.7 * len(question):
        return False
    return common >= 0.75 * len(answer) or common >= len(answer) - 12 or containment(answer, question, 2) >= 0.8


def _language(counts: Counter, least: float = 3) -> str | None:
    """The language most words speak for, where they do so clearly."""
    whole = sum(counts.values())
    if whole < least:
        return None
    best, n = max(counts.items(), key=lambda x: x[1])
    return best if n >= 0.6 * whole else None


def _wrong_language(question: str, asked: Counter, before: Counter, answered: Counter) -> bool:
    own = _language(answered)
    if own is None:
        return False
    expected = _language(asked) or _language(before + asked) or _language(asked, 1)
    if expected is None or expected == own:
        return False
    wish = _ASKS.search(question)
    if wish:
        named = {_CALLED[m[1].lower()] for m in _ASKS.finditer(question) if m[1]}
        return bool(named) and own not in named
    return True


def _key(*parts: str) -> int:
    n = xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


_MARKS = ".!?…。！？"
_CLOSE = rf"[{_MARKS}]+[\"'”’»)\]*_]*(?=\s|\Z)"
#: A word, with what closes a sentence or line after it.
_CLOSED_WORD = re.compile(rf"[^\W_]+(?:[\"'”’»)\]*_]*(?:{_CLOSE}|[ \t]*[\r\n]))?")


def _plain(token: str) -> str:
    """A token of _CLOSED_WORD without its close, numbers as 0."""
    while not token[-1].isalnum():
        token = token[:-1]
    return _DIGITS.sub("0", token) if not token.isalpha() else token


def _open_end(content: str) -> tuple[str, bool]:
    """(the folded answer without what decorates its end, whether an ellipsis stood there)."""
    text = _END_NOISE.sub("", content)
    cut = False
    while text.endswith(("...", "…")):
        text, cut = _END_NOISE.sub("", text.rstrip(".…")), True
    return fold(text), cut


_SAD = re.compile(r":['-]?\(\Z")


def _hangs(text: str) -> bool:
    """Whether folded text without a final mark stops inside a bracket, or after a comma or dash: no sentence does."""
    if text[-1] in ",–—，、":
        return True
    opened = max(text.rfind("("), text.rfind("（"))
    return opened > max(text.rfind(")"), text.rfind("）")) and not _SENTENCE.search(text, opened) and not _SAD.search(text)


#: Distinct word pairs a task holds before it passes their counts on; bounds memory, changes no result.
HELD = 400_000
_ROWS = pa.schema([("kind", pa.string()), ("record_id", pa.int64()), ("defect", pa.string()), ("key", pa.int64()), ("level", pa.int32()), ("ended", pa.int64()), ("seen", pa.int64()), ("answer", pa.int32())])
_DDL = "kind string, record_id long, defect string, key long, level int, ended long, seen long, answer int"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ROWS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)


def _end_keys(tokens: list[str]) -> list[int]:
    """Keys of how an answer stops: its last two words, the word before with the ending of the last, the last."""
    last = _plain(tokens[-1])
    two = _plain(tokens[-2]) if len(tokens) > 1 and tokens[-2][-1].isalnum() else "^"
    return [_key("2", two, last), _key("s", two, last[-3:]), _key("1", last)]


def _statistics(pairs: Counter) -> Iterator[pa.RecordBatch]:
    """Partial counts: how often each end occurs in answers, and how often it closes a sentence."""
    seen: Counter = Counter()
    ended: Counter = Counter()
    for (before, token), n in pairs.items():
        closes = not token[-1].isalnum()
        word = _plain(token)
        first = _plain(before) if before[-1].isalnum() else "^"
        for key in (_key("2", first, word), _key("s", first, word[-3:]), _key("1", word)):
            seen[key] += n
            if closes:
                ended[key] += n
    rows = [("stat", None, None, k, None, ended.get(k, 0), n, None) for k, n in seen.items()]
    for a in range(0, len(rows), 50_000):
        yield _rows(rows[a : a + 50_000])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs: Counter = Counter()
    for batch in batches:
        rows: list[tuple] = []
        for record_id, messages in zip(batch.column(0).to_pylist(), message_rows(batch)):
            if not messages:
                continue
            found: set[str] = set()
            turns = [(role_of(r), c) for r, c in messages]
            spoken = [t for t in turns if t[0] != "system"]
            if spoken and spoken[-1][0] == "user":
                found.add("empty")
            before: Counter = Counter()
            asked: Counter = Counter()
            question, question_words = "", []
            for n, (role, content) in enumerate(turns):
                if role == "user":
                    before += asked
                    question = content or ""
                    question_words = words(fold(question))
                    asked = language_counts(question, question_words)
                    continue
                if role != "assistant":
                    continue
                if _nothing(content):
                    found.add("empty")
                    continue
                answer_words = words(fold(content))
                if is_refusal(content):
                    found.add("refusal")
                copied = bool(question_words) and is_copy(question_words, answer_words)
                if question_words:
                    if copied:
                        found.add("copied")
                    elif _wrong_language(question, asked, before, language_counts(content, answer_words)):
                        found.add("wrong_language")
                text, is_open = _open_end(content)
                tokens = _CLOSED_WORD.findall(text)
                if not tokens:
                    continue
                is_open = is_open or text[-1] not in _MARKS
                if is_open:
                    keys = _end_keys(tokens)
                    # A copy ends as the question does.
                    if copied or any(" ".join(map(_plain, tokens[-k:])) in _SIGN_OFFS for k in range(1, 6)):
                        pass
                    elif _hangs(text):
                        found.add("truncated")
                    else:
                        rows += [("open", record_id, None, k, level, None, None, n) for level, k in enumerate(keys)]
                    tokens.pop()
                pairs.update(zip(["."] + tokens, tokens))
            rows += [("defect", record_id, d, None, None, None, None, None) for d in sorted(found)]
        yield _rows(rows)
        if len(pairs) > HELD:
            yield from _statistics(pairs)
            pairs.clear()
    yield from _statistics(pairs)


#: An end is complete where at least this share of its occurrences closes a sentence; seen fewer times than these, a shorter end decides.
ENDS_AT_LEAST, SEEN = 0.15, (4, 4, 4)


def pair_defects(records: DataFrame, id_col: str = "record_id", messages_col: str = "messages") -> DataFrame:
    """(record_id, defect), one row per record and kind of defect any of its answers has.

    Rows with null or empty messages give nothing; a null content counts as empty; a
    record of system messages only has no defect. Roles are read without case and
    spacing. Whole contents are read. Repeated record ids give one row per defect.
    """
    rows = records.select(F.col(id_col).cast("long").alias("record_id"), F.col(messages_col).alias("messages"))
    scanned = durable(rows.mapInArrow(_scan, _DDL), "pairs")
    stats = scanned.where("kind = 'stat'").groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    ends = scanned.where("kind = 'open'").select("record_id", "key", "level", "answer")
    # A frequent end, as a closing formula, may be a hot key: it is looked up once per distinct key and part of its rows.
    salts = 8
    ends = ends.withColumn("salt", F.pmod(F.xxhash64("record_id", "answer"), F.lit(salts)).cast("int"))
    wanted = ends.select("key", "salt").distinct()
    known = wanted.join(stats, "key", "left")
    looked = ends.join(known, ["key", "salt"], "left").select("record_id", "answer", "level", F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("seen", "ended")]).alias("n"))
    levels = looked.groupBy("record_id", "answer").agg(*[F.max(F.when(F.col("level") == i, F.col("n"))).alias(f"n{i}") for i in range(3)])
    share = lambda i: F.col(f"n{i}.ended") / F.col(f"n{i}.seen") >= ENDS_AT_LEAST
    # However many answers stop alike, their own ends say nothing: copies of a cut answer, or cuts of one template, do so too.
    whole = F.lit(False)
    for i in (2, 1, 0):
        whole = F.when(F.col(f"n{i}.seen") >= SEEN[i], share(i)).otherwise(whole)
    cut = levels.where(~whole).select("record_id", F.lit("truncated").alias("defect"))
    return scanned.where("kind = 'defect'").select("record_id", "defect").unionByName(cut).distinct()
