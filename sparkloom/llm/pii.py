"""Personal information inside free text: find it, replace it with typed placeholders.

One Aho-Corasick pass over the folded text finds all anchors: at-signs and their spelled
forms, digits, spelled digits, street words, postal boxes, titles, given names, initials,
line starts, and cues that announce a name, number or address. Local parsers read from an
anchor to both sides, within bounds that no address, number or name exceeds, and validate
what they find: labels of a domain, check digits of cards and accounts, octets, the
distance of an id from its cue. So a text costs a multiple of its length plus its
anchors, whatever stands in it. The rest of the text stays as it is.

Kinds: ``email``, ``phone``, ``idnum``, ``address``, ``name``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import message_rows

KINDS = ("email", "phone", "idnum", "address", "name")

# Words in four languages that announce or form personal information.
TITLES = "mr mrs ms miss mx dr prof doctor professor herr frau señor señora sr sra srta dra doña monsieur madame mme mlle docteur doktor nurse sister".split()
GIVEN_NAMES = (
    "ada adam ahmed aisha alan alejandro alex alexander amara amelia amir amy ana anders andrew anna anton antonio arjun arthur astrid beatriz ben benjamin "
    "bjorn björn boris bruno camila carl carla carlos carmen cedric charles chen chidi chloe claire clara claudia dalia daniel dario david diego dmitri "
    "edward elena elif elisa elizabeth ella emeka emil emily emma eric erik esther eva farid fatima felix fiona francis frank gabriel george gloria goran "
    "greta hana hannah hans helen henry hugo imani ines ingrid irene isabel ivan ivo jacob jamal james jan jana jane jean johan john jonas jose josé juan "
    "julia kaito karen karin karl katarina keiko kenji kofi lars laura leila leon lina louis lucas lucia luis mads magnus marco maren maria marie marta "
    "martin mary mateo maya mehmet mei michael miguel mila milan mohamed nadia naomi nils nina noah noor olga oliver omar oscar otto pablo paul paulo pedro "
    "peter petra pierre priya quentin rafael ravi rebecca robert rosa ruth samir samuel sanjay sara sarah silvia simon sofia sophie stefan susan sven "
    "tamsin tariq thomas tomas uma ursula vera viktor walter wanda wei william xenia yara yasmin yusuf zara zoltan"
).split()
NAME_CUES = (
    "my name is|name is|i am called|they call me|signed by|seen by|this is about|patient:|patient name:|name:|spoke with|spoken with|talked to|notes from|on file for|"
    "letter to|told by|treated by|referred by|written by|copied to|my boss|my colleague|my neighbour|my friend|my husband|my wife|after the fall|went to see|"
    "je m'appelle|je m’appelle|mon nom est|suivi par|reçu par|écrivez à|schreiben sie an|escriba a|vu|contacte a|me llamo|mi nombre es|me atendió|me trató|atendido por|mein name ist|ich heiße|ich heisse|behandelt hat mich|"
    "behandelt von|unterschrieben von|patient|client|customer|resident|employee|witness|named|called|contact|my mother|my father|my son|my daughter|my brother|my partner|paciente|cliente|mi madre|mi padre|mi hijo|mi hija|"
    "patiente|ma mère|mon père|mon fils|ma fille|patientin|kunde|kundin|meine mutter|mein vater|mein sohn|meine tochter|as|so|with|i,|dear|hello|hi|regards,|regards,,|sincerely,|wishes,"
).split("|")
#: What follows a name.
AFTER_CUES = (
    "told me|wrote |went there|drove me|said that|called me|asked me|who lives|had the same|next door|at the clinic|joignable|me dijo|me atendió|m'a dit|hat mir|hat mich|sagte|dejó el número|llamó|schrieb|a laissé|habite"
).split("|")
ID_CUES = (
    "ssn|social security|mrn|passport|policy|insurance|member|record is|record no|record number|medical record|on file for|patient:|patient no|patient number|patient id|"
    "portal|nhs|health card|id card|identity|id number|id no|licence number|license number|account|documento|dni|nie|expediente|póliza|pasaporte|seguridad social|afiliación|"
    "dossier|numéro de|sécurité sociale|passeport|assuré|versicherten|versicherung|ausweis|reisepass|patientennummer|aktenzeichen|fallnummer|krankenkasse|typed"
).split("|")
PHONE_CUES = "phone|tel|call|fax|mobile|cell|number is|reach me|text me|whatsapp|picks up|teléfono|llámeme|móvil|téléphone|appelez|portable|telefon|anrufen|handy|rufnummer".split("|")
STREET_EN = "street|st|road|rd|avenue|ave|lane|ln|drive|court|ct|boulevard|blvd|way|place|pl|square|sq|terrace|close|crescent|parade|row|walk|gardens|grove|highway|parkway|mews|quay"
STREET_FR = "rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours|square"
STREET_ES = "calle|avenida|avda|plaza|paseo|camino|carrera|ronda|travesía|c/"
STREET_DE = "weg|straße|strasse|str|gasse|platz|allee|ring|damm|ufer|steig|pfad|stieg|chaussee"
DIGIT_WORDS = (
    "zero oh one two three four five six seven eight nine".split(),
    "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
    "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "null eins zwei drei vier fünf sechs sieben acht neun".split(),
)
#: Capitalised words that don't belong to a name although they stand where one could.
NOT_NAMES = frozenset(
    (
        "a an and any are as at be best but by can dear did do does don for from give go good had has have he hello her hi his how i if in input instruction is it its just kind "
        "let list many may me mr mrs ms my no not note of oh ok on one or our please question regards she should since so some sorry subject take thank thanks that the their then there "
        "these they this those to two until very was we well were what when where which while who why wishes with would yes you your context age sex complaint site medication "
        "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december english spanish french german "
        "mri ssn mrn po box flat apt tel fax care team doctor nurse patient el la los las un una es en de del mi su con por para que hola gracias espero buenas buenos le les des du et est "
        "une vous je mon ma bonjour merci dans pour sur der die das ein eine ich sie ist und mit von zu im am es oft nach wenn guten vielen meine mein ihr ihre before after still besides "
        "also however often usually write ask try keep again both nobody every each another such more most apart generally speaking seen either whenever lately come feel wishing"
    ).split()
)

_EXTENDED = [chr(c) for c in range(0x100, 0x180)]
_UP = "A-ZÀ-ÖØ-ÞА-ЯЁ" + "".join(filter(str.isupper, _EXTENDED))
_LOW = "a-zß-öø-ÿа-яё" + "".join(filter(str.islower, _EXTENDED))
_CAP = rf"[{_UP}][{_LOW}{_UP}’']+"
_ONE = rf"(?:{_CAP}(?:-{_CAP})*|[{_UP}]\.)"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Doctor|Professor|Herr|Frau|Señora?|Sra?|Srta|Dra|Doña|Monsieur|Madame|Mme|Mlle|Docteur|Doktor|Nurse|Sister)"
_NAME = re.compile(rf"(?:(?i:{_TITLE})\b\.?[ \xa0]+)*{_ONE}(?:,?[ \xa0]+{_ONE}){{0,2}}")
_WORD = re.compile(rf"[{_UP}{_LOW}’'-]+")
#: Characters of the local part of an email besides letters, digits and underscores; its greatest length and that of a domain and its labels.
_LOCAL_MARKS, LOCAL_MOST, DOMAIN_MOST, LABEL_MOST = "._%+'-", 64, 255, 63
_DOMAIN = re.compile(r"\s?[\w-]+(?:\s?\.\s?[\w-]+)*\.[A-Za-z][\w-]*")
_AT_WORDS = ("at", "arroba", "arobase")
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punto|point|punkt)\s*[\])}>]\s*|\s+(?:dot|punto|point|punkt)\s+)"
_LOCAL = rf"[\w%+-]+(?:(?:\.|{_DOT})[\w%+-]+)*"
_LOCAL_BEFORE = re.compile(rf"{_LOCAL}\s*\Z", re.I)
_SPELLED_DOMAIN = rf"[\w-]+(?:\.[\w-]+)*{_DOT}[\w-]+(?:(?:\.|{_DOT})[\w-]+)*(?![\w-]|\s+(?:at|arroba|arobase)\s+[\w-]+{_DOT})"
#: What follows a spelled at-sign in brackets, one between spaces, and a real one.
_AFTER_AT = {
    "bracketed at": re.compile(rf"\s*[\])}}>]\s*[\w-]+(?:(?:\.|{_DOT})[\w-]+)+", re.I),
    "spelled at": re.compile(rf"\s+{_SPELLED_DOMAIN}", re.I),
    "at": re.compile(rf"\s?{_SPELLED_DOMAIN}", re.I),
}
_NUMBER = re.compile(r"(?<![\w.,/-])(?:\+ ?|00 ?)?\(?\d[\d().\-/ \t\xa0‐-–]{5,24}\d(?![\d\w])|(?<![\w.,/-])\+?\d{9,14}(?![\d\w])")
_EXT = re.compile(r"\s*(?:,?\s*(?:ext|extension|x|anexo|poste|durchwahl)\.?\s*\d{1,5})", re.I)
_ID_SHAPE = re.compile(
    r"(?<![\w-])(?:MRN:?\s?)?(?:[A-Z]{2,3}-\d{4}-\d{2}-\d{3}|[A-Z]{1,3}\d{6,10}[A-Z]?|\d{7,9}-?[A-Z]|\d{2}-\d{4}-\d{2}|\d{3}[- ]\d{2}[- ]\d{4}|\d{3}[- ]\d{3}[- ]\d{4}|\d{6,12}|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z])(?![\w-])",
    re.I,
)
#: Shapes that are identity numbers without any cue.
_STRONG_ID = re.compile(r"(?<![\w-])(?:MRN:?\s?[\d-]{6,12}|[A-Z]{2}-\d{4}-\d{2}-\d{3}|\d{3}-\d{2}-\d{4}|\d{8}-[A-Z])(?![\w-])", re.I)
_SPELLED = [rf"(?:{'|'.join(ws)})" for ws in DIGIT_WORDS]
_SPELLED_PHONE = re.compile("|".join(rf"\b{w}(?:[\s,.\-]+{w}){{6,14}}\b" for w in _SPELLED), re.I)
_TOWN = rf"(?:[ \xa0]*,?\s*(?:Apt\.?|Flat|Unit|Suite|Floor)\s*\w{{1,5}})?(?:,?\s*(?:\d{{4,5}}\s+)?{_CAP}(?:\s\d{{5}})?)?"
_ZIP_TOWN = rf"(?:,?\s*\d{{5}}\s+{_CAP})?"
#: What stands before and after the start of a street word, by the language of its form.
_BEFORE_STREET = {
    "street en": re.compile(rf"(?:(?:Flat|Apt\.?|Unit|Suite)\s*\w{{1,4}},?\s*)?(?<![\w.])\d{{1,5}}[A-Za-z]?[ \xa0]+(?:{_CAP}[ \xa0]+){{1,3}}\Z"),
    "street fr": re.compile(r"(?<![\w.])\d{1,5}(?:\s(?:bis|ter))?,?\s+\Z", re.I),
}
_FROM_STREET = {
    "street en": re.compile(rf"(?i:{STREET_EN})\b\.?{_TOWN}"),
    "street fr": re.compile(rf"(?:{STREET_FR})\.?\s+(?:(?:de|du|des|la|le|l['’]|d['’])\s*)*[{_UP}{_LOW}][\w’'-]+{_ZIP_TOWN}", re.I),
    "street es": re.compile(rf"(?:{STREET_ES})\.?\s+(?:(?:de|del|la|las|los|el)\s+)*(?:[{_UP}{_LOW}][\w’'-]+\s+){{0,2}}[{_UP}{_LOW}][\w’'-]+,?\s+(?:n[.º°]\s?)?\d{{1,4}}(?:,\s*\d{{1,2}}\s?[º°ªo]?\s?\w?)?{_ZIP_TOWN}", re.I),
    "street de": re.compile(rf"(?:{STREET_DE})\.?\s+\d{{1,4}}\s?[a-z]?\b{_ZIP_TOWN}", re.I),
}
_BOX = re.compile(
    rf"(?<!\w)(?:P\.?\s?O\.?\s?Box|Post(?:al)?\s+Box|Postfach|Apartado(?:\s+de\s+correos)?|Boîte\s+postale|B\.?P\.?(?!\s+\d+\s*(?:/|over\b|sobre\b|sur\b|zu\b|mm)))\s+\d{{1,6}}(?:,?\s*(?:\d{{4,5}}\s+)?{_CAP}(?:\s\d{{5}})?)?", re.I
)
#: The same street words where the whole text has one case.
_BEFORE_SHOUTED = re.compile(r"(?<![\w.])\d{1,5}[ \xa0]+(?:[A-Za-z’'-]{3,}[ \xa0]+){1,2}\Z")
_SHOUTED = re.compile(r"(?:street|road|avenue|lane|court|boulevard|rd|ave)\b\.?", re.I)
#: How far an address, a spelled email and a name may reach from their anchor.
REACH = 120
_CARD = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")
_ACCOUNT = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])")


def _automaton() -> ahocorasick.Automaton:
    found: dict[str, set[str]] = {}

    def add(word: str, tag: str) -> None:
        found.setdefault(word, set()).add(tag)

    for w in ("@", "＠", "&#64;"):
        add(w, "at")
    for w in _AT_WORDS:
        for bracket in "[({<":
            add(bracket + w, "bracketed at")
            add(bracket + " " + w, "bracketed at")
        for space in " \n\t\xa0":
            add(space + w, "spelled at")
    for d in "0123456789":
        add(d, "digit")
    for words in DIGIT_WORDS:
        for a in words:
            for b in words:
                for sep in (" ", ", ", "-"):
                    add(a + sep + b, "spelled digits")
    for c in map(chr, range(ord("a"), 0x100)):
        if c.islower():
            add(c + ".", "initial")
    add("\n", "line")
    for w in TITLES:
        add(w + " ", "title")
        add(w + ". ", "title")
        add(w + "\xa0", "title")
    for w in GIVEN_NAMES:
        add(w, "given")
    for w in NAME_CUES:
        add(w + " ", "cue")
        add(w + "\n", "cue")
    for w in AFTER_CUES:
        add(" " + w, "after")
    for w in ID_CUES:
        add(w, "id")
    for w in PHONE_CUES:
        add(w, "phone")
    for w in STREET_EN.split("|"):
        for end in " .,\n\t\r\xa0;:)!?'\"":
            add(w + end, "street en")
    for kind, streets in (("fr", STREET_FR), ("es", STREET_ES), ("de", STREET_DE)):
        for w in streets.split("|"):
            for end in (" ", ". ", "\n", "\xa0"):
                add(w + end, f"street {kind}")
    for w in ("box ", "postfach", "apartado", "postale", "bp ", "b.p. ", "bp. "):
        add(w, "box")
    out = ahocorasick.Automaton()
    for w, tags in found.items():
        out.add_word(w, (len(w), tuple(tags)))
    out.make_automaton()
    return out


_AUTOMATON = _automaton()
_WEAK_CUES = ("as", "so", "with", "hi", "hello", "dear")
_ROLES = ("nurse", "sister", "doctor", "docteur", "doktor", "professor")
_SIGNATURE = re.compile(rf"[ \t]*({_ONE}(?:,?[ \xa0]+{_ONE}){{1,2}})[ \t]*(?=\n|\Z|\()")
_TITLE_SET = frozenset(TITLES)
#: English words that end as a German street name does; in lower case such an end alone is none.
_ENGLISH_TOO, _ENGLISH_WORDS = ("ring", "str"), frozenset("during bring string spring monitoring scoring measuring wearing hearing offering entering considering".split())
_AFTER_NAME = re.compile(r"['’]s?\b|\s+(?:\w+\s+)?(?:scale|sign|disease|syndrome|test|index|score|criteria|classification|protocol|method|maneuver)\b", re.I)
_PARTS = re.compile(rf"{_ONE}(?:,?[ \xa0]+{_ONE}){{0,2}}")
_AFTER_INITIAL = re.compile(rf"[ \xa0]?({_CAP}(?:-{_CAP})*)")
_SURNAME_BEFORE = re.compile(rf"({_CAP}(?:-{_CAP})*),[ \xa0]+\Z")
_NAME_BEFORE = re.compile(rf"(?<![\w-])({_CAP}(?:-{_CAP})*(?:,?[ \xa0]+{_ONE}){{1,2}})\Z")
_NOT_AN_ID = re.compile(r"(?:lot|batch|protocol|form|page|code|room|chapter|ref|version)\W+\Z", re.I)
_LOWER_SURNAME = re.compile(rf"[ \xa0]+([{_LOW}][{_LOW}'’-]{{3,}})")
_TWO_CAPITALS = re.compile(rf"(?<![{_UP}{_LOW}])[{_UP}][{_LOW}{_UP}]*\W+[{_UP}][{_LOW}{_UP}]*\W")
_GROUP = re.compile(r"\d+")
_MORE_INITIALS = re.compile(rf"[ \xa0]+[{_UP}]\.")

Span = tuple[int, int, str]


def _valid_name(text: str, start: int, end: int, lone: bool) -> tuple[int, int] | None:
    """The part of a candidate that is a name, or None. lone: one word is enough."""
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text, start, end)]
    while words and words[0][2].lower().rstrip("'’") in NOT_NAMES and words[0][2].lower() not in _TITLE_SET:
        words.pop(0)
    kept: list[tuple[int, int, str]] = []
    for w in words:
        low = w[2].lower()
        if low not in _TITLE_SET and low in NOT_NAMES and len(w[2]) > 1:
            break
        kept.append(w)
    body = [w for w in kept if w[2].lower() not in _TITLE_SET]
    if not any(len(w[2]) > 1 for w in body) or (not lone and len(body) < 2 and len(kept) == len(body)):
        return None
    last = kept[-1][1]
    if last < len(text) and text[last] == "." and len(kept[-1][2]) == 1:
        last += 1
    return (kept[0][0], last) if not _AFTER_NAME.match(text, last, last + REACH) else None


class _Anchors:
    """The anchors of a text by kind, in order, with what is taken of the text already."""

    def __init__(self, text: str) -> None:
        folded = text.lower()
        if len(folded) != len(text):  # a few capitals grow when folded
            folded = "".join(low if len(low := c.lower()) == 1 else c for c in text)
        self.text, self.folded = text, folded
        self.at: dict[str, list[tuple[int, int]]] = {}
        for end, (length, kinds) in _AUTOMATON.iter(folded + "\n"):
            for kind in kinds:
                self.at.setdefault(kind, []).append((end + 1 - length, end + 1))
        self._ends: dict[str, list[int]] = {}
        self._taken: bytearray | None = None
        self.spans: list[Span] = []

    def __getitem__(self, kind: str) -> list[tuple[int, int]]:
        return self.at.get(kind, [])

    def before(self, kind: str, at: int, most: int) -> int:
        """Where the last anchor of this kind ends at most so far before ``at`` (or one behind it), or -1."""
        if kind not in self._ends:
            self._ends[kind] = sorted(e for _, e in self[kind])
        ends = self._ends[kind]
        i = bisect_right(ends, at + 1) - 1
        return ends[i] if i >= 0 and ends[i] >= at - most else -1

    def runs(self, kind: str, gap: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, anchors) of runs of anchors of this kind with at most ``gap`` characters between two."""
        start = end = n = 0
        for s, e in self[kind]:
            if n and s - end > gap:
                yield start, end, n
                n = 0
            if not n:
                start, end = s, e
            n += 1
            end = max(end, e)
        if n:
            yield start, end, n

    def free(self, start: int, end: int) -> bool:
        """Whether no piece found so far overlaps this one."""
        return self._taken is None or self._taken.find(1, start, end) < 0

    def next_taken(self, start: int) -> int:
        """Where the next piece found so far begins: a name ends before it."""
        at = -1 if self._taken is None else self._taken.find(1, start)
        return len(self.text) if at < 0 else at

    def keep(self, spans: list[Span]) -> None:
        """Add pieces, and mark them as taken."""
        if spans and self._taken is None:
            self._taken = bytearray(len(self.text))
        for s, e, _ in spans:
            self._taken[s:e] = b"\x01" * (e - s)
        self.spans += spans


def find_pii(text: str) -> list[Span]:
    """(start, end, kind) of each piece of personal information in ``text``, in order and not overlapping."""
    anchors = _Anchors(text)
    anchors.keep(_emails(anchors))
    anchors.keep(_spelled_emails(anchors))
    addresses = _addresses(anchors)
    numbers = _numbers(anchors) if any(n >= 6 for *_, n in anchors.runs("digit", 3)) else []
    anchors.keep(addresses)
    anchors.keep(numbers)
    anchors.keep(_spelled_phones(anchors))
    spans = anchors.spans + _names(anchors)
    if len(spans) < 2:
        return spans
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[Span] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _emails(anchors: _Anchors) -> list[Span]:
    """From each at-sign the local part to the left, the domain to the right."""
    text, out, done = anchors.text, [], 0
    for s, e in anchors["at"]:
        domain = _DOMAIN.match(text, e, e + DOMAIN_MOST)
        if s < done or not domain:
            continue
        end = domain.start() + len(domain[0].rstrip("-"))
        if any(not 0 < len(label) <= LABEL_MOST or "-" in (label[0], label[-1]) for label in map(str.strip, text[domain.start() : end].split("."))):
            continue
        edge = s - 1 if s > done and text[s - 1].isspace() else s
        start, least = edge, max(done, edge - LOCAL_MOST)
        while start > least and (text[start - 1].isalnum() or text[start - 1] == "_" or text[start - 1] in _LOCAL_MARKS):
            start -= 1
        while start < edge and text[start] in ".'":
            start += 1
        if start < edge and text[edge - 1] not in ".'":
            out.append((start, end, "email"))
            done = end
    return out


def _spelled_emails(anchors: _Anchors) -> list[Span]:
    """From each spelled at-sign, or real one with a spelled dot after it."""
    text, out, done = anchors.text, [], 0
    for kind, after in _AFTER_AT.items():
        for s, e in anchors[kind]:
            domain = after.match(text, e, e + DOMAIN_MOST)
            local = domain and _LOCAL_BEFORE.search(text, max(0, s - REACH), s)
            if local and anchors.free(local.start(), domain.end()):
                out.append((local.start(), domain.end(), "email"))
    out.sort()
    kept: list[Span] = []
    for span in out:
        if span[0] >= done:
            kept.append(span)
            done = span[1]
    return kept


def _addresses(anchors: _Anchors) -> list[Span]:
    """From each street word the house number, name and town around it; from each word for a postal box its number."""
    text, out = anchors.text, []
    one_case = text.isupper() or text.islower()
    for kind, before in _BEFORE_STREET.items():
        for s, _ in anchors[kind]:
            if s and not text[s - 1].isspace():
                continue
            head = before.search(text, max(0, s - REACH), s)
            tail = head and _FROM_STREET[kind].match(text, s, s + REACH)
            if tail:
                out.append((head.start(), tail.end(), "address"))
            if one_case and kind == "street en":
                head = _BEFORE_SHOUTED.search(text, max(0, s - REACH), s)
                tail = head and _SHOUTED.match(text, s)
                if tail:
                    out.append((head.start(), tail.end(), "address"))
    for s, _ in anchors["street es"]:
        m = None if s and (text[s - 1].isalnum() or text[s - 1] == "_") else _FROM_STREET["street es"].match(text, s, s + REACH)
        if m:
            out.append((*m.span(), "address"))
    for s, e in anchors["street de"]:
        tail = _FROM_STREET["street de"].match(text, s, s + REACH)
        if not tail:
            continue
        start = s
        while start > max(0, s - REACH) and (text[start - 1].isalnum() or text[start - 1] in "_’'-"):
            start -= 1
        while start < s and not text[start].isalpha():
            start += 1
        end = anchors.folded[s:e].strip(". \n\xa0")
        if start < s and (end not in _ENGLISH_TOO or (text[start].isupper() and anchors.folded[start:s] + end not in _ENGLISH_WORDS)):
            out.append((start, tail.end(), "address"))
    for s, e in anchors["box"]:
        for m in _BOX.finditer(text, max(0, s - 16), e + REACH):
            if m.start() <= s < m.end():
                out.append((*m.span(), "address"))
                break
    return out


def _spelled_phones(anchors: _Anchors) -> list[Span]:
    """Runs of spelled digits."""
    out = []
    for start, end, n in anchors.runs("spelled digits", 12):
        if n > 2:
            out += [(m.start(), m.end(), "phone") for m in _SPELLED_PHONE.finditer(anchors.text, max(0, start - 12), end + 12)]
    return out


def _looks_like_phone(raw: str) -> bool:
    groups = _GROUP.findall(raw)
    digits = sum(map(len, groups))
    if not 9 <= digits <= 15 or (raw.count(".") == 3 == len(groups) - 1 and all(len(g) <= 3 and int(g) <= 255 for g in groups)):  # four octets are a machine's address
        return False
    return raw[0] in "+0(" or (len(groups) == 1 and digits >= 10) or (len(groups) >= 3 and len(groups[-1]) >= 2)


def _is_card(raw: str) -> bool:
    """Whether the last digit checks the others, as it does in numbers of cards."""
    digits = [int(c) for c in raw if c.isdigit()]
    doubled = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return doubled % 10 == 0 and len(set(digits)) > 1


def _is_account(raw: str) -> bool:
    """Whether the two digits after the country check the rest, as they do in international account numbers."""
    plain = raw.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _numbers(anchors: _Anchors) -> list[Span]:
    """From each run of digits the shape around it: ids by shape or by their distance from a cue, cards and accounts by their check digits, phones."""
    text, out = anchors.text, []
    mine = bytearray(len(text))

    def take(start: int, end: int, kind: str) -> None:
        out.append((start, end, kind))
        mine[start:end] = b"\x01" * (end - start)

    def free(start: int, end: int) -> bool:
        return mine.find(1, start, end) < 0 and anchors.free(start, end)

    windows: list[tuple[int, int, int]] = []
    for start, end, n in anchors.runs("digit", 3):
        if n >= 6:
            # Letters, signs and groups that belong to a number stand at most so far before and after its digits.
            lo, hi = max(0, start - 12), min(len(text), end + 12)
            if windows and lo < windows[-1][1]:
                windows[-1] = (windows[-1][0], hi, windows[-1][2] + n)
            else:
                windows.append((lo, hi, n))
    cues, phones = anchors["id"], anchors["phone"]
    after = [s for s, _ in cues]
    for lo, hi, n in windows:
        for m in _STRONG_ID.finditer(text, lo, hi):
            if free(*m.span()):
                take(*m.span(), "idnum")
        if n >= 12:
            for shape, valid in ((_CARD, _is_card), (_ACCOUNT, _is_account)):
                for m in shape.finditer(text, lo, hi):
                    if valid(m[0]) and free(*m.span()):
                        take(*m.span(), "idnum")
        for m in _ID_SHAPE.finditer(text, lo, hi) if cues else ():
            start, end = m.span()
            if sum(map(str.isdigit, m[0])) < 6 or not free(start, end) or _NOT_AN_ID.search(text, max(0, start - 12), start):
                continue
            id_at, phone_at = anchors.before("id", start, 40), anchors.before("phone", start, 24) if phones else -1
            i = bisect_left(after, end)
            if id_at > phone_at or (id_at >= 0 and not _looks_like_phone(m[0])) or (id_at < 0 and phone_at < 0 and i < len(after) and after[i] <= end + 24):
                take(start, end, "idnum")
        for m in _NUMBER.finditer(text, lo, hi):
            raw, start = m[0], m.start()
            if raw[0] == "(" and ")" not in raw:
                raw, start = raw[1:], start + 1
            if "," in raw or "\n" in raw or not _looks_like_phone(raw) or not free(start, m.end()):
                continue
            more = _EXT.match(text, m.end(), m.end() + REACH)
            take(start, more.end() if more else m.end(), "phone")
    return out


def _names(anchors: _Anchors) -> list[Span]:
    """From each title, cue, given name, initial and line start the capitalised words beside it."""
    text, folded, out = anchors.text, anchors.folded, []
    # Where most words are capitalised, capitals say nothing: a given name or a title is needed.
    starts = [m[0][0].isupper() for m in _WORD.finditer(text)] if _TWO_CAPITALS.search(text) else []
    plain_case = sum(starts) <= 0.5 * len(starts) or len(starts) < 6
    cue_ends, after_starts = {e for _, e in anchors["cue"]}, {s for s, _ in anchors["after"]}

    def limit(start: int) -> int:
        return min(anchors.next_taken(start), start + REACH)

    def take(start: int, end: int) -> None:
        if anchors.free(start, end):
            out.append((start, end, "name"))

    for s, e in anchors["title"]:
        if (s and text[s - 1].isalnum()) or e >= len(text) or not text[e].isupper():
            continue
        if folded[s:e].rstrip(". \xa0") in _ROLES and not (plain_case and text[s].isupper() and text[e - 2] != "."):
            continue
        m = _PARTS.match(text, e, limit(e))
        got = m and _valid_name(text, e, m.end(), True)
        if got and got[0] == e:
            take(s, got[1])
    for s, e in anchors["cue"] if plain_case else ():
        if e < len(text) and text[e].isupper() and (s == 0 or not text[s - 1].isalnum()):
            m = _NAME.match(text, e, limit(e))
            got = m and _valid_name(text, e, m.end(), False)
            # Shouted words after a mere preposition are no name; with a given name they are found below.
            if got and not (folded[s:e].strip() in _WEAK_CUES and text[got[0] : got[1]].isupper()):
                take(*got)
    for s, e in anchors["given"]:
        if text[s].islower() and (s == 0 or not text[s - 1].isalnum()):  # all in lower case: a cue must stand on one side
            m = _LOWER_SURNAME.match(text, e, e + REACH)
            if m and m[1] not in NOT_NAMES and not _AFTER_NAME.match(text, m.end(), m.end() + REACH) and (s in cue_ends or m.end() in after_starts):
                take(s, m.end())
            continue
        if not text[s].isupper() or (s and (text[s - 1].isalnum() or text[s - 1] in "-@._+")) or (e < len(text) and (text[e].isalnum() or text[e] in "@_+")):
            continue
        before = _SURNAME_BEFORE.search(text, max(0, s - 40), s)
        if before and before[1].lower() not in NOT_NAMES:
            more = _MORE_INITIALS.match(text, e)
            take(before.start(), more.end() if more else e)
            continue
        m = _NAME.match(text, s, limit(s))
        got = m and _valid_name(text, s, m.end(), False)
        if got:
            take(*got)
        elif not _AFTER_NAME.match(text, e, e + REACH):
            more = _LOWER_SURNAME.match(text, e, e + REACH)  # a surname without its capital, where the words after it say so
            take(s, more.end() if more and more.end() in after_starts else e)
    for s, _ in anchors["after"] if plain_case else ():
        m = _NAME_BEFORE.search(text, max(0, s - 60), s)
        got = m and _valid_name(text, m.start(1), m.end(1), False)
        if got and got[1] == m.end(1):
            take(*got)
    for s, e in anchors["initial"] if plain_case else ():
        if not text[s].isupper() or (s and (text[s - 1].isalnum() or text[s - 1] in "._")):
            continue
        m = _AFTER_INITIAL.match(text, e, e + REACH)
        if m:
            option = text[s] <= "H" and (s == 0 or text[s - 1] == "\n") and s not in cue_ends and m.end() not in after_starts
            if not option and len(m[1]) > 3 and m[1].lower() not in NOT_NAMES and not _AFTER_NAME.match(text, m.end(), m.end() + REACH):
                take(s, m.end())
    if plain_case and ("\n" in text or len(text) < 60):
        for s in (0, *(e for _, e in anchors["line"])):
            m = _SIGNATURE.match(text, s) if s < len(text) else None
            got = m and _valid_name(text, m.start(1), m.end(1), False)
            if got and got[1] == m.end(1):
                take(*got)
    return out


def redact(text: str) -> str:
    """``text`` with each piece of personal information replaced by its kind in brackets, as in ``[EMAIL]``; all else unchanged."""
    parts, at = [], 0
    for start, end, kind in find_pii(text):
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(parts) + text[at:] if parts else text


_FOUND = pa.schema([("record_id", pa.int64()), ("msg_idx", pa.int32()), ("kind", pa.string())])


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for record_id, messages in zip(batch.column(0).to_pylist(), message_rows(batch)):
            for i, (_, content) in enumerate(messages or ()):
                for kind in {k for _, _, k in find_pii(content)} if content else ():
                    out[0].append(record_id)
                    out[1].append(i)
                    out[2].append(kind)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _FOUND)], schema=_FOUND)


def pii_kinds(records: DataFrame, id_col: str = "record_id", messages_col: str = "messages") -> DataFrame:
    """One row (record_id, msg_idx, kind) per message and kind of personal information in it.

    Whole contents are read, whatever the role. Null or empty messages and null, empty
    or blank contents give no row; repeated records give repeated rows. No shuffle.
    """
    rows = records.select(F.col(id_col).cast("long").alias("record_id"), F.col(messages_col).alias("messages"))
    return rows.mapInArrow(_find_batches, "record_id long, msg_idx int, kind string")


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
    for batch in batches:
        out = [None if ms is None else [{"role": r, "content": c and redact(c)} for r, c in ms] for ms in message_rows(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["record_id", "messages"])


def redact_messages(records: DataFrame, id_col: str = "record_id", messages_col: str = "messages") -> DataFrame:
    """(record_id, messages) with typed placeholders in all contents; null messages and contents stay null."""
    rows = records.select(F.col(id_col).cast("long").alias("record_id"), F.col(messages_col).alias("messages"))
    return rows.mapInArrow(_redact_batches, "record_id long, messages array<struct<role string, content string>>")
