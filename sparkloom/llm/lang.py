"""The language of a text by its script and its function words, with the whole text read."""

from __future__ import annotations

import re
from collections import Counter

# Function words that are frequent in one of the languages and rare in the others.
_FUNCTION_WORDS = {
    "en": "the and of to is that it with as for was are be this have from or had by not but what all were when your can an each which their if will about many then them these some her would "
    "him into has more my than been who its now did get may how does should after before you i we they he she at so there any also because while could please take keep often",
    "es": "el los las una unos y es por con para como pero sus le ya fue este ha sí porque esta entre cuando muy sin sobre también hasta hay donde quien desde todo nos durante todos uno les ni contra "
    "otros ese eso ante ellos esto mí antes algunos qué yo otro otras otra él tanto esa estos mucho nada muchos cual poco ella estar del al lo su mi no se que",
    "fr": "le les et est une des du dans qui par pour pas sur au plus avec il elle nous vous sont mais ou où leur ses cette ce ces aux être ont fait comme tout si sans peut après aussi entre avant "
    "je mon ma mes votre vos notre j'ai c'est d'un d'une qu'il n'est l'on puis chez très ne car quand lors",
    "de": "der die das und ist nicht ein eine einen einem einer mit sich des auf für von dem den als auch es an werden aus er hat dass sie nach wird bei noch wie über so zum haben nur oder aber vor zur "
    "bis mehr durch man sein wurde sei wenn ich ihr ihre ihnen mein meine kann sind war im am zu seit oft vom keine",
}
LANGUAGES = ("en", "es", "fr", "de", "ru", "zh")
_WORDS = {k: frozenset(v.split()) for k, v in _FUNCTION_WORDS.items()}
_SHARED = frozenset(w for w in set().union(*_WORDS.values()) if sum(w in s for s in _WORDS.values()) > 1)
_OF = {w: k for k, s in _WORDS.items() for w in s - _SHARED}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ASCII_TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)?")
_CYRILLIC, _HAN = re.compile(r"[Ѐ-ӿ]"), re.compile(r"[㐀-鿿]")
# Letters and endings that point to a language.
_LETTERS = {"ñ": "es", "¿": "es", "¡": "es", "ó": "es", "í": "es", "ß": "de", "ä": "de", "ö": "de", "ü": "de", "ê": "fr", "è": "fr", "ç": "fr", "œ": "fr", "à": "fr", "û": "fr", "ù": "fr"}


def language_counts(text: str, found_words: list[str] | None = None) -> Counter:
    """How many words of the text speak for each language; letters beyond ASCII count a half, Chinese characters and Cyrillic words one.

    ``found_words``: the words in lower case, where they are known already.
    """
    if text.isascii():
        return Counter(filter(None, map(_OF.get, _ASCII_TOKEN.findall(text.lower()) if found_words is None else found_words)))
    low = text.lower().replace("’", "'")
    found = Counter(filter(None, map(_OF.get, _TOKEN.findall(low) if found_words is None else found_words)))
    for letter, language in _LETTERS.items():
        n = low.count(letter)
        if n:
            found[language] += n / 2
    n = len(_CYRILLIC.findall(low))
    if n:
        found["ru"] += n / 5
    n = len(_HAN.findall(low))
    if n:
        found["zh"] += n
    return found


def language_of(text: str | None) -> str:
    """The language with most evidence, the first of LANGUAGES at a tie; 'und' where there is none (null, empty, numbers only)."""
    counts = language_counts(text) if text else None
    return max(LANGUAGES, key=lambda k: counts.get(k, 0)) if counts else "und"
