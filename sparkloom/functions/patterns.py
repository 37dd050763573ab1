"""Patterns, word lists and texts that decide results. Patterns are for Java's and RE2's syntax alike."""

from __future__ import annotations

#: White space as Unicode and ASCII separators define it.
SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]"
#: Line ends beside carriage return and line feed.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

#: Openings by which an answerer, not an asker, speaks. Matched at the start of cleaned lower-case text.
PROVIDER_OPENINGS = (
    r"hi[,!.\s]*may i answer your health queries",
    r"may i answer your health queries",
    r"please type your question",
    r"thanks? for posting your query",
    r"thank you for posting your query",
    r"i have gone through your query",
    r"i can understand your concern",
    r"welcome to chat doctor",
    r"hello[,!.\s]*i am dr\b",
)
#: A line like this and all after it is a footer.
FOOTERS = (r"updated by:", r"review provided by", r"also reviewed by", r"doi:\s*10\.\S+", r"n engl j med\.")
CITATION = r"\[[0-9,; ]+\]"
ANSWER_SUFFIX = r"\bAns(?:wer)?\s*[:\-].*"
#: Extraction, table and code tasks.
EXTRACTION_TASKS = (r"\bextract\b.*\bjson\b", r"\btag\b.*\bentity\b", r"\bnormalize\b.*\bbiomedical\b", r"\bwrite python\b", r"\btable\b", r"\bxml\b")
CODE_WORDS = (
    r"\bpython\b", r"\bjavascript\b", r"\bc\+\+\b", r"\bjava\b", r"\bregex\b", r"\bsql\b", r"\bhtml\b", r"\bcss\b", r"\bcode\b", r"\bprogram\b", r"\balgorithm\b", r"\bdebug\b",
    r"\bimplement\b", r"\bwrite a function\b", r"\bscript\b",
)
UNSAFE_WORDS = (r"\bweapon\b", r"\bbomb\b", r"\bmalware\b", r"\bexploit\b", r"\bdrugs?\b", r"\bsuicide\b")
#: Reference answers that are left out: by source (as spelled) and by kind of question (lower case).
EXCLUDED_SOURCES = ("MPlusDrugs", "MPlusHerbsSupplements", "ADAM", "GARD")
EXCLUDED_QUESTION_TYPES = ("how can i learn more", "where to find support groups", "research", "clinical trial")

SEPARATOR = "\n<SEP>\n"
CHOICE_LEAD = "Answer the following medical multiple-choice question. First explain briefly, then give the final answer.\n\n"
FOLLOWUP_SYSTEM = (
    "You are a careful medical dialogue assistant. Before making a clinical judgment, ask the single most useful follow-up question that would reduce uncertainty. "
    "Keep the question concise, clinically relevant, and focused on information that could change triage, differential diagnosis, or next steps."
)
CONSULT_SYSTEM = (
    "You are a careful medical dialogue assistant. Use the conversation context to respond helpfully and cautiously. When information is limited, avoid overconfidence, "
    "mention important red flags when appropriate, and encourage urgent in-person care for emergency symptoms."
)
REFERENCE_SYSTEM = (
    "You are a careful medical assistant. Provide accurate, cautious, and clinically grounded answers. Do not overstate certainty. "
    "When appropriate, mention important red flags and recommend in-person evaluation for urgent symptoms."
)
GENERAL_SYSTEM = "You are a helpful, concise, and honest assistant. Follow the user's request clearly and avoid unnecessary verbosity."
#: Upper edges of the length histogram; a length of 0 falls in no bucket.
LENGTH_EDGES = (0, 512, 1024, 1536, 2048, 3072, 4096, 8192)
LENGTH_PERCENTILES = (50, 75, 90, 95, 99)
