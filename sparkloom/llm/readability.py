"""Reading level of documents, on the scale of human raters.

Boosted regression trees are trained on distributions of word length, syllables,
vocabulary, syntax and cohesion of the rated documents. How demanding a word is, is
learnt from the ratings of the documents it occurs in: for a training row from other
sources only, for a held-out row from the training sources only. Predictions are
cross-validated by source, with the settings of the model that is shipped; thresholds
that turn them into bands are calibrated on the held-out predictions.

The model is fitted on a bounded sample of rated documents (``MOST_RATED``); everything
else covers all documents. Rated texts are measured where they lie; one task fits the
model from numbers alone, and only the model, of bounded size, reaches the driver.
Prediction is one pass over the texts, without a shuffle.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.lang import LANGUAGES, language_counts
from sparkloom.functions.text import normal_name
from sparkloom.llm.trees import Boosted

#: Rated documents used to fit, at most, drawn by hash of their id.
MOST_RATED = 8_000
#: Longer rated texts aren't used to fit, so the sample's size is bounded; they get a band like any other.
MOST_CHARACTERS = 50_000
#: Words whose difficulty is kept: the most frequent ones of the rated documents.
MOST_WORDS = 20_000
#: Words between spaces below which a document has no band.
LEAST_WORDS = 50
BANDS = (1, 5)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SENTENCE = re.compile(r"[.!?;:]+\s+|[\r\n]+")
_CAPITAL = re.compile(r"(?:\A|\s)[A-Z]")
_VOWELS = re.compile(r"[aeiouy]+")
_QUANTILES, _SPREAD = (0.1, 0.25, 0.5, 0.75, 0.9), (0.25, 0.5, 0.75)
_NONE_SHARED = [0.0] * len(_SPREAD)
# Words that subordinate, connect, address or build the passive.
_GROUPS = tuple(
    frozenset(g.split())
    for g in (
        "because although while whereas since unless whether which whose whom that if when until after before where",
        "however therefore moreover furthermore consequently nevertheless notwithstanding thereby hence thus accordingly subsequently predominantly",
        "you your yours we our us me my mum dad",
        "is are was were be been being has have had",
        "the a an this these those",
        "of in on at to by with from for into among between during",
        "and or but so then",
    )
)
_N_DIFFICULTY = 2 + 2 * len(_QUANTILES)


def _word_facts(word: str, known: dict[str, tuple[float, float]]) -> tuple[float, float]:
    """(letters, syllables) of a word, kept."""
    facts = known.get(word)
    if facts is None:
        if len(known) > 500_000:
            known.clear()
        syllables = len(_VOWELS.findall(word))
        if word.endswith("e") and not word.endswith("le") and syllables > 1:
            syllables -= 1
        facts = known[word] = (float(len(word)), float(max(1, syllables)))
    return facts


_facts: dict[str, tuple[float, float]] = {}


def _word_id(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))


def _at(values: np.ndarray, shares: tuple[float, ...]) -> list[float]:
    """The values at shares of their order, without interpolation."""
    ordered = np.sort(values)
    return [ordered[int(q * (len(ordered) - 1) + 0.5)] for q in shares]


def english_sentences(text: str | None) -> list[list[str]] | None:
    """The words of each sentence or line of an English text of at least LEAST_WORDS words between spaces; else None."""
    if not text or len(text.split()) < LEAST_WORDS:
        return None
    sentences = [s for s in map(_WORD.findall, _SENTENCE.split(text.lower())) if s]
    counts = language_counts(text, [w for s in sentences for w in s])
    return sentences if counts and max(LANGUAGES, key=lambda k: counts.get(k, 0)) == "en" else None


def measure(text: str, sentences: list[list[str]]) -> np.ndarray:
    """Features of a text and the words of its sentences (one word at least), but for the vocabulary."""
    all_words = [w for s in sentences for w in s]
    n = len(all_words)
    counts = Counter(all_words)
    # Each distinct word once, with its number.
    facts = np.array([_word_facts(w, _facts) for w in counts])
    times = np.fromiter(counts.values(), np.int64, len(counts))
    lengths, syllables = np.repeat(facts[:, 0], times), np.repeat(facts[:, 1], times)
    per_sentence = np.array([len(s) for s in sentences], float)
    content = [{w for w in s if len(w) > 4} for s in sentences]
    shared = [len(a & b) / (1 + min(len(a), len(b))) for a, b in zip(content, content[1:])]
    mean = lengths.sum() / n
    out = [
        mean, ((lengths**2).sum() / n - mean**2) ** 0.5, *_at(lengths, _QUANTILES), (lengths >= 7).sum() / n, (lengths >= 10).sum() / n, (lengths >= 13).sum() / n, (lengths <= 3).sum() / n,
        syllables.sum() / n, (syllables >= 3).sum() / n, (syllables >= 4).sum() / n, (syllables == 1).sum() / n,
        n / len(sentences), *_at(per_sentence, _QUANTILES), (per_sentence**2).sum() / n, n / (1 + len(_CAPITAL.findall(text))),
        len(counts) / n, len(counts) / n**0.5, sum(shared) / (1 + len(shared)), *(_at(np.array(shared), _SPREAD) if shared else _NONE_SHARED), text.count(",") / n, (text.count(";") + text.count(":")) / n, text.count("?") / n, text.count("-") / n,
        *(sum(counts.get(w, 0) for w in g) / n for g in _GROUPS), np.log(n),
    ]
    return np.array(out, float)


def _difficulty_features(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Features of how demanding the words of a text are, given in order, with the number of words of each sentence."""
    means = np.add.reduceat(values, np.concatenate(([0], np.cumsum(sizes)[:-1]))) / sizes
    mean = values.sum() / len(values)
    return np.array([mean, max(0.0, (values**2).sum() / len(values) - mean**2) ** 0.5, *_at(values, _QUANTILES), *_at(means, _QUANTILES)])


@dataclass
class ReadingModel:
    """What turns a text into a band. ``difficulty`` is by word id."""

    difficulty: dict[int, float]
    middle: float
    trees: Boosted
    cuts: np.ndarray
    report: list[tuple[str, int, float, float, float]]
    known: dict[str, float] = field(default_factory=dict)

    def _difficulty_of(self, words: list[str]) -> list[float]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.difficulty.get(_word_id(w), self.middle)
            return [known[w] for w in words]

    def scores(self, measured: list[tuple[np.ndarray, list[list[str]]]]) -> np.ndarray:
        """The predicted level of each measured text."""
        if not measured:
            return np.empty(0)
        rows = [np.concatenate([f, _difficulty_features(np.array(self._difficulty_of([w for x in s for w in x])), np.array([len(x) for x in s]))]) for f, s in measured]
        return self.trees.predict(np.stack(rows))

    def bands(self, scores: np.ndarray) -> np.ndarray:
        """The band of each predicted level."""
        return (np.searchsorted(self.cuts, scores, "right") + BANDS[0]).astype(np.int32)


def _folds(groups: list[str], n: int, most: int = 5) -> np.ndarray:
    """The fold of each row: sources are kept whole, dealt largest first to the smallest fold; with fewer than three sources, rows are dealt in turn."""
    sizes: dict[str, int] = defaultdict(int)
    for g in groups:
        sizes[g] += 1
    if len(sizes) < 3:
        return np.arange(n) % min(most, max(2, n))
    folds, held = {}, [0] * min(most, len(sizes))
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        folds[g] = held.index(min(held))
        held[folds[g]] += sizes[g]
    return np.array([folds[g] for g in groups])


def _calibrate(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Thresholds between bands under which held-out predictions agree best with the ratings, each near the middle between its bands."""
    cuts = []
    for b in range(BANDS[0], BANDS[1]):
        tried = np.linspace(b + 0.2, b + 0.8, 49)
        wrong = [float(np.sum(weight * ((scores >= c) != (y > b + 1e-9)))) + 1e-6 * abs(c - b - 0.5) for c in tried]
        cuts.append(tried[int(np.argmin(wrong))])
    return np.maximum.accumulate(np.array(cuts))


class _Vocabulary:
    """Ratings of the documents each word stands in, by fold, so that any folds can be left out."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, folds: np.ndarray) -> None:
        distinct = [np.unique(words) for words, _ in docs]
        row = np.repeat(np.arange(len(docs)), [len(d) for d in distinct])
        self.words, at = np.unique(np.concatenate(distinct), return_inverse=True)
        self.n_folds, size = int(folds.max()) + 1, len(self.words)
        slot = folds[row] * size + at
        self.seen = np.bincount(slot, weight[row], self.n_folds * size).reshape(self.n_folds, size)
        self.total = np.bincount(slot, (weight * y)[row], self.n_folds * size).reshape(self.n_folds, size)
        self.y, self.weight, self.folds = y, weight, folds
        self.kept = np.zeros(size, bool)
        self.kept[np.lexsort((self.words, -np.bincount(at, minlength=size)))[:MOST_WORDS]] = True
        self.docs = [(np.searchsorted(self.words, words), sizes) for words, sizes in docs]

    def difficulty(self, left_out: tuple[int, ...] = ()) -> tuple[np.ndarray, float]:
        """How demanding each word is: the mean band of the documents it stands in, drawn to the overall mean where they are few, without some folds."""
        folds = [k for k in range(self.n_folds) if k not in left_out]
        rows = np.isin(self.folds, folds)
        if not rows.any():
            folds, rows = [], np.ones(len(self.y), bool)
        middle = float(np.average(self.y[rows], weights=self.weight[rows]))
        seen, total = self.seen[folds].sum(0), self.total[folds].sum(0)
        return np.where(self.kept & (seen >= 2), (total + 3 * middle) / (seen + 3), middle), middle

    def features(self, fold: int, left_out: tuple[int, ...]) -> np.ndarray:
        """Vocabulary features of the rows of a fold, from the ratings of all but some folds."""
        table, _ = self.difficulty(left_out)
        rows = [_difficulty_features(table[self.docs[i][0]], self.docs[i][1]) for i in np.flatnonzero(self.folds == fold)]
        return np.stack(rows) if rows else np.empty((0, _N_DIFFICULTY))


#: Settings of the trees, alike for the shipped model and for those that are held against the ratings.
ROUNDS, RATE = 120, 0.1


def fit(plain: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], bands: np.ndarray, weight: np.ndarray, sources: list[str]) -> ReadingModel:
    """Fit a model to rated texts, given as features, (word ids, words of each sentence), ratings, weights and sources. Without any every document gets the middle band."""
    n = len(docs)
    if not n:
        trees = Boosted(rounds=0, edges=[np.empty(0)], base=(BANDS[0] + BANDS[1]) / 2)
        return ReadingModel({}, trees.base, trees, np.arange(BANDS[0], BANDS[1]) + 0.5, [])
    y = bands.astype(float)
    folds = _folds(sources, n)
    vocabulary = _Vocabulary(docs, y, weight, folds)
    every = range(vocabulary.n_folds)

    def rows_without(k: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(places of the training rows, their features) where fold ``k`` is held out; the ratings of a row's own fold don't count for it."""
        used = [j for j in every if j != k]
        at = [np.flatnonzero(folds == j) for j in used]
        own = [vocabulary.features(j, (j,) if k is None else (j, k)) for j in used]
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        return at, np.concatenate([plain[at], np.concatenate(own) if own else np.empty((0, _N_DIFFICULTY))], axis=1)

    held_out = np.full(n, np.average(y, weights=weight))
    for k in every:
        at, x = rows_without(k)
        test = np.flatnonzero(folds == k)
        if len(at) and len(test):
            model = Boosted(rounds=ROUNDS, rate=RATE).fit(x, y[at], weight[at])
            held_out[test] = model.predict(np.concatenate([plain[test], vocabulary.features(k, (k,))], axis=1))
    cuts = _calibrate(held_out, y, weight)
    got = np.searchsorted(cuts, held_out, "right") + BANDS[0]
    nearest = np.rint(y)
    report = []
    for s in sorted(set(sources)):
        at = np.array([g == s for g in sources])
        report.append((s, int(at.sum()), float(np.abs(held_out[at] - y[at]).mean()), float((got[at] == nearest[at]).mean()), float((np.abs(got[at] - nearest[at]) <= 1).mean())))
    at, x = rows_without(None)
    table, middle = vocabulary.difficulty()
    learnt = np.flatnonzero(table != middle)
    return ReadingModel(dict(zip(vocabulary.words[learnt].tolist(), table[learnt].tolist())), middle, Boosted(rounds=ROUNDS, rate=RATE).fit(x, y[at], weight[at]), cuts, report)


_MEASURED = "doc_id long, source string, band double, raters long, plain binary, words binary, sizes binary"


def _measure_rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, plain, words, sizes = [], [], [], []
        for i, text in enumerate(batch.column(4).to_pylist()):
            sentences = english_sentences(text)
            if sentences is not None:
                kept.append(i)
                plain.append(measure(text, sentences).tobytes())
                words.append(np.array([_word_id(w) for s in sentences for w in s], np.uint32).tobytes())
                sizes.append(np.array([len(s) for s in sentences], np.int32).tobytes())
        rows = batch.take(pa.array(kept, pa.int32()))
        yield pa.RecordBatch.from_arrays([*rows.columns[:4], *(pa.array(v, pa.binary()) for v in (plain, words, sizes))], names=["doc_id", "source", "band", "raters", "plain", "words", "sizes"])


def _fit_measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["source"], r["words"]))
    plain = np.stack([np.frombuffer(r["plain"], float) for r in rows]) if rows else np.empty((0, 0))
    docs = [(np.frombuffer(r["words"], np.uint32), np.frombuffer(r["sizes"], np.int32)) for r in rows]
    model = fit(plain, docs, np.array([r["band"] for r in rows]), np.array([min(3, r["raters"]) for r in rows], float), [r["source"] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train(documents: DataFrame, labels: DataFrame, most_rated: int = MOST_RATED) -> ReadingModel:
    """Fit on the rated English documents, at most ``most_rated`` drawn by hash.

    A document's target is the median of its ratings, once per rater; it weighs more the
    more raters it has. Null bands and bands beyond the scale are left out.
    """
    one = labels.where(f"band between {BANDS[0]} and {BANDS[1]} and doc_id is not null").groupBy("doc_id", "rater").agg(F.avg("band").alias("band"))
    rated = one.groupBy("doc_id").agg(F.percentile("band", 0.5).alias("band"), F.count(F.lit(1)).alias("raters"))
    drawn = F.broadcast(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rated))  # most_rated rows of three numbers at most
    rows = documents.where(F.length("text") <= MOST_CHARACTERS).select(F.col("doc_id").cast("long").alias("doc_id"), normal_name(F.col("source")).alias("source"), "text").join(drawn, "doc_id")
    measured = rows.select("doc_id", "source", "band", "raters", "text").mapInArrow(_measure_rated, _MEASURED)
    found = measured.repartition(1).mapInArrow(_fit_measured, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit(np.empty((0, 0)), [], np.empty(0), np.empty(0), [])


def _predictor(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001 - a broadcast of bytes
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ReadingModel = pickle.loads(model.value)
        for batch in batches:
            ids, measured = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sentences = english_sentences(text)
                if sentences is not None:
                    ids.append(doc_id)
                    measured.append((measure(text, sentences), sentences))
            scores = own.scores(measured)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own.bands(scores)), pa.array(scores)], names=["doc_id", "band", "level"])

    return run


def reading_levels(documents: DataFrame, labels: DataFrame, most_rated: int = MOST_RATED) -> DataFrame:
    """(doc_id, band, level) for each document whose text is English and has at least 50 words between spaces.

    ``level`` is the prediction before it is cut into bands. Null, empty and shorter
    texts and other languages give no row; repeated rows are kept. Whole texts count.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(pickle.dumps(train(documents, labels, most_rated)))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predictor(model), "doc_id long, band int, level double")


def reading_report(documents: DataFrame, labels: DataFrame, most_rated: int = MOST_RATED) -> DataFrame:
    """(source, documents, mean_error, same_band, within_one) of held-out predictions, by source."""
    rows = train(documents, labels, most_rated).report
    return documents.sparkSession.createDataFrame(rows, "source string, documents int, mean_error double, same_band double, within_one double")
