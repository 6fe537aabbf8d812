"""Language identification: words first, then ever shorter character n-grams.

The model holds log frequencies per language of the most frequent words, and of the character n-grams of all words. A
known word counts with its own log frequencies; an unseen word with the mean over its n-grams of the longest size of
which the model knows any. Models are fitted on a bounded sample of labelled rows and hold a bounded number of terms, so
they are small enough to broadcast whatever the corpus size.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000  # labelled rows used for fitting, at most about; an equal part per language
MODEL_WORDS = 60_000
MODEL_GRAMS = 120_000
LONGEST_GRAM = 5
UNDETERMINED = "und"
CACHED_WORDS = 200_000  # vectors a worker remembers


_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _not_letters() -> str:
    """What :data:`_WORD` takes besides letters (Unicode categories L*), as ranges of a character class."""
    points = [c for c in range(sys.maxunicode + 1) if _WORD.match(chr(c)) and not unicodedata.category(chr(c)).startswith("L")]
    spans: list[list[int]] = []
    for c in points:
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def letter_words(text: str) -> list[str]:
    """Runs of letters. Texts with numbers such as superscripts or fractions, which are rare, are read by a slower class."""
    if text.isascii() or not re.search(f"[{_not_letters()}]", text):
        return _WORD.findall(text)
    return re.findall(f"[^\\W\\d_{_not_letters()}]+", text)


_SMOOTHING = 0.5


@dataclass(frozen=True)
class Model:
    """Languages in order, and per word or n-gram one log frequency per language."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]


def is_held_out(doc_id: Column) -> Column:
    """Whether ``crc32(doc_id as text) mod 3`` is 1; a null id is not held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _frequencies(counts: DataFrame, most: int, languages: list[str]) -> dict[str, np.ndarray]:
    totals = dict(counts.groupBy("lang").agg(F.sum("n")).collect())  # one row per language
    number = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    # columns are named by the languages' numbers, whatever the languages are called
    numbered = counts.select("term", "n", F.element_at(number, F.col("lang")).alias("number"))
    kept = numbered.groupBy("term").pivot("number", list(range(len(languages)))).agg(F.sum("n")).fillna(0)
    names = [str(i) for i in range(len(languages))]
    size = sum((F.col(f"`{name}`") for name in names), F.lit(0))
    table = kept.orderBy(size.desc(), "term").limit(most).toPandas()
    values = table[names].to_numpy(np.float64)
    below = np.array([totals.get(name, 0) for name in languages], np.float64) + _SMOOTHING * max(len(table), 1)
    return dict(zip(table["term"], np.log((values + _SMOOTHING) / below).astype(np.float32)))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``labelled(doc_id, text, lang)``; rows without text or lang teach nothing.

    Every language gets an equal part of ``sample_rows``: all rows of one that has no more, else a sample of about that
    many, drawn by a hash of doc_id and text.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = dict(rows.groupBy("lang").count().collect())  # one row per language
    languages = sorted(counts)
    part = max(sample_rows // max(len(languages), 1), 1)
    if sum(counts.values()) > sample_rows:
        limits = {name: int(part / count * (1 << 30)) for name, count in counts.items() if count > part}
        draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1 << 30))
        limit = reduce(lambda case, name: case.when(F.col("lang") == name, F.lit(limits[name])), limits, F.when(F.lit(False), F.lit(0)))
        rows = rows.where(draw < F.coalesce(limit, F.lit(1 << 30)))
    if not languages:
        return Model([], {}, {})
    words = rows.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term")).where("term != ''")
    words = words.groupBy("term", "lang").agg(F.count(F.lit(1)).alias("n")).persist()
    padded = F.concat(F.lit("_"), F.col("term"), F.lit("_"))
    cuts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(LONGEST_GRAM)),
            lambda size: F.when(
                F.length(padded) >= size,
                F.transform(F.sequence(F.lit(1), F.length(padded) - size + 1), lambda at: F.substring(padded, at, size)),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    grams = words.select("lang", "n", F.explode(cuts).alias("term")).where("term != '_'")
    grams = grams.groupBy("term", "lang").agg(F.sum("n").alias("n"))
    model = Model(languages, _frequencies(words, MODEL_WORDS, languages), _frequencies(grams, MODEL_GRAMS, languages))
    words.unpersist()
    return model


class Scorer:
    """Log frequencies of a word, backing off to n-grams."""

    def __init__(self, model: Model):
        self.model = model

    def vector(self, word: str) -> np.ndarray:
        known = self.model.words.get(word)
        if known is not None:
            return known
        padded, grams = f"_{word}_", self.model.grams
        for size in range(min(LONGEST_GRAM, len(padded)), 0, -1):
            found = [v for at in range(len(padded) - size + 1) if (v := grams.get(padded[at : at + size])) is not None]
            if found:
                return np.mean(found, axis=0, dtype=np.float32)
        return np.zeros(len(self.model.languages), np.float32)


class WordTable(dict):
    """Word to row of a growing table of vectors; starts anew when it holds ``CACHED_WORDS``."""

    def __init__(self, scorer: Scorer):
        super().__init__()
        self.scorer = scorer
        self.fresh: list[np.ndarray] = []
        self.vectors = np.empty((0, len(scorer.model.languages)), np.float32)
        self.share = self.vectors
        self.used = 0

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.fresh.append(self.scorer.vector(word))
        return at

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of all words so far, and the share of each language among the languages, given the word."""
        if self.fresh:
            new = np.array(self.fresh, np.float32)
            end = self.used + len(new)
            if end > len(self.vectors):
                room = np.empty((end, new.shape[1]), np.float32)
                self.vectors, self.share = (np.concatenate([old[: self.used], room]) for old in (self.vectors, self.share))
            odds = np.exp(new - new.max(axis=1, keepdims=True))
            self.vectors[self.used : end] = new
            self.share[self.used : end] = odds / odds.sum(axis=1, keepdims=True)
            self.used, self.fresh = end, []
        return self.vectors, self.share


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score``.

    The prediction maximises the summed log frequencies of the text's words; ties go to the first language in order. The
    score is the mean over the words of the predicted language's share among the languages, given that word (0 to 1).
    Texts that are null or hold no letter, and all texts under a model without languages, are ``und`` with score 0.
    Columns named ``lang_pred`` or ``score`` are replaced; repeated rows are judged one by one; an empty table stays empty.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list, table: WordTable) -> tuple[list[str], list[float]]:
        languages = table.scorer.model.languages
        index, sizes = [], []
        for text in texts:
            words = letter_words(text.lower()) if text else ()
            index.extend(map(table.__getitem__, words))
            sizes.append(len(words))
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not index or not languages:
            return names, scores
        vectors, share = table.arrays()
        index = np.array(index)
        at = 0
        for i, size in enumerate(sizes):
            if size:
                own = index[at : at + size]
                best = int(np.argmax(vectors[own].sum(axis=0, dtype=np.float64)))
                names[i] = languages[best]
                scores[i] = float(min(1.0, share[own, best].mean(dtype=np.float64)))
                at += size
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        table = WordTable(scorer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                if len(table) > CACHED_WORDS:
                    table = WordTable(scorer)
                names, scores = judge(part.column("text").to_pylist(), table)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*keep, "lang_pred", "score"],
                )

    types = dict(docs.dtypes)
    fields = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "lang_pred string, score double"])
    return docs.select(*keep, *[c for c in ["text"] if c not in keep]).mapInArrow(run, fields)
