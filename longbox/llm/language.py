"""Language identification: known words first, then shorter and shorter character n-grams.

A known word adds its log frequency in each language.  An unseen word is looked up by its n-grams of the longest
size of which any is known, and adds the mean log frequency of those; a word with no known n-gram adds nothing.
The score is the posterior probability of the best language under equal priors; equal ones go to the first by name.

A model holds every word and n-gram of a bounded sample of labelled documents, drawn by language, as sorted 64-bit
hashes with a row of scores each.  Words of a batch are looked up together.

Null texts and texts without a letter are ``und`` with score 0, and so is all where nothing was learned.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.llm.shared import Store, in_arrow, map_batches, slices

#: Bound of the labelled sample that a model is fitted on, in documents of each language.
TRAINING_DOCS = 2_000
LONGEST_GRAM = 5
#: Seed of Spark's xxhash64, which words are counted by.
_SEED = 42
#: A letter, then letters and marks: the same where words are counted and where they are looked up.
WORD = r"\p{L}[\p{L}\p{M}]*"
_WORD = regex.compile(WORD)
#: Lower-case texts without characters from U+0250 on, general punctuation aside: there these are all the letters.
_OTHER = re.compile("[ɐ-῿⁰-\U0010ffff]")
_LATIN_WORD = re.compile("[a-zªµºß-öø-ɏ]+")


def words_of(text: str | None) -> list[str]:
    """Words in lower case, in text order."""
    if not text:
        return []
    text = text.lower()
    return _WORD.findall(text) if _OTHER.search(text) else _LATIN_WORD.findall(text)


def _hashes(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t, _SEED) for t in texts], np.uint64)


def _keyed(keys: Mapping[str, int] | np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their rows of scores."""
    if isinstance(keys, Mapping):
        scores = scores[list(keys.values())] if keys else scores
        keys = _hashes(list(keys))
    order = np.argsort(keys, kind="stable")
    return keys[order], np.asarray(scores, np.float32)[order]


@dataclass
class LanguageModel:
    """Log frequencies: a row for each word or n-gram (given by name, or as hashes), a column for each language."""

    languages: list[str]
    words: Mapping[str, int] | np.ndarray
    word_scores: np.ndarray
    grams: Mapping[str, int] | np.ndarray
    gram_scores: np.ndarray

    def __post_init__(self) -> None:
        self.words, self.word_scores = _keyed(self.words, self.word_scores)
        self.grams, self.gram_scores = _keyed(self.grams, self.gram_scores)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words, by the words themselves and then by n-grams of falling size."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        row, hit = _found(self.words, _hashes(words))
        out[hit] = self.word_scores[row[hit]]
        left, marked = np.flatnonzero(~hit), [f"<{w}>" for w in words]
        for n in range(LONGEST_GRAM, 0, -1):
            if not len(left):
                break
            sizes = [max(0, len(marked[k]) - n + 1) for k in left]
            row, known = _found(self.grams, _hashes([marked[k][i : i + n] for k in left for i in range(len(marked[k]) - n + 1)]))
            owner = np.repeat(np.arange(len(left)), sizes)[known]
            sums, count = np.zeros((len(left), len(self.languages))), np.bincount(owner, minlength=len(left))
            np.add.at(sums, owner, self.gram_scores[row[known]])
            out[left[count > 0]] = sums[count > 0] / count[count > 0, None]
            left = left[count == 0]
        return out

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        store = self.__dict__.setdefault("_store", Store())
        known, k = store.open(), len(self.languages)
        if not known:
            self._table = np.zeros((0, k), np.float32)
        found = [words_of(t) for t in texts]
        flat = [w for x in found for w in x]
        rows = list(map(known.get, flat))
        if None in rows:
            new = list({w for w, r in zip(flat, rows, strict=True) if r is None})
            start = len(self._table)
            self._table = np.concatenate([self._table, self.look_up(new)])
            for i, w in enumerate(new):
                store.keep(w, start + i, 4 * len(w) + 4 * k)
            rows = list(map(known.get, flat))
        sizes = np.array([len(x) for x in found], np.int64)
        full = np.flatnonzero(sizes)
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if k and len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            total = np.add.reduceat(self._table[rows], starts, axis=0, dtype=np.float64)
            odds = np.exp(total - total.max(1, keepdims=True))
            best = odds.argmax(1)
            scores[full] = odds[np.arange(len(full)), best] / odds.sum(1)
            for i, b in zip(full, best, strict=True):
                names[i] = self.languages[b]
        return names, scores

    def predict(self, text: str | None) -> tuple[str, float]:
        names, scores = self.predict_all([text])
        return names[0], float(scores[0])


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hashes in sorted keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return row, keys[row] == wanted


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def _log_frequencies(counts: DataFrame, totals: dict[str, int], smooth: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what ``(key, lang, n)`` counts, and a row of log frequencies for each: shares between languages, on a common scale for words and n-grams."""
    languages = sorted(totals)
    by_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("float").alias(f"n{i}") for i, x in enumerate(languages)]
    rows = counts.groupBy("key").agg(*by_lang).toPandas()
    table = np.stack([rows[f"n{i}"].to_numpy(np.float64) for i in range(len(languages))], 1)
    scores = np.log((table + smooth) / (np.array([float(totals[x]) for x in languages]) + smooth * (len(rows) + 1)))
    return rows["key"].to_numpy(np.int64).view(np.uint64), (scores - np.logaddexp.reduce(scores, axis=1, keepdims=True)).astype(np.float32)


def training_sample(labelled: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", per_language: int = TRAINING_DOCS) -> DataFrame:
    """Of each language at most about ``per_language`` documents, taken by a hash of their id; all, if there are fewer.

    A language's share is one of so many parts of its documents that none holds more than ``per_language`` on average.
    """
    parts = labelled.where(F.col(lang_col).isNotNull()).groupBy(lang_col).agg(F.ceil(F.count(F.lit(1)) / per_language).alias("_parts"))
    return labelled.join(F.broadcast(parts), lang_col).where(F.pmod(F.xxhash64(id_col), F.col("_parts")) == 0).drop("_parts")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", training_docs: int = TRAINING_DOCS) -> LanguageModel:
    """Model of a labelled table, learned from at most about ``training_docs`` documents of each language.

    Words are counted by language where they stand; the driver gets a hash and a number for each language of the
    sample's words and n-grams, none left out.
    """
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    found = training_sample(rows, per_language=training_docs).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    counts = found.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).persist()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        counts.unpersist()
        return LanguageModel([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    words = _log_frequencies(counts.select(F.xxhash64("word").alias("key"), "lang", "n"), totals)
    marked = counts.withColumn("word", F.concat(F.lit("<"), "word", F.lit(">")))
    spelled = marked.select("lang", "n", F.explode(F.expr(f"flatten(transform(sequence(1, least({LONGEST_GRAM}, length(word))), k -> transform(sequence(1, length(word) - k + 1), i -> xxhash64(substr(word, i, k)))))")).alias("key"))
    grams = _log_frequencies(spelled, totals)
    counts.unpersist()
    return LanguageModel(sorted(totals), *words, *grams)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of each whole text.  The model is bounded by its sample, and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict_all(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learn from the rows that are not held out and predict all."""
    return predict(docs, fit(docs.where(~held_out(id_col)), id_col), id_col)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is found with a score of at least ``least``; all columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out())))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                names, scores = model.value.predict_all(part.column(at).to_pylist())
                yield part.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
