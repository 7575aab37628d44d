"""Language identification by word-first backoff.

A word that the model knows scores by its log frequency in each language. An unseen word falls back to its character
n-grams, longest first: the first length of which the model knows any n-gram of the word gives the mean log frequency.
A document's language has the highest sum over its words.

The model is fitted on a bounded sample of labelled documents (``DOCS_PER_LANG`` whole documents and ``CHARS_PER_LANG``
characters per language, ``SAMPLE_CHARS`` characters in all, chosen by a hash of the id) and pruned to ``MAX_WORDS`` words
and ``MAX_GRAMS`` n-grams of each length per language. Every language that a labelled document has can be predicted: with
many languages each one's share of the sample shrinks, and no language is left out. A key is stored for the languages that
have it; the others share one value per language and length. Prediction reads whole texts, and nothing but the text.

Nulls: a null text, or one without letters, gives ``und`` with score 0. Rows whose lang or text is null are not learned
from; without any labelled row (an empty table too) every prediction is ``und``. A null id is not held out and not learned
from. Ties go to the language that sorts first. Repeated rows each get a row. Very long texts are counted word by word in
one pass. Only the id, text and lang columns are read, so other columns may have any name; an input column named as the
result's gives way to it.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql import types as T

DOCS_PER_LANG, CHARS_PER_LANG, SAMPLE_CHARS = 400, 2_000_000, 100_000_000
MAX_WORDS, MAX_GRAMS, ORDERS = 30_000, 8_000, (5, 4, 3, 2, 1)
CACHE = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def sample(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, chars_per_lang: int = CHARS_PER_LANG) -> DataFrame:
    """(lang, text): the bounded training sample. labelled has doc_id, text, lang without nulls, and no other column."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    spark = labelled.sparkSession
    share = {r.lang: min(1.0, 2.0 * docs_per_lang / r.n) for r in sizes}
    if not share:
        return labelled.select("lang", "text").limit(0)
    chars_per_lang = min(chars_per_lang, SAMPLE_CHARS // len(share))
    shares = spark.createDataFrame(list(share.items()), "lang string, share double")
    # A hash threshold first, so that the ranking below sees about twice the bound, never a whole language.
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    few = labelled.join(F.broadcast(shares), "lang").where(place < F.col("share"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    ranked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_per_lang)
    size = F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("size", size).where((F.col("size") <= chars_per_lang) | (F.col("rank") == 1)).select("lang", "text")


class Model:
    """Words and n-grams are keys. A key has a weight above the floor for each language whose texts have it.

    ``floors`` holds what a key that a language lacks is worth there, per length (words first). The weights of key i are
    ``above[first[i] : first[i + 1]]`` for the languages ``lang[...]`` of the same places.
    """

    def __init__(self, rows: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in rows})
        self.floors = np.zeros((1 + len(ORDERS), len(self.langs)))
        self._first, self._lang, self._above = [0], [], []
        words = [Counter() for _ in self.langs]
        number = {lang: j for j, lang in enumerate(self.langs)}
        for lang, text in rows:
            words[number[lang]].update(LETTERS.findall(text.lower()))
        self.words = self._add(words, MAX_WORDS, 0)
        self.grams = {}
        for level, n in enumerate(ORDERS, 1):
            counts = []
            for of_lang in words:
                c = Counter()
                for w, k in of_lang.items():
                    for g in self.split(w, n):
                        c[g] += k
                counts.append(c)
            self.grams[n] = self._add(counts, MAX_GRAMS, level)
        self.first = np.array(self._first)
        self.lang = np.array(self._lang, np.int64)
        self.above = np.array(self._above, float)
        del self._first, self._lang, self._above
        self.cache: dict[str, tuple[int, list[int]]] = {}

    @staticmethod
    def split(word: str, n: int) -> list[str]:
        padded = f" {word} " if n > 1 else word
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    def _add(self, counts: list[Counter], most: int, level: int) -> dict[str, int]:
        """Numbers of the commonest keys of each language."""
        keys = sorted({k for c in counts for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]})
        log_total = [float(np.log(c.total() + 0.5 * (len(keys) + 1))) for c in counts]
        self.floors[level] = np.log(0.5) - np.array(log_total)
        has: dict[str, list[tuple[int, int]]] = {k: [] for k in keys}
        for j, c in enumerate(counts):
            for k, n in c.items():
                if k in has:
                    has[k].append((j, n))
        start = len(self._first) - 1
        for k in keys:
            for j, n in has[k]:
                self._lang.append(j)
                self._above.append(float(np.log(n + 0.5) - np.log(0.5)))
            self._first.append(len(self._lang))
        return {k: start + i for i, k in enumerate(keys)}

    def unseen(self, word: str) -> tuple[int, list[int]]:
        """(level, known n-grams) of the longest length of which the word has any."""
        for level, n in enumerate(ORDERS, 1):
            get = self.grams[n].get
            known = [i for i in map(get, self.split(word, n)) if i is not None]
            if known:
                return level, known
        return 0, []

    def totals(self, counts: Counter) -> np.ndarray:
        """Log score of each language for words with their counts."""
        keys, weights, used = [], [], [0.0] * len(self.floors)
        get, cache = self.words.get, self.cache
        for w, k in counts.items():
            i = get(w)
            if i is not None:
                keys.append(i)
                weights.append(k)
                used[0] += k
                continue
            found = cache.get(w)
            if found is None:
                if len(cache) >= CACHE:
                    cache.clear()
                found = cache[w] = self.unseen(w)
            level, grams = found
            if grams:
                # The mean over the n-grams, as a weight of each.
                keys += grams
                weights += [k / len(grams)] * len(grams)
                used[level] += k
        total = np.array(used) @ self.floors
        if keys:
            at = np.array(keys)
            start, size = self.first[at], self.first[at + 1] - self.first[at]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
            total += np.bincount(self.lang[place], np.repeat(np.array(weights, float), size) * self.above[place], len(total))
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(LETTERS.findall(text.lower())) if text else None
        # Digits such as superscripts match the pattern too, so a letter is asked for.
        if not counts or not self.langs or not any(c.isalpha() for w in counts for c in w):
            return "und", 0.0
        total = self.totals(counts)
        n = counts.total()
        best = int(np.argmax(np.round(total, 9)))
        # Evidence grows with the square root of the length: words of one text are not independent.
        likely = np.exp((total - total[best]) / n * min(n, 4 + n**0.5))
        return self.langs[best], float(1 / likely.sum())


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> Model:
    """Fit on the bounded sample of rows that have id, text and lang; only that sample reaches the driver."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return Model([(r.lang, r.text) for r in sample(rows.dropna(), **bounds).collect()])


def predict(df: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """df with a struct column ``out``: lang_pred, score."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=RESULT.names)

    return df.withColumn(out, run(F.col(text_col)))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id's text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out())
    model = fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", "language.lang_pred", "language.score"
    )
