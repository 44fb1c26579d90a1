"""Language identification: known words first, shorter and shorter character n-grams for others.

Model. From the training documents come, for each language, the log frequencies
of its ``WORDS`` most frequent words and of its ``GRAMS[n]`` most frequent
character n-grams (words with a border mark on either side). A known word scores
its log frequency in each language. An unseen word scores the mean log frequency
of its longest n-grams that any language knows: four letters, else three, two, one.

Score. The log scores of all words of the text are summed (each distinct word once
per batch, kept in a bounded cache), the best language wins, and the score is its
posterior share.

Training reads a bounded sample: the ``SAMPLE_DOCS`` eligible documents with the
least hash of their id. Counts are DataFrame aggregations; what reaches the driver
is at most WORDS + sum(GRAMS) rows per language. Prediction is one pass.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with
no training documents every text is ``und``; documents with a null language are
predicted but not learned from; ties go to the language that sorts first.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, text_or_empty

SAMPLE_DOCS = 10_000
WORDS = 20_000
GRAMS = {1: 300, 2: 2_000, 3: 6_000, 4: 10_000}
#: What a language that lacks a word or n-gram is given: one count of so many in all.
FLOOR = math.log(1e-7)
CACHE = 200_000
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def held_out(ident: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % folds == 0


def sample(docs: DataFrame, n: int, id_col: str) -> DataFrame:
    """The ``n`` rows with the least hash of their id (more only if hashes tie)."""
    order = F.xxhash64(F.col(id_col))
    last = docs.select(order.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return docs.filter(order <= (0 if last is None else last))


#: Parts into which items of one count are dealt by their hash, so that a limit can fall within them.
TIES = 64


def _top(counts: DataFrame, most: Column) -> DataFrame:
    """The most frequent items of each (lang, n), ``most`` of them at most; of equally frequent ones those in the first parts by hash.

    Where the limit falls is read from how many items have each count, a short table,
    so that the items of a language are never sorted in one task.
    """
    rows = counts.withColumn("at", F.struct((-F.col("count")).alias("c"), F.pmod(F.xxhash64("item"), F.lit(TIES)).alias("part")))
    sizes = rows.groupBy("lang", "n", "at").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("lang", "n").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    limits = sizes.withColumn("sum", before).filter(F.col("sum") <= most).groupBy("lang", "n").agg(F.max("at").alias("last"))
    return rows.join(F.broadcast(limits), ["lang", "n"]).filter("at <= last").select(*counts.columns)  # a row for each language and n


def _grams(word: Column) -> Column:
    """Structs (n, item) of a word's n-grams, borders marked."""
    padded = F.concat(F.lit("_"), word, F.lit("_"))

    def of(n: int) -> Column:
        base = word if n == 1 else padded
        last = F.char_length(base) - (n - 1)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(base, i, F.lit(n)))
        return F.transform(F.filter(grams, lambda g: F.char_length(g) == n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("item")))

    return F.concat(*[of(n) for n in GRAMS])


class Model:
    """Log frequencies by word and by n-gram, as one vector over the languages each."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        """rows: (lang, n, item, count); n is 0 for words."""
        self.langs = sorted({r[0] for r in rows})
        totals: Counter = Counter()
        for lang, n, _, count in rows:
            totals[lang, n] += count
        at = {x: i for i, x in enumerate(self.langs)}
        self.tables: dict[int, dict[str, list[float]]] = {n: {} for n in (0, *GRAMS)}
        for lang, n, item, count in rows:
            row = self.tables[n].setdefault(item, [FLOOR] * len(self.langs))
            row[at[lang]] = math.log(count / totals[lang, n])
        self.cache: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            found = self.cache[word] = self._score(word)
        return found

    def _score(self, word: str) -> np.ndarray:
        if (known := self.tables[0].get(word)) is not None:
            return np.array(known)
        padded = f"_{word}_"
        for n in sorted(GRAMS, reverse=True):
            base, table = (word if n == 1 else padded), self.tables[n]
            rows = [r for i in range(len(base) - n + 1) if (r := table.get(base[i : i + n])) is not None]
            if rows:
                return np.mean(rows, axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(WORD.findall((text or "").lower()))
        words = {w: n for w, n in words.items() if any(map(str.isalpha, w))} if any(not w.isalpha() for w in words) else words
        if not words or not self.langs:
            return UNKNOWN, 0.0
        total = np.array(list(words.values()), dtype=float) @ np.array([self.word(w) for w in words])
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the documents with a language that ``held_out`` leaves in."""
    usable = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    taken = sample(usable, sample_docs, id_col).select(F.col(lang_col).alias("lang"), F.lower(text_or_empty(text_col)).alias("text"))
    words = taken.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("item")).groupBy("lang", "item").count()
    words = words.select("lang", F.lit(0).alias("n"), "item", "count").persist()
    grams = words.select("lang", "count", F.explode(_grams(F.col("item"))).alias("g")).groupBy("lang", "g.n", "g.item").agg(F.sum("count").alias("count"))
    most = F.coalesce(*[F.when(F.col("n") == n, F.lit(k)) for n, k in GRAMS.items()])
    rows = _top(words, F.lit(WORDS)).unionByName(_top(grams.select("lang", "n", "item", "count"), most)).select("lang", "n", "item", "count").collect()
    words.unpersist()
    return Model([tuple(r) for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WORDS + sum(GRAMS) rows a language at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            found = [sent.value.predict(t) for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"], "held_out": x["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
