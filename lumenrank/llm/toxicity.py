"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

Restoration. Tokens that may be disguised - letters mixed with look-alike digits
and symbols, letters spaced out one by one, letters repeated three times or more,
letters joined by dots or dashes - span a lattice: each character may stand for
itself or a letter it looks like, a separator for nothing, and a run for one or
two of its letter. In letters spaced out one by one, words may end at any place, so
a run of several words is segmented on the way. Viterbi finds the path that a character trigram model likes
best, and the letters on it are the restored word. All other tokens have one path
only and stay as they are.

Score. A word is evidence if it, or its first 4 to 6 letters, occurs so much more
in toxic training documents than in others, for the words of both, that the G-test
passes ``LEAST_G``; its weight is the smoothed share of toxic use. The score of a text
is one minus the product of (1 - weight) over its distinct evidence words, from
the base rate ``PRIOR`` up.

Training reads all labelled rows that the fold leaves in. Every word of theirs counts for the character model and every
feature that passes the tests may become evidence; counts and toxic documents' words are shuffled, no other texts. The driver gets the
evidence that stays and the distinct trigrams, whose numbers follow the toxic vocabulary and the alphabet. Scoring is one pass.

Defined cases: a null or empty text scores ``PRIOR``; unlabelled documents are
scored alike; a document with several labels counts as toxic if any is; without
training rows every text scores ``PRIOR``; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, ship, text_or_empty

LEAST_G = 18.0
#: Least share of toxic use for a word to count.
LEAST_WEIGHT = 0.92
#: How many other features explain a document; least share of unexplained ones.
EXPLAINED, LEAST_OPEN = 3, 0.2
#: Unlike unexplained documents (by min-hash) that a feature needs.
LEAST_TEXTS = 4
PRIOR = 0.02
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
#: Pairs of bitmaps, of four kilobytes each, that all tasks are told of at most.
SENT_BITMAPS = 4096
CACHE = 200_000

#: Letters that a character may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
    "*": "aeiou", "#": "h",
}
SEPARATORS = set(".-_*~·'`")
EDGE = re.compile(r"^[^\w@$!|+(<€£¡*]+|[^\w@$|+€£]+$")
SPACED = re.compile(r"(?<!\S)[^\w\s@$!|]*((?:[^\W_]|[@$!|])(?:\s+(?:[^\W_]|[@$!|])){2,})(?=[^\w\s]*(?:\s|\Z))")
RUN = re.compile(r"(.)\1{2,}")


def held_out(ident: Column, folds: int = 3) -> Column:
    """Whether crc32 of the id as text leaves remainder 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % folds == 1


class CharModel:
    """Interpolated character trigrams over words, and over trigrams counted already; ``^`` starts and ``$`` ends a word."""

    def __init__(self, words: Iterable[tuple[str, float]], trigrams: Iterable[tuple[str, float]] = ()):
        self.tri, self.bi, self.uni = Counter(), Counter(), Counter()
        self.tri_of, self.bi_of, self.total = Counter(), Counter(), 0.0
        for trigram, n in trigrams:
            self._add(*trigram, n)
        for word, n in words:
            padded = f"^^{word}$"
            for i in range(2, len(padded)):
                self._add(padded[i - 2], padded[i - 1], padded[i], n)
        self.seen: dict[tuple[str, str, str], float] = {}

    def _add(self, a: str, b: str, c: str, n: float) -> None:
        self.tri[a, b, c] += n
        self.tri_of[a, b] += n
        self.bi[b, c] += n
        self.bi_of[b] += n
        self.uni[c] += n
        self.total += n

    def cost(self, a: str, b: str, c: str) -> float:
        """-log P(c | a, b)."""
        found = self.seen.get((a, b, c))
        if found is None:
            p = 0.7 * self.tri[a, b, c] / (self.tri_of[a, b] or 1) + 0.2 * self.bi[b, c] / (self.bi_of[b] or 1) + 0.09 * self.uni[c] / (self.total or 1) + 1e-5
            found = self.seen[a, b, c] = -math.log(p)
        return found


def lattice(token: str) -> list[tuple[str, ...]]:
    """For each place of a token, the letters it may stand for; "" is nothing."""
    places: list[tuple[str, ...]] = []
    at = 0
    while at < len(token):
        end = at + 1
        while end < len(token) and token[end] == token[at]:
            end += 1
        c, n = token[at], end - at
        looks = tuple(LOOKS.get(c, ""))
        if c.isalpha():
            places += [(c,)] * n if n < 3 else [(c,), (c, "")]
        elif looks and n < 3:
            places += [looks + ((c,) if c.isdigit() else ("",) if c in SEPARATORS else ())] * n
        elif looks:
            places += [looks, (*looks, "")]
        elif c in SEPARATORS or c.isspace():
            places.append(("",))
        else:
            places += [(c,)] * n
        at = end
    return places


def viterbi(places: list[tuple[str, ...]], model: CharModel) -> str:
    """The word on the cheapest path through a lattice."""
    best: dict[tuple[str, str], tuple[float, str]] = {("^", "^"): (0.0, "")}
    for letters in places:
        nxt: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (cost, word) in best.items():
            for c in letters:
                state = (b, c) if c else (a, b)
                new = cost + (model.cost(a, b, c) if c else 0.5)
                if state not in nxt or new < nxt[state][0]:
                    nxt[state] = new, word + c
        best = nxt
    return min((cost + model.cost(a, b, "$"), word) for (a, b), (cost, word) in best.items())[1]


def disguised(token: str) -> bool:
    """Whether a token without its edge punctuation has more than one reading."""
    if token.isalpha():
        return RUN.search(token) is not None
    letters = sum(map(str.isalpha, token))
    odd = sum(c in LOOKS or c in SEPARATORS for c in token)
    return bool(letters) and letters + odd == len(token) and len(token) >= 4 and 3 * letters >= len(token)


def restore_token(token: str, model: CharModel) -> str:
    core = EDGE.sub("", token)
    return viterbi(lattice(core), model) if disguised(core) else core


def spaced_words(run: str, model: CharModel) -> list[str]:
    """The words on the cheapest path through the lattice of letters spaced out one by one, where words may end at any place."""
    best: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}
    for at, letters in enumerate(lattice(run)):
        if at:
            cost, path = min(((cost + model.cost(a, b, "$"), path) for (a, b), (cost, path) in best.items() if b != "^"), key=lambda x: x[0], default=(math.inf, None))
            best["^", "^"] = min(best.get(("^", "^"), (math.inf, None)), (cost, (path, " ")), key=lambda x: x[0])
        nxt: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in best.items():
            for c in letters:
                state = (b, c) if c else (a, b)
                new = cost + (model.cost(a, b, c) if c else 0.5)
                if state not in nxt or new < nxt[state][0]:
                    nxt[state] = new, (path, c) if c else path
        best = nxt
    path = min(((cost + model.cost(a, b, "$"), path) for (a, b), (cost, path) in best.items()), key=lambda x: x[0])[1]
    letters = []
    while path:
        path, c = path
        letters.append(c)
    return "".join(reversed(letters)).split()


def spaced_runs(low: str) -> list[str]:
    return ["".join(m[1].split()) for m in SPACED.finditer(low)]


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens; letters that are spaced out one by one form one."""
    low = text.lower()
    return low.split() + spaced_runs(low)


def features(word: str) -> list[str]:
    return [word] + [word[:n] + "-" for n in PREFIXES if len(word) > n]


class Model:
    def __init__(self, evidence: dict[str, float], chars: CharModel):
        self.evidence, self.chars, self.cache = evidence, chars, {}

    def weight(self, token: str) -> tuple[str, float]:
        """The word that a token restores to, and its weight."""
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            core = EDGE.sub("", token)
            words = {core, restore_token(token, self.chars)}
            found = self.cache[token] = max((max(self.evidence.get(f, 0.0) for f in features(w)), w) for w in words)[::-1]
        return found

    def score(self, text: str | None) -> float:
        hits = {}
        low = (text or "").lower()
        runs = spaced_runs(low)
        for token in {*low.split(), *runs, *(w for run in set(runs) for w in spaced_words(run, self.chars))}:
            word, weight = self.weight(token)
            if weight:
                hits[word] = weight
        clean = 1.0 - PRIOR
        for weight in hits.values():
            clean *= 1.0 - weight
        return 1.0 - clean


def g_test(a: int, b: int, e1: int, e0: int) -> float:
    """G of counts a and b at exposures e1 and e0; negative if a is the rarer one."""
    share = (a + b) / (e1 + e0)
    g = 2 * sum(x * math.log(x / (e * share)) for x, e in ((a, e1), (b, e0)) if x)
    return g if a * e0 > b * e1 else -g


def _prefixes(word: Column) -> Column:
    """The features of a word but itself."""
    return F.array_compact(F.array(*[F.when(F.char_length(word) > n, F.concat(F.substring(word, 1, n), F.lit("-"))) for n in PREFIXES]))


def _likely(counted: DataFrame, e1: int, e0: int) -> DataFrame:
    """(feature, weight, g): the features (feature, neg, pos) that pass the tests, for ``e1`` toxic and ``e0`` other ones.

    Counts are held against the words of each class, so neither rare toxicity nor long toxic texts blur them.
    A prefix that one word accounts for says nothing about other words.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    share = (pos + neg) / float(e1 + e0)
    term = lambda x, e: F.when(x > 0, x * F.log(x / (share * float(e)))).otherwise(0.0)
    likely = counted.filter((F.col("pos") >= 3) & (pos * float(e0) > neg * float(e1) * 4)).withColumns({"g": 2 * (term(pos, e1) + term(neg, e0)), "weight": (pos + 0.1) / (pos + neg * (e1 / e0) + 0.3)})
    words = likely.filter(~F.col("feature").endswith("-"))
    most = words.select(F.explode(_prefixes(F.col("feature"))).alias("feature"), F.col("pos").alias("one")).groupBy("feature").agg(F.max("one").alias("one"))
    passed = likely.filter((F.col("g") >= LEAST_G) & (F.col("weight") >= LEAST_WEIGHT)).join(most, "feature", "left")
    return passed.filter(F.col("one").isNull() | (F.col("one") < 0.8 * pos)).select("feature", "weight", "g")


def _needed(toxic: DataFrame, likely: DataFrame) -> dict[str, float]:
    """The weights of the features, strongest first, that explain toxic documents which stronger ones leave open.

    Copies of one toxic document lend all of its words the same counts. Such
    words find their documents explained by ``EXPLAINED`` stronger words already,
    or all in texts with one min-hash, and drop out; words that unlike documents
    share don't. Toxic documents with the same words are one row with their
    number. Features are chosen one after another, so their documents pass through one task as a sorted stream,
    which holds the documents of one feature and up to ``EXPLAINED`` + 1 stems of each document. The driver gets the features that stay.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            words = [set(text.lower().split()) for text in x["text"]]
            yield pd.DataFrame({"mark": [min((zlib.crc32(w.encode()) for w in ws), default=0) for ws in words], "words": [sorted({EDGE.sub("", t) for t in ws}) for ws in words]})

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        explained: dict[int, tuple[str, ...]] = {}
        rows = (row for x in frames for row in zip(x["feature"], x["weight"], x["doc"], x["mark"], x["n"]))
        for (feature, weight), where in groupby(rows, key=lambda r: r[:2]):
            stem, where = feature[: PREFIXES[0]], [r[2:] for r in where]
            left = [(mark, n) for d, mark, n in where if len(explained.get(d, ())) - (stem in explained.get(d, ())) < EXPLAINED]
            if sum(n for _, n in left) >= LEAST_OPEN * sum(n for _, _, n in where) and len({mark for mark, _ in left}) >= LEAST_TEXTS:
                yield pd.DataFrame({"feature": [feature], "weight": [weight]})
                for d, _, _ in where:
                    stems = explained.get(d, ())
                    # one more than EXPLAINED decides for any stem
                    if stem not in stems and len(stems) <= EXPLAINED:
                        explained[d] = (*stems, stem)

    docs = cut(toxic.mapInPandas(run, "mark long, words array<string>").groupBy("mark", "words").agg(F.count("*").alias("n")).withColumn("doc", F.monotonically_increasing_id()))
    found = F.array_distinct(F.concat("words", F.flatten(F.transform("words", _prefixes))))
    met = docs.select("doc", "mark", "n", F.explode(found).alias("feature")).join(likely, "feature")
    one = met.select("feature", "weight", "g", "doc", "mark", "n").repartition(1).sortWithinPartitions(F.desc("g"), "feature", "doc")
    return {r["feature"]: r["weight"] for r in one.mapInPandas(choose, "feature string, weight double").collect()}


def labelled(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(text, toxic) of the documents (id, text) that ``marked`` (id, toxic; each id once) names.

    Whole ids are marked in bitmaps of 32,768 ids, which all tasks are told of, so that texts stay where they
    are. Where ids are so scattered that this makes more than SENT_BITMAPS of them, or are no whole numbers, rows meet by their ids.
    """
    if all(isinstance(x.schema["id"].dataType, IntegralType) for x in (docs, marked)):
        bucket, at = F.bitmap_bucket_number("id"), F.bitmap_bit_position("id")
        if marked.select(bucket).distinct().limit(SENT_BITMAPS + 1).count() <= SENT_BITMAPS:
            bits = marked.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(at).alias("known"), F.bitmap_construct_agg(F.when(F.col("toxic") == 1, at)).alias("bad"))
            byte = lambda c: F.conv(F.hex(F.substring(c, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            bit = lambda c: F.floor(byte(c) / F.pow(F.lit(2.0), at % 8)).cast("int") % 2
            met = docs.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket")
            return met.filter(bit(F.col("known")) == 1).select("text", bit(F.col("bad")).alias("toxic"))
    return docs.join(marked, "id").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Evidence and character model from all words of all labelled rows that ``held_out`` leaves in."""
    ship(docs.sparkSession)
    marked = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), "toxic")
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = labelled(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), marked)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(x["text"], x["toxic"]):
                words = {EDGE.sub("", t) for t in set(text.lower().split())}
                for f in {f for w in words if w.isalpha() for f in features(w)}:
                    counts.setdefault(f, [0, 0])[int(toxic == 1)] += 1
            yield pd.DataFrame({"feature": list(counts), "neg": [c[0] for c in counts.values()], "pos": [c[1] for c in counts.values()]}, columns=["feature", "neg", "pos"]).astype({"neg": "int64", "pos": "int64"})

    counted = rows.mapInPandas(run, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).persist()
    e1, e0 = (int(x or 0) for x in counted.agg(F.sum("pos"), F.sum("neg")).first())
    evidence = _needed(rows.filter("toxic = 1"), _likely(counted, e1, e0)) if e1 and e0 else {}
    padded = F.concat(F.lit("^^"), "feature", F.lit("$"))
    words = counted.filter(~F.col("feature").endswith("-")).select(padded.alias("word"), (F.col("neg") + F.col("pos")).alias("n"))
    trigrams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 2), lambda i: F.col("word").substr(i, F.lit(3)))).alias("trigram"), "n").groupBy("trigram").agg(F.sum("n").alias("n")).collect()
    counted.unpersist()
    known = [w for w in evidence if not w.endswith("-")]
    chars = CharModel([(w, 50.0) for w in known], [(r["trigram"], float(r["n"])) for r in trigrams])
    return Model(evidence, chars)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the evidence and the trigrams

    @F.pandas_udf("double")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) for t in texts], dtype="float64")

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), compute(text_or_empty(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
