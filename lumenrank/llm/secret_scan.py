"""Secret scans: base patterns, and a likelihood ratio of two character Markov models.

Base. Three patterns find assignments, access keys and hex runs, leftmost and
non-overlapping for each kind; matches that are too short are dropped.

Method. Two order-1 character Markov models with add-``SMOOTH`` transitions are
trained from labelled strings: random ones (label 1) and ordinary identifiers and
words (label 0). A long run of key characters that overlaps no base span becomes
a further span of kind ``random`` if the log-likelihood ratio of the two models
reaches ``LEAST_RATIO`` in all and ``LEAST_MEAN`` a character.

``training_samples`` gives the labelled strings: seeded random strings over the
alphabets that keys use, fixed identifiers, and the words of ``SAMPLE_DOCS``
documents (those with the least hash of their id), without any that the base
patterns find. That sample is the only thing learned from the corpus, and its
bound is a parameter. Scanning is one pass without a shuffle.

Defined cases: a null text is empty; an empty text has no spans and the digest of
the empty string; repeated rows give repeated results; a corpus without usable
words trains on the fixed identifiers alone; offsets are code points.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty

#: Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal either way, so short ones need no match of their own
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_=-]{16,}(?![\w+/=-])")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SMOOTH = 0.5
LEAST_RATIO = 12.0
LEAST_MEAN = 0.6
SAMPLE_DOCS = 1000
SAMPLE_WORDS = 50_000

IDENTIFIERS = (
    "get_user_profile getUserProfile DATABASE_CONNECTION_URL max_connection_retries createdAtTimestamp is_authenticated "
    "application/json content-security-policy x-forwarded-for internationalization user_interface_controller "
    "HTTP_STATUS_NOT_FOUND parseConfigurationFile test_integration_suite http/path/to/resource/index "
    "left-aligned-container abstractSingletonProxyFactory environment_variable_name src/main/java/org/module"
).split()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order of start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_rank)


def _rank(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


class MarkovRatio:
    """Log-likelihood ratio, random to ordinary, of a string's characters given the ones before."""

    def __init__(self, labelled: Iterable[tuple[str, int]], smooth: float = SMOOTH):
        size = len(ALPHABET) + 2  # any other character, and the start
        self.code = {c: i for i, c in enumerate(ALPHABET)}
        counts = [[[smooth] * size for _ in range(size)] for _ in range(2)]
        for text, label in labelled:
            for a, b in self._steps(text):
                counts[label][a][b] += 1
        logs = [[[math.log(x / sum(row)) for x in row] for row in table] for table in counts]
        self.ratio = [[p - q for p, q in zip(rows, other)] for rows, other in zip(logs[1], logs[0])]

    def _steps(self, text: str) -> Iterator[tuple[int, int]]:
        other = len(ALPHABET)
        before = other + 1
        for c in text:
            now = self.code.get(c, other)
            yield before, now
            before = now

    def score(self, text: str) -> float:
        return sum(self.ratio[a][b] for a, b in self._steps(text))

    def is_random(self, text: str) -> bool:
        score = self.score(text)
        return score >= LEAST_RATIO and score >= LEAST_MEAN * len(text)


def random_samples(n: int = 4000, seed: int = 7) -> list[str]:
    """Strings as key generators make them: hexadecimal, base 32, base 62 and base 64, 16 to 44 characters."""
    rng = random.Random(seed)
    kinds = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[:26] + "234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "-_")
    return ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(16, 44))) for i in range(n)]


def training_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Labelled strings; what is read from the corpus is at most SAMPLE_WORDS words of ``sample_docs`` documents."""
    order = F.xxhash64(F.col(id_col))
    ids = [r[0] for r in docs.filter(F.col(id_col).isNotNull()).select(id_col).orderBy(order, id_col).limit(sample_docs).collect()]
    words = docs.filter(F.col(id_col).isin(ids)).select(F.explode(F.split(text_or_empty(text_col), r"[^A-Za-z0-9+/_=-]+")).alias("w"))
    plain = [r[0] for r in words.filter("length(w) between 3 and 60").groupBy("w").count().orderBy(F.desc("count"), "w").limit(SAMPLE_WORDS).collect()]
    ordinary = [w for w in plain if not base_spans(w) and not re.fullmatch(r"AKIA\w+|\d+", w)]
    digit_heavy = [w for w in ordinary if sum(c.isdigit() for c in w) > 4]
    ordinary = [w for w in ordinary if w not in set(digit_heavy)] + IDENTIFIERS * 5
    return [(w, 0) for w in ordinary] + [(w, 1) for w in random_samples()]


def spans_of(text: str, model: MarkovRatio) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b, _ in base) and model.is_random(m[0]):
            more.append((m.start(), m.end(), "random"))
    return base, sorted(base + more, key=_rank) if more else base


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, model: MarkovRatio | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts by kind, base_spans and spans (array of start, end, kind)."""
    ship(docs.sparkSession)
    model = model or MarkovRatio(training_samples(docs, id_col=id_col, text_col=text_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of 69 x 69 numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            found = [spans_of(t, sent.value) for t in x["text"]]
            kinds = [[s[2] for s in every] for _, every in found]
            yield pd.DataFrame(
                {"doc_id": x["doc_id"]}
                | {f"n_{k}": [ks.count(k) for ks in kinds] for k in KINDS}
                | {"base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], "spans": [_joined(s) for _, s in found]}
            )

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redact(text: str, model: MarkovRatio, mark: str = "<SECRET>") -> str:
    """The text with every span replaced by ``mark``; overlapping spans become one."""
    out, at = [], 0
    for a, b, _ in spans_of(text, model)[1]:
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])
