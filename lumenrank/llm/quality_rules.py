"""Heuristic quality rules, compiled into one projection. Native expressions only.

``MEASURES`` turns a text into named numbers, ``THRESHOLDS`` is a table of rules
(measure, least, most), and ``judge`` compiles both into columns of a single
``select``: no shuffle, no user function, and no row looks at another row.

The repeated-window count sorts the three-word windows of a text once and marks
those with an equal neighbour, so it is exact for texts of any length. Windows
with distinct hashes are distinct, so most texts skip the sort; where hashes
repeat, the windows themselves are compared.

Defined cases: a null text has no words and fails ``base_failed``; empty texts
likewise; the table may be empty; other columns are carried along by ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, text_or_empty

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages that the corpus holds.
STOP_WORDS = {
    "en": "the of and to in is that it for was with as be by on are this from or an at which",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un une du que pour dans par au sur est pas qui plus",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
}
#: (rule, measure, least, most): a document passes if least <= measure <= most; None is open.
THRESHOLDS = (
    ("too_few_words", "n_words", 50, None),
    ("too_many_words", "n_words", None, 1_000_000),
    ("word_length", "mean_word_chars", 2.0, 12.0),
    ("symbols", "symbols_per_word", None, 0.1),
    ("stop_words", "stop_word_ratio", 0.05, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.5),
    ("bullet_lines", "bullet_line_ratio", None, 0.9),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
    ("repeated_windows", "repeat_word_ratio", None, 0.5),
)
#: The rules of the contract, which reject by themselves.
BASE_RULES = ("too_few_words", "repeated_windows")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window that the text has twice or more."""

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, first, lambda acc, s: F.struct(s.alias("at"), (acc["n"] + F.least(F.lit(3), s - acc["at"])).alias("n")), lambda acc: acc["n"])

    def starts_of(ranked: Column) -> Column:
        same = lambda x, i: F.coalesce((F.get(ranked, i)["h"] == x["h"]) & (F.get(ranked, i)["w"] == x["w"]), F.lit(False))
        twice = F.filter(ranked, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    def count(ws: Column) -> Column:
        window = lambda i: (F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
        hashes = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda _, i: F.xxhash64(*window(i)))

        def exact(hs: Column) -> Column:
            ranked = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), F.concat_ws(" ", *window(i)).alias("w"), i.alias("at"))))
            return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(let(ranked, starts_of), covered))

        return let(hashes, exact)

    return let(words, count)


def measures(text: Column, stop_words=None) -> dict[str, Column]:
    """Structs of plain counts of a text; ``ratios`` divides them.

    Words and lines are each split once and bound by ``let``. Stop words match as
    written, capitalised or upper-case, so that no word has to be lower-cased.
    """
    known = sorted({form(w) for w in (stop_word_list() if stop_words is None else stop_words) for form in (str.lower, str.capitalize, str.upper)})
    n = lambda a: F.size(a).cast("long")

    def of_words(ws: Column) -> Column:
        return F.struct(
            n(ws).alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            n(F.filter(ws, lambda w: w.isin(known))).alias("n_stop_words"),
            repeated_words(ws).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            n(x).alias("n_lines"),
            (n(x) - n(F.array_distinct(x))).alias("n_dup_lines"),
            n(F.filter(x, lambda line: line.rlike(r"^\s*[-*•]\s"))).alias("n_bullet_lines"),
            n(F.filter(x, lambda line: line.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipsis_lines"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return {
        "words": let(words_of(text), of_words),
        "lines": let(lines, of_lines),
        "chars": F.struct(F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols")),
    }


def ratios(of) -> dict[str, Column]:
    """Ratios of the counts that ``of(name)`` gives."""
    per = lambda a, b: F.coalesce(F.try_divide(of(a), of(b)), F.lit(0.0))
    return {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "bullet_line_ratio": per("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
    }


def compile_rules(thresholds, value) -> Column:
    """The names of the rules that are broken, as one array expression; ``value(name)`` is a measure."""
    breaks = []
    for name, measure, least, most in thresholds:
        low = F.lit(False) if least is None else value(measure) < F.lit(least)
        high = F.lit(False) if most is None else value(measure) > F.lit(most)
        breaks.append(F.when(low | high, F.lit(name)))
    return F.array_compact(F.array(*breaks)) if breaks else F.array().cast("array<string>")


COUNTS = {
    "words": ("n_words", "word_chars", "n_stop_words", "n_repeat_words"),
    "lines": ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines"),
    "chars": ("n_symbols",),
}


def verdict(text: Column, thresholds=THRESHOLDS) -> Column:
    """A struct of counts, ratios, base_failed, broken_rules and kept, each measured once however it is used."""
    groups = measures(text)

    def rate(m: Column) -> Column:
        counts = {n: m[g][n] for g, names in COUNTS.items() for n in names}
        return F.struct(*[c.alias(n) for n, c in counts.items()], *[c.alias(n) for n, c in ratios(counts.__getitem__).items()])

    def rule(r: Column) -> Column:
        base = (r["n_words"] < 50) | (100 * r["n_repeat_words"] > 50 * r["n_words"])
        broken = compile_rules(thresholds, lambda n: r[n])
        names = [n for ns in COUNTS.values() for n in ns] + list(ratios(F.col))
        return F.struct(*[r[n].alias(n) for n in names], base.alias("base_failed"), broken.alias("broken_rules"), (~base & (F.size(broken) == 0)).alias("kept"))

    return let(let(F.struct(*[c.alias(k) for k, c in groups.items()]), rate), rule)


def stop_word_list() -> list[str]:
    return sorted({w for words in STOP_WORDS.values() for w in words.split()})


def judge(docs: DataFrame, thresholds=THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, counts, ratios, broken rules and the verdict."""
    return docs.select(F.col(id_col).alias("doc_id"), verdict(text_or_empty(text_col), thresholds).alias("v")).select("doc_id", "v.*")


def keep(docs: DataFrame, thresholds=THRESHOLDS, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns: a filter over the scan, whose condition is one expression."""
    return docs.filter(verdict(text_or_empty(text_col), thresholds)["kept"])
