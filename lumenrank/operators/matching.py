"""Whether an item meets what a request asks: predicates as Column expressions, false where the item's value is unknown."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import normalize

NONE = "array<string>"


def known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def year_match(year: Column, span: Column) -> Column:
    """Whether a year lies in struct(min, max), ends included."""
    return known(year.between(span["min"], span["max"]))


def runtime_match(minutes: Column, span: Column) -> Column:
    """Whether minutes lie in struct(min, max) of which at least one end is set."""
    some = span["min"].isNotNull() | span["max"].isNotNull()
    return known(some & (minutes >= F.coalesce(span["min"], F.lit(0))) & (minutes <= F.coalesce(span["max"], F.lit(10**6))))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two lists share an item."""
    return known(F.arrays_overlap(a, b))


def avoid_hit(terms: Column, blob: Column, genres: Column, avoid_terms: Column, avoid_phrases: Column, blocked: Column) -> Column:
    """Whether a refused term is among an item's terms, a refused phrase stands in its text, or a refused genre is its own."""
    return overlaps(terms, avoid_terms) | known(F.exists(avoid_phrases, lambda p: F.contains(blob, p))) | overlaps(genres, blocked)


def language_match(language: Column, countries: Column, asked: Column) -> Column:
    """Whether an item's language is among the codes, or, where there are none, a country stands among its own. No language asked, or an empty one, is met by all."""
    codes, places = asked["codes"], asked["countries"]
    where = normalize(F.coalesce(countries, F.lit("")))
    spoken = F.array_contains(codes, normalize(F.coalesce(language, F.lit(""))))
    placed = (F.size(codes) == 0) & F.exists(places, lambda x: F.contains(where, x))
    return asked.isNull() | ((F.size(codes) == 0) & (F.size(places) == 0)) | known(spoken) | known(placed)


def certificate_match(certificate: Column, allowed: Column) -> Column:
    """Whether an item's certificate is allowed; unrated ones never are. No certificate asked is met by all."""
    own = normalize(F.coalesce(certificate, F.lit("")))
    return allowed.isNull() | (~own.isin("", "nr") & known(F.array_contains(allowed, own)))


def eligible(doc: Column, seen: Column, genres: Column, blocked: Column) -> Column:
    """Whether an item may come at all: not seen, and of no refused genre."""
    return ~known(F.array_contains(seen, doc)) & ~overlaps(genres, blocked)


def doubtful(dense: Column, lexical: Column, shared_genres: Column, asked_genres: Column, refused: Column, people: Column) -> Column:
    """Whether a row that dense recall alone found isn't trusted.

    It is with one shared genre of one asked, or two of several, no refused term, and
    a score of 0.72 where a person is named. Counts are numbers of genres and people.
    """
    alone = (dense > 0) & (lexical <= 0)
    trusted = ((asked_genres == 0) | (shared_genres >= F.least(F.lit(2), asked_genres))) & ~refused & ((people == 0) | (dense >= 0.72))
    return known(alone) & ~known(trusted)


def quality_floor(wants_quality: Column, all_time: Column, backup: bool = False) -> Column:
    """The least rating: 8.0 of all time, 7.4 for quality, else 6.5, or 7.2 for rows that back up a request."""
    if backup:
        return F.when(all_time, 8.0).when(wants_quality, 7.4).otherwise(7.2)
    return F.when(wants_quality, F.when(all_time, 8.0).otherwise(7.4)).otherwise(6.5)


def well_rated(rating: Column, votes: Column, floor: Column, least_votes: int = 1000) -> Column:
    return known((rating >= floor) & (votes >= least_votes))
