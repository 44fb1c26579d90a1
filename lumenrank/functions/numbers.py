"""Numbers, JSON lists and vectors as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A number without thousands commas; null if it isn't one."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")


def votes(c: Column) -> Column:
    """A count that may end in k or m."""
    low = F.lower(F.trim(c))
    head = F.regexp_replace(low, "[km]$", "")
    return number(head) * F.when(low.endswith("k"), 1e3).when(low.endswith("m"), 1e6).otherwise(1.0)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def json_ints(c: Column) -> Column:
    """The whole numbers of a JSON list; fractions are cut off, bad items go, anything else is empty."""
    items = F.from_json(c, "array<string>")
    whole = lambda x: F.when(x.rlike(r"^\s*-?\d+\s*$"), x.try_cast("bigint")).otherwise(F.signum(x.try_cast("double")).cast("bigint") * F.floor(F.abs(x.try_cast("double"))))
    cast = F.transform(items, whole)
    return F.coalesce(F.array_distinct(F.filter(cast, lambda x: x.isNotNull())), F.array().cast("array<bigint>"))


def json_strings(c: Column) -> Column:
    """The distinct strings of a JSON list; text that is no JSON splits at commas, in lower case."""
    items = F.from_json(c, "array<string>")
    split = F.transform(F.split(F.coalesce(c, F.lit("")), ","), F.lower)
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, split), lambda x: F.trim(x)), lambda x: x != ""))


def rounded(c: Column, digits: int = 3) -> Column:
    """A number of a record: half goes to the even digit."""
    return F.bround(c.cast("double"), digits)


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(_double(v), lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n == 0, 1.0).otherwise(n)
