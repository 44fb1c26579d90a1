"""Text functions as Column expressions: no user functions, all inside code generation or array lambdas."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import STOP_WORDS, bordered

TOKEN = "[a-z0-9']+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often nested lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.trim(c, F.lit(" \t\n\r\x0b\x0c"))


def normalize(c: Column) -> Column:
    """Trimmed, lower case, one spelling for science fiction."""
    return F.replace(F.replace(F.replace(F.lower(strip(c)), F.lit("sci-fi"), F.lit("science fiction")), F.lit("sci fi"), F.lit("science fiction")), F.lit("scifi"), F.lit("science fiction"))


def term_list(c: Column) -> Column:
    """Tokens of the normalised text without stop words, repeats kept. Null gives no tokens."""
    return F.filter(F.regexp_extract_all(normalize(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(STOP_WORDS))


def tokens(c: Column) -> Column:
    return F.array_distinct(term_list(c))


def stem(t: Column) -> Column:
    """Light plural stripping; words of up to three letters stay. The ends of words are compared, no pattern runs."""
    n = F.char_length(t)
    two, four = F.right(t, F.lit(2)), F.right(t, F.lit(4))
    drop_es = four.isin("ches", "shes", "sses") | F.right(t, F.lit(3)).isin("xes", "zes", "oes")
    return (
        F.when((n <= 3) | ~t.endswith("s"), t)
        .when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, 1, n - 3), F.lit("y")))
        .when(drop_es & (n > 4), F.substring(t, 1, n - 2))
        .when(~two.isin("ss", "us", "is"), F.substring(t, 1, n - 1))
        .otherwise(t)
    )


def stems(c: Column) -> Column:
    """Stemmed tokens, repeats kept; what stemming turns into a stop word goes as well."""
    return F.filter(F.transform(term_list(c), stem), lambda t: ~t.isin(STOP_WORDS))


def csv_set(c: Column) -> Column:
    """Distinct trimmed lower-case items of a comma list."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def csv_head(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), 1, n), ", ")


def title_root(c: Column) -> Column:
    """Franchise root: before " - " and ":", up to a part's or chapter's number, without a last number. It may be empty."""
    base = F.substring_index(F.substring_index(normalize(F.coalesce(c, F.lit(""))), " - ", 1), ":", 1)
    named = F.trim(F.regexp_replace(base, bordered(r"(?s)\b(part|chapter|episode|vol|volume)\b.*$"), ""))
    return F.trim(F.regexp_replace(named, bordered(r"\b\d+\b$"), ""))


def mentions(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text with no letter or digit beside it."""
    safe = F.regexp_replace(phrase, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.lit("(^|[^a-z0-9])"), safe, F.lit("([^a-z0-9]|$)")))


def limited(c: Column, n: int) -> Column:
    """At most ``n`` characters, cut at a word's end if that keeps more than half of them."""
    whole = F.trim(F.coalesce(c, F.lit("")))
    head = F.rtrim(F.substring(whole, 1, n))
    kept = F.regexp_replace(head, r"(?s) [^ ]*$", "")
    return F.when((F.char_length(whole) > n) & (F.char_length(kept) > max(20, n // 2)) & (kept != head), F.rtrim(kept)).otherwise(head)


def word_cap(c: Column, n: int) -> Column:
    """Single spaces, and at most ``n`` words."""
    return F.array_join(F.slice(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""), 1, n), " ")


def strip_fence(c: Column) -> Column:
    """A model's text without the code fence around it: its first line, and the closing marks."""
    whole = strip(c)
    opened = F.regexp_replace(whole, r"(?s)^[^\n]*\n", "")
    return F.when(whole.startswith("```"), strip(F.regexp_replace(opened, r"(?s)```$", ""))).otherwise(whole)


#: Short forms whose full stop ends no sentence.
SHORT_FORMS = r"Mr|Mrs|Ms|Dr|Prof|Sr|Jr|L\.A|U\.S|U\.K"


def first_sentence(c: Column, n: int = 180, least: int = 40) -> Column:
    """The text's first ``n`` characters up to the first sentence that ends past ``least``, else cut at a word; one full stop ends it."""
    whole = F.coalesce(c, F.lit(""))
    head = F.rtrim(F.substring(whole, 1, n))
    ends = [F.regexp_extract(head, rf"(?s)^(.*?(?<!{SHORT_FORMS}){mark}) ", 1) for mark in (r"\.", "!", r"\?")]
    found = F.coalesce(*[F.when(F.char_length(e) > least + 1, e) for e in ends])
    kept = F.regexp_replace(head, r"(?s) [^ ]*$", "")
    by_word = F.when(~head.rlike(r"[.!?]$") & (F.char_length(whole) > n) & (F.char_length(kept) > max(20, n // 2)), kept).otherwise(head)
    return F.concat(F.regexp_replace(F.coalesce(found, by_word), r"[ ,.;:]+$", ""), F.lit("."))


def article(c: Column) -> Column:
    """``a`` or ``an`` by the first letter."""
    return F.when(F.lower(F.substring(c, 1, 1)).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def natural_list(items: Column) -> Column:
    n = F.size(items)
    last = F.get(items, n - 1)
    return F.when(n == 0, "").when(n == 1, last).when(n == 2, F.array_join(items, " and ")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), last))


def allowed_tags(items: Column, vocabulary: list[str], most: int) -> Column:
    """The items that a closed vocabulary holds, each once, in their own order."""
    known = F.array(*[F.lit(v) for v in vocabulary])
    return F.slice(F.array_intersect(F.transform(items, lambda x: F.lower(F.trim(x))), known), 1, most)


def clean_keywords(items: Column, most: int = 12) -> Column:
    """Lower-case keywords of at most 48 characters, each once."""
    spaced = F.transform(items, lambda x: F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), F.lit("_"), F.lit(" ")), r"\s+", " "))
    clean = F.transform(spaced, lambda x: F.regexp_replace(x, r"^[ ,.;:]+|[ ,.;:]+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: (x != "") & (F.char_length(x) <= 48))), 1, most)


def distinct_text(items: Column) -> Column:
    """Trimmed items, the first of those that differ in case alone. Order stays."""
    clean = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.filter(clean, lambda x, i: ~F.exists(F.slice(clean, 1, i), lambda y: F.lower(y) == F.lower(x)))


def json_text(c: Column) -> Column:
    """A JSON list's items joined by spaces; anything else as it is."""
    items = F.from_json(F.trim(c), "array<string>")
    whole = F.trim(F.coalesce(c, F.lit("")))
    return F.when(whole.startswith("[") & items.isNotNull(), F.array_join(items, " ", "")).otherwise(whole)


def csv_list(c: Column) -> Column:
    """The non-blank items of a comma list, trimmed, as they are written."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def checksum(c: Column, k: int) -> Column:
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)
    return F.aggregate(codes, F.lit(0), lambda a, x: a + x) % k
