"""Free-text requests to constraint columns: regular expressions and lookups, one projection."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import let, mentions, normalize, stem, stems, tokens


def _int(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("int")


def _years(text: Column) -> Column:
    """struct(min, max, label), null where no year is asked for. The order of the rules decides.

    What stands within 24 characters before the first year says which side of it is
    meant; a word such as "prefer" there turns an open end into one without the year itself.
    """
    t = normalize(text)
    of = lambda a, b, label: F.struct(a.cast("int").alias("min"), b.cast("int").alias("max"), label.alias("label"))
    fixed = lambda a, b, label: of(F.lit(a), F.lit(b), F.lit(label))
    said = lambda c: c.cast("string")
    between = V.bordered(r"\bbetween\s+((?:19|20)\d{2})\s+and\s+((?:19|20)\d{2})\b")
    a, b = _int(t, between, 1), _int(t, between, 2)
    low, high = F.least(a, b), F.greatest(a, b)
    decade, short = _int(t, V.bordered(r"\b((?:19|20)\d0)s\b"), 1), _int(t, V.bordered(r"\b(80|90)s\b"), 1) + 1900
    first = V.bordered(r"(?s)^(.*?)\b((?:19|20)\d{2})\b")
    year, before = _int(t, first, 2), F.right(F.regexp_extract(t, first, 1), F.lit(24))
    has = lambda *words: sum((F.contains(before, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    after, until = before.rlike(V.bordered(r"\b(after|post|newer than|since)\s+$")), before.rlike(V.bordered(r"\b(before|pre|older than|prior to)\s+$"))
    return (
        F.when(t.rlike(V.SET_IN) & ~t.rlike(V.RELEASE), None)
        .when(a.isNotNull(), of(low, high, F.concat(F.lit("between "), said(low), F.lit(" and "), said(high))))
        .when(decade.isNotNull(), of(decade, decade + 9, F.concat(said(decade), F.lit("s"))))
        .when(short.isNotNull(), of(short, short + 9, F.concat(said(short), F.lit("s"))))
        .when(t.rlike(V.bordered(r"\b(recent|newer|latest)\b")), fixed(V.THIS_YEAR - 5, V.THIS_YEAR, "recent"))
        .when(t.rlike(V.bordered(r"\bthis decade\b")), fixed(2020, V.THIS_YEAR, "this decade"))
        .when(t.rlike(V.bordered(r"\blast decade\b")), fixed(2010, 2019, "last decade"))
        .when(t.rlike(V.bordered(r"\b(older|classic)\b")) & t.rlike(V.bordered(r"\b(classic|old)\b")), fixed(0, 1990, "classic"))
        .when(t.rlike(V.bordered(r"\bolder\b")), fixed(0, 2010, "older"))
        .when(after, of(year + F.when(has("after", "newer than", "post"), 1).otherwise(0), F.lit(9999), F.concat(F.lit("after "), said(year))))
        .when(until, of(F.lit(0), year - F.when(has("before", "older than", "pre"), 1).otherwise(0), F.concat(F.lit("before "), said(year))))
        .when(before.rlike(V.bordered(r"\b(from|in|around)\s+(?:the\s+)?$")), of(year, year, said(year)))
    )


def year_range(text: Column) -> Column:
    """struct(min, max) of the years that a text asks for, else null."""
    y = _years(text)
    return F.when(y.isNotNull(), F.struct(y["min"].alias("min"), y["max"].alias("max")))


def year_label(text: Column) -> Column:
    """How the asked years are called."""
    return _years(text)["label"]


def year_relevant(text: Column) -> Column:
    """Whether a text speaks of a film's age in any way."""
    t = normalize(text)
    return sum((F.contains(t, F.lit(p)).cast("int") for p in V.YEAR_PHRASES), F.lit(0)) > 0


def runtime_range(text: Column) -> Column:
    """struct(min, max) in minutes; amounts in hours count times 60. Words for short and long fill the end that no number sets."""
    t = normalize(text)

    def minutes(pattern: str) -> Column:
        n, unit = F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).try_cast("double"), F.regexp_extract(t, pattern, 2)
        whole = F.bround(n * F.when(unit.startswith("h"), 60.0).otherwise(1.0), 0).cast("int")
        return F.when(whole > 0, whole)

    most, least = minutes(V.MAX_RUNTIME), minutes(V.MIN_RUNTIME)
    return F.struct(F.coalesce(least, F.when(t.rlike(V.LONG), 130)).cast("int").alias("min"), F.coalesce(most, F.when(t.rlike(V.SHORT), 110)).cast("int").alias("max"))


def refusals(text: Column) -> Column:
    """struct(plain, non, disliked): what a text refuses after no, not, without or avoid; after non; and after words of dislike."""
    found = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    clean = lambda c: F.filter(F.transform(c, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return let(normalize(text), lambda t: F.struct(clean(found(t, V.NEGATION)).alias("plain"), found(t, V.NON).alias("non"), clean(found(t, V.DISLIKES)).alias("disliked")))


def refused(text: Column) -> Column:
    """All phrases that a text refuses, up to punctuation or a turn of the sentence."""
    return let(refusals(text), _phrases_of)


def _phrases_of(off: Column) -> Column:
    return F.concat(off["plain"], off["non"], off["disliked"])


def negations(text: Column) -> Column:
    """The first six refused phrases."""
    return F.slice(refused(text), 1, 6)


def refused_tokens(text: Column) -> Column:
    """The words of all refused phrases, and ``non`` itself."""
    return let(refusals(text), _tokens_of)


def _tokens_of(off: Column) -> Column:
    non = F.when(F.size(off["non"]) > 0, F.array(F.lit("non"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(tokens(F.array_join(_phrases_of(off), " ")), non))


def blocked_genres(text: Column) -> Column:
    """Genres that a refused phrase names anywhere, or that non-... and words of dislike name alone."""
    return let(refusals(text), _blocked_of)


def _blocked_of(off: Column) -> Column:
    plain = off["plain"]
    within = F.array_join(F.concat(plain, F.transform(plain, lambda p: F.replace(p, F.lit("-"), F.lit(" ")))), " | ")
    alone = F.filter(F.concat(off["non"], off["disliked"]), lambda p: p.isin(list(V.GENRES)))
    return F.sort_array(F.array_union(_looked_up(named(within, V.GENRES), V.GENRES), _looked_up(alone, V.GENRES)))


def _mention(text: Column, term: str) -> Column:
    return text.rlike(r"(?<![a-z0-9])" + term.replace("-", r"\-") + r"(?![a-z0-9])")


def named(text: Column, terms: dict[str, object]) -> Column:
    """The terms that a text mentions with no letter or digit beside them, in their given order.

    The text is normalised once, and a pattern runs only where its term stands in the text at all.
    """
    return let(normalize(text), lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(k)) & _mention(t, k), F.lit(k)) for k in terms])))


def asked_term(text: Column, terms: dict[str, object], strict: bool = False) -> Column:
    """The one term that counts of those that a text mentions: the longest, or with ``strict`` the first of the table."""
    return counted_term(named(text, terms), strict)


def counted_term(found: Column, strict: bool = False) -> Column:
    """Of the terms that ``named`` found: the longest, or with ``strict`` the first."""
    return F.get(found, 0) if strict else longest(found)


def _looked_up(keys: Column, table: dict[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_distinct(F.transform(keys, lambda k: F.element_at(lookup, k)))


def genres(text: Column) -> Column:
    return F.sort_array(_looked_up(named(text, V.GENRES), V.GENRES))


def subgenre_keywords(text: Column) -> Column:
    """The keywords of all sub-genres that a text names."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in V.SUBGENRES.items() for x in kv])
    return F.array_distinct(F.flatten(F.transform(named(text, V.SUBGENRES), lambda k: F.element_at(table, k))))


#: Runs of words by which names are found; longer names are found by their first words.
HEAD = 3


def _words(c: Column) -> Column:
    """The pieces that no boundary splits: runs of letters and digits, and each character beyond ASCII."""
    return F.regexp_extract_all(normalize(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+|[^\\x00-\\x7f]"), F.lit(0))


def phrases(text: Column, most: int = HEAD) -> Column:
    """All runs of one to ``most`` words, in lower case: keys for equality joins with dictionaries."""

    def runs(words: Column) -> Column:
        starts = F.transform(words, lambda _, i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.array_join(F.slice(words, i + 1, n), " ")))
        return F.array_distinct(F.flatten(starts))

    return let(_words(text), runs)


#: White-space words of a passage at least, and how large a dictionary is broadcast at most.
PASSAGE = 64
SENT_NAMES, SENT_BYTES = 200_000, 32 << 20
#: Distinct first words up to which each text is told of them.
FIRSTS = 1000


def passages(text: Column, words: int) -> Column:
    """Overlapping passages that cover a normalised text: each holds two neighbouring stretches of ``words`` white-space words.

    Stretches end at white space, so a border of a passage is one of the text, and whatever
    has up to ``words`` words stands whole in one of them.
    """
    stretches = F.regexp_extract_all(text, F.lit(rf"(?:[^\s]*+\s){{1,{words}}}(?:[^\s]+$)?|[^\s]+$"), F.lit(0))
    return let(stretches, lambda s: F.when(F.size(s) < 2, s).otherwise(F.transform(F.slice(s, 1, F.size(s) - 1), lambda x, i: F.concat(x, s[i + 1]))))


def met(requests: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``request_id`` and the columns of ``dictionary`` (name, ...) of each name that a request's text mentions, each once.

    Texts are cut into overlapping passages that hold the longest name, so that the work
    grows with the text. Where a passage has the first HEAD words of a name, runs as long as the names that
    start so are compared with whole names by an equality join, and the boundary pattern verifies each that is met; names may
    be of any length and share their first words. A dictionary of proven size is broadcast, so no word that
    starts no name is shuffled; a larger one meets the runs by a shuffle, and what is found goes back to its passage. Rows of
    one name are met as one. A name without a letter, digit or character beyond ASCII is never met.
    """
    known = dictionary.withColumn("__name", normalize("name"))
    names = known.select("__name").distinct().withColumn("__words", _words(F.col("__name"))).filter("size(__words) > 0")
    names = names.select("__name", F.array_join("__words", " ").alias("__key"), F.array_join(F.slice("__words", 1, HEAD), " ").alias("__head"), F.size("__words").alias("__n"), F.get("__words", 0).alias("__first"))
    n, size, longest_name = names.agg(F.count("*"), F.sum(2 * F.octet_length("__name") + F.octet_length("__head")), F.max(F.size(F.split("__name", r"\s")))).first()
    few = n <= SENT_NAMES and (size or 0) <= SENT_BYTES
    firsts = [r[0] for r in names.select("__first").distinct().limit(FIRSTS + 1).collect()]
    cut = passages(normalize(F.coalesce("text", F.lit(""))), max(PASSAGE, longest_name or 0))
    texts = requests.select("request_id", F.posexplode(cut).alias("__at", "__text"))
    runs = texts.withColumn("__run", F.explode(_starts(F.col("__text"), firsts if len(firsts) <= FIRSTS else None))).select("*", "__run.*").drop("__run")
    heads, whole = names.groupBy("__head").agg(F.collect_set("__n").alias("__ns")), names.select("__key", "__name")
    if few:
        begun = runs.join(F.broadcast(heads), "__head")
    else:
        begun = runs.drop("__text").join(heads, "__head").join(texts, ["request_id", "__at"])
    key = F.when(F.col("__n") <= HEAD, F.col("__head")).otherwise(F.array_join(F.slice(_words(F.col("__text")), F.col("__i") + 1, F.col("__n")), " "))
    begun = begun.withColumn("__n", F.explode("__ns")).select("request_id", "__text", key.alias("__key"))
    found = begun.join(F.broadcast(whole) if few else whole, "__key").filter(mentions(F.col("__text"), F.col("__name"))).select("request_id", "__name").distinct()
    return found.join(known, "__name").drop("__name").distinct()


def _starts(text: Column, firsts: list[str] | None) -> Column:
    """struct(__i, __head) of all runs of one to HEAD words, at the positions of ``firsts`` if these are given."""

    def runs(words: Column) -> Column:
        run = lambda i, n: F.struct(i.alias("__i"), F.array_join(F.slice(words, i + 1, n), " ").alias("__head"))
        at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(firsts), i) if firsts is not None else i), lambda i: i.isNotNull())
        return F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.size(words) - i)), lambda n: run(i, n))))

    return let(_words(text), runs)


def mentioned_items(requests: DataFrame, items: DataFrame, titles: Column, least: int = 3) -> DataFrame:
    """(request_id, doc): items one of whose ``titles`` of ``least`` characters or more stands in the request's text, at any length."""
    variants = items.select("doc", F.explode(F.array_distinct(F.transform(titles, normalize))).alias("name")).filter(F.char_length("name") >= least)
    return met(requests, variants).select("request_id", "doc").distinct()


def seed_signals(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """seed_docs and their titles' tokens, genres, first ten keywords and neighbours for each request, from ``pairs`` (request_id, doc)."""
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(f"seed_{c}")
    seeds = pairs.join(items.select("doc", "title", "similar_ids", "recommended_ids", "genre_set", "keyword_set"), "doc")
    seeds = seeds.withColumns({"genres": F.col("genre_set"), "keywords": F.slice(F.sort_array("keyword_set"), 1, 10), "title_tokens": tokens(F.col("title"))})
    return seeds.groupBy("request_id").agg(F.collect_set("doc").alias("seed_docs"), *map(union, ("similar_ids", "recommended_ids", "genres", "keywords", "title_tokens")))


def vocabulary(items: DataFrame, column: str) -> DataFrame:
    """(term): the distinct items of a list column."""
    return items.select(F.explode(column).alias("term")).distinct()


#: Items of a block, which a request meets at once; tasks that the requests of one block are dealt over.
BLOCK, SHARES = 4096, 8


def resolved_history(told: DataFrame, items: DataFrame, titles: Column) -> DataFrame:
    """(request_id, doc, how): watched items by their exact title, else by any title of theirs, else by id.

    ``told`` has request_id, id and name; of each of its rows the first way that leads to an item counts.
    Items, each with an id, that have the same asked titles lie in blocks. A request's keys go with each of them, and a block's better keys with each of
    its own, so that a pair of a request and a block is decided where it is met; only then a block's items are told one by one:
    pairs of requests and items, which copies of titles may make many, aren't joined, and aren't shuffled.
    """
    key = lambda n, c: F.concat(F.lit(f"{n}:"), c.cast("string"))
    variants = F.filter(F.array_distinct(F.transform(titles, normalize)), lambda v: v != "")
    own = items.select("doc", F.array_sort(F.array_compact(F.array_distinct(F.concat(F.array(key(0, F.col("title"))), F.transform(variants, lambda v: key(1, v)))))).alias("own"), key(2, F.col("doc")).alias("number"))
    titled, numbered = own.select("doc", F.explode("own").alias("key")), own.select(F.col("doc").alias("block"), F.col("number").alias("key"), F.col("own").alias("better"))
    ways = F.array_compact(F.array(key(0, F.col("name")), F.when(normalize("name") != "", key(1, normalize("name"))), key(2, F.col("id"))))
    asked = told.select("request_id", "id", "name").distinct().withColumn("row", F.struct("id", "name")).select("request_id", "row", F.explode(ways).alias("key"))
    some = asked.join(titled.select("key").union(numbered.select("key")).distinct(), "key", "left_semi")
    first = some.groupBy("request_id", "row").agg(F.min("key").alias("key")).groupBy("request_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    each = first.select("request_id", "keys", F.explode("keys").alias("key"))

    wanted = told.select("id", "name").distinct().select(F.explode(ways).alias("key")).distinct()
    alike = titled.join(wanted, "key", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_set("key")).alias("own"))
    parts = alike.groupBy("own").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = alike.join(parts, "own").groupBy("own", F.pmod(F.xxhash64("doc"), "parts").alias("part")).agg(F.min("doc").alias("block"), F.collect_list("doc").alias("docs"))
    held = blocks.select("block", F.posexplode("own").alias("at", "key"), "own").select("block", "key", F.slice("own", 1, F.col("at")).alias("better"))
    held = held.union(numbered.join(wanted, "key", "left_semi").select("block", "key", "better"))
    way = F.substring("key", 1, 1)
    how = F.when(way == "0", "title").when(way == "1", "variant").otherwise("id").alias("how")
    # an item met by its id is no block, and has no share
    share = F.when(way != "2", F.pmod(F.xxhash64("request_id"), F.lit(SHARES).cast("bigint"))).otherwise(-1).alias("share")
    # a given number of tasks: by the size of these rows alone, too few of them would tell all items
    spark = told.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = each.join(held, "key").filter(~F.arrays_overlap("keys", "better")).select("request_id", how, "block", share).repartition(tasks, "block", "share")
    shared = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))).alias("share"), "docs")
    reached = met.join(shared, ["block", "share"], "left").select("request_id", "how", F.coalesce("docs", F.array("block")).alias("docs"))
    return reached.select("request_id", F.explode("docs").alias("doc"), "how")


def longest(keys: Column) -> Column:
    """The longest of several mentioned terms, the earlier of equals: a longer term isn't shadowed by a part of it."""
    return F.aggregate(keys, F.lit(None).cast("string"), lambda best, k: F.when(best.isNull() | (F.char_length(k) > F.char_length(best)), k).otherwise(best))


def setting_period(text: Column) -> Column:
    """The period a story shall be set in; empty if none is named."""
    t = normalize(text)
    era = F.regexp_extract(t, V.ERA, 1)
    return F.when(t.rlike(V.MODERN), "contemporary setting").when(t.rlike(V.PAST), "historical setting").when(era != "", F.concat(F.lit("set in "), era)).otherwise("")


def min_rating(text: Column) -> Column:
    """The least rating asked for, null unless above 0 and at most 10."""
    t = normalize(text)
    n = F.coalesce(*[F.nullif(F.regexp_extract(t, V.MIN_RATING, g), F.lit("")).try_cast("double") for g in (1, 2)])
    return F.when((n > 0) & (n <= 10), n)


def affinity_phrases(text: Column, most: int = 3) -> Column:
    """What a text says somebody likes, loves or is a fan of."""
    t = normalize(text)
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (V.LIKES, V.FANS)])
    clean = F.transform(found, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(clean, lambda p: p != "")), 1, most)


def named_from(requests: DataFrame, dictionary: DataFrame, most: int, least_words: int = 1, least_chars: int = 1) -> DataFrame:
    """(request_id, names): terms of ``dictionary`` (name) that a text mentions, longest first. Names have ``least_words`` tokens and ``least_chars`` characters or more."""
    known = dictionary.select(F.lower(F.trim("name")).alias("name")).distinct().filter((F.size(tokens(F.col("name"))) >= least_words) & (F.char_length("name") >= least_chars))
    found = met(requests, known).groupBy("request_id").agg(F.sort_array(F.collect_set(F.struct((-F.char_length("name")).alias("n"), "name"))).alias("found"))
    return found.select("request_id", F.slice(F.col("found.name"), 1, most).alias("names"))


def affinity_terms(requests: DataFrame, items: DataFrame, most: int = 8, first: int = 40) -> DataFrame:
    """(request_id, affinity_terms): the leading genre and keyword terms of items that contain a liked phrase.

    ``requests``: request_id, affinity_phrases, avoid_terms. ``items``: doc, blob,
    genre_set, keyword_set. Of each phrase the ``first`` items by doc count, a genre
    term three times a keyword term, of the first ten keywords. A phrase may start or
    end inside a word: the catalogue's distinct words that hold the phrase's longest word
    are found by an equality join on their runs of one to three characters, and lead to the texts and their items. Items of one
    text are met as one, of which only the ``first`` by doc can count.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z0-9']+"), F.lit(0)))
    asked = requests.select("request_id", "avoid_terms", F.explode("affinity_phrases").alias("liked")).withColumn("word", longest(words(F.col("liked"))))
    held = items.select("blob").distinct().select("blob", F.explode(words(F.col("blob"))).alias("held"))
    runs = lambda c, n: F.filter(F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: c.substr(i, F.lit(n))), lambda g: F.char_length(g) == n)
    vocabulary = held.select("held").distinct().withColumn("run", F.explode(F.array_distinct(F.concat(*[runs(F.col("held"), n) for n in (1, 2, 3)]))))
    around = asked.select("word").distinct().withColumn("run", F.substring("word", 1, 3)).join(vocabulary, "run").filter(F.contains("held", "word")).select("word", "held")
    found = asked.join(around, "word").join(held, "held").filter(F.contains("blob", "liked")).drop("word", "held").dropDuplicates(["request_id", "liked", "blob"])
    own = F.row_number().over(Window.partitionBy("blob").orderBy("doc"))
    leading = items.select("doc", "blob", "genre_set", "keyword_set").withColumn("own", own).filter(F.col("own") <= first).drop("own")
    met = found.join(leading, "blob").drop("blob").dropDuplicates(["request_id", "liked", "doc"])
    n = F.row_number().over(Window.partitionBy("request_id", "liked").orderBy("doc"))
    met = met.withColumn("n", n).filter(F.col("n") <= first)
    weighed = lambda c, w: F.transform(F.flatten(F.transform(c, lambda x: F.array_distinct(stems(x)))), lambda x: F.struct(x.alias("term"), F.lit(w).alias("w")))
    terms = F.concat(weighed(F.col("genre_set"), 3), weighed(F.slice(F.sort_array("keyword_set"), 1, 10), 1))
    counted = met.select("request_id", "avoid_terms", F.explode(terms).alias("t")).filter(~F.array_contains("avoid_terms", F.col("t.term")))
    counted = counted.groupBy("request_id", "t.term").agg(F.sum("t.w").alias("w"))
    best = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("w"), "term"))
    return counted.withColumn("n", best).filter(F.col("n") <= most).groupBy("request_id").agg(F.sort_array(F.collect_list("term")).alias("affinity_terms"))


#: What a model may add to a request; every field may be null.
OVERRIDE = (
    "struct<genres:array<string>,avoid:array<string>,people:array<string>,year:struct<min:int,max:int>,runtime:struct<min:int,max:int,short:boolean>,"
    "setting:string,tone:array<string>,hints:array<string>,quality:boolean,countries:array<string>>"
)


def merged(df: DataFrame) -> DataFrame:
    """Parsed requests with their ``override`` (of type OVERRIDE) merged in.

    Lists are joined to what the text says, at their limits (six phrases to avoid,
    four tones, five hints); valid years, runtimes, a setting and countries replace
    it; quality is wanted if either says so. Without the column all extras are empty.
    """
    empty = F.array().cast("array<string>")
    if "override" not in df.columns:
        df = df.withColumn("override", F.lit(None).cast(OVERRIDE))
    o = lambda k: F.col(f"override.{k}")
    clean = lambda k: F.coalesce(F.filter(F.transform(o(k), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), empty)
    low = lambda k: F.transform(clean(k), F.lower)
    alias = F.create_map(*[F.lit(x) for kv in V.GENRES.items() for x in kv])
    year = F.when((o("year.min") > 0) & (F.coalesce(o("year.max"), F.lit(9999)) >= o("year.min")), F.struct(o("year.min").alias("min"), F.coalesce(o("year.max"), F.lit(9999)).alias("max")))
    short = F.coalesce(o("runtime.short"), F.lit(False))
    longest_, least = F.coalesce(o("runtime.max"), F.when(short, 110)), o("runtime.min")
    runtime = F.when(longest_.isNotNull() | least.isNotNull(), F.struct(least.alias("min"), longest_.alias("max")))
    setting = F.nullif(F.substring(F.trim(F.coalesce(o("setting"), F.lit(""))), 1, 80), F.lit(""))
    avoid = F.array_distinct(F.concat("avoid_all", low("avoid")))
    said_years = F.concat(F.col("year.min").cast("string"), F.lit("-"), F.col("year.max").cast("string"))
    df = df.withColumns({"__said_year": year.isNotNull(), "year": F.coalesce(year, F.col("year"))})
    return df.withColumns(
        {
            "year_label": F.when(F.col("__said_year"), said_years).otherwise(F.col("year_label")),
            "overridden": F.col("override").isNotNull(),
            "all_genres": F.array_union("all_genres", F.transform(low("genres"), lambda g: F.coalesce(F.element_at(alias, g), g))),
            "avoid_all": avoid,
            "avoid_phrases": F.slice(avoid, 1, 6),
            "avoid_tokens": F.array_union("avoid_tokens", tokens(F.array_join(low("avoid"), " "))),
            "said_people": low("people"),
            "short_requested": F.when(runtime.isNotNull(), short).otherwise(F.col("short_requested")),
            "runtime": F.coalesce(runtime, F.col("runtime")),
            "said_setting": F.coalesce(setting, F.lit("")),
            "setting": F.coalesce(setting, F.col("setting")),
            "tone": F.slice(clean("tone"), 1, 4),
            "hints": F.slice(clean("hints"), 1, 5),
            "said_countries": F.slice(clean("countries"), 1, 3),
            "wants_quality": F.col("wants_quality") | F.coalesce(o("quality"), F.lit(False)),
        }
    ).drop("override", "__said_year")


def _table(terms: dict[str, tuple], names: tuple[str, ...]) -> Column:
    """A lookup of lists, or of structs of lists, by term."""
    lists = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    value = lambda v: F.struct(*[lists(x).alias(n) for n, x in zip(names, v)]) if names else lists(v)
    return F.create_map(*[x for k, v in terms.items() for x in (F.lit(k), value(v))])


def language(text: Column, strict: bool = False) -> Column:
    """struct(codes, countries) of the language or place that a text asks films from, else null."""
    return language_of(asked_term(text, V.LANGUAGES, strict))


def language_of(term: Column) -> Column:
    return F.element_at(_table(V.LANGUAGES, ("codes", "countries")), term)


def certificates(text: Column, strict: bool = False) -> Column:
    """The certificates that a text allows, else null."""
    return F.element_at(_table(V.CERTIFICATES, ()), asked_term(text, V.CERTIFICATES, strict))


def profile(requests: DataFrame, text_col: str = "text", strict: bool = False) -> DataFrame:
    """Requests with the constraint columns that follow from their text and ``override`` alone.

    Of several languages or certificates the longest mentioned term counts; with ``strict``
    it is the first of the table, and "pg-13" is then "pg".
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    df = requests.withColumns(
        {
            "__year": _years(text),
            "year_said": year_relevant(text),
            "runtime": runtime_range(text),
            "short_requested": normalize(text).rlike(V.SHORT),
            "min_rating": min_rating(text),
            "setting": setting_period(text),
            "__off": refusals(text),
            "affinity_phrases": affinity_phrases(text),
            "all_genres": genres(text),
            "language": language(text, strict),
            "certificates": certificates(text, strict),
            "wants_all_time": low.rlike(V.ALL_TIME),
            "similar_request": low.rlike(V.SIMILAR),
            "fuzzy": normalize(text).rlike(V.FUZZY),
            "mood": low.rlike(V.MOOD),
            "subgenre_keywords": subgenre_keywords(text),
        }
    )
    asked = F.when(F.col("__year").isNotNull(), F.struct("__year.min", "__year.max"))
    df = df.withColumns({"year": asked, "year_label": F.col("__year.label"), "fuzzy_words": F.col("fuzzy"), "wants_quality": low.rlike(V.QUALITY) | F.col("wants_all_time")}).drop("__year")
    off = F.col("__off")
    df = df.withColumns({"avoid_all": _phrases_of(off), "avoid_tokens": _tokens_of(off), "blocked_genres": _blocked_of(off)}).drop("__off")
    df = merged(df)
    return df.withColumns({"avoid_terms": F.array_distinct(stems(F.array_join("avoid_all", " "))), "genres": F.array_except("all_genres", "blocked_genres")}).drop("avoid_all")


def _some(c: str) -> Column:
    return F.size(c) > 0


def breadth(df: DataFrame) -> DataFrame:
    """specificity, broad_request and needs_backup from profile columns.

    A request for quality is broad, one by similarity or mood isn't; others are if they
    have at most one of eight signals, of which running time is none. A broad request,
    one by similarity, and one for genres alone need good items beside what is recalled.
    """
    year, runtime = F.col("year").isNotNull(), F.col("runtime.min").isNotNull() | F.col("runtime.max").isNotNull()
    shared = [_some("genres"), _some("avoid_phrases"), _some("people"), F.col("min_rating").isNotNull(), F.col("setting") != "", F.col("similar_request")]
    count = lambda xs: sum((x.cast("int") for x in xs), F.lit(0))
    n, few = count([*shared, year | F.col("year_said"), runtime]), count([*shared, year, _some("tone") | _some("hints")])
    df = df.withColumns(
        {
            "specificity": F.when(n >= 3, "high").when(n == 2, "medium").otherwise("low"),
            "broad_request": F.col("wants_quality") | (~F.col("similar_request") & ~F.col("mood") & (few <= 1)),
        }
    )
    aimed = (_some("genres") | _some("affinity_genres")) & ~_some("people") & ~year & ~runtime
    return df.withColumn("needs_backup", F.col("broad_request") | F.col("similar_request") | aimed)


def wants_dense(hits: Column) -> Column:
    """Whether a completed profile calls for dense recall, given how many ``hits`` lexical recall has; the first rule that fits decides."""
    vague = F.col("similar_request") | (F.col("setting") != "") | _some("tone") | _some("hints") | F.col("fuzzy_words")
    return F.when(vague, True).when(_some("people"), False).otherwise(hits < 8)


def completed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Profiles joined with ``people``, ``countries``, ``affinity_terms`` and seed columns: breadth, specificity, query terms and dense text.

    A request is a similarity request only if a seed was found. Query terms are the
    text's tokens without fillers, refused ones and seed titles, then the tokens of
    everything else that was understood. Without any, a request that is neither broad
    nor for quality is searched by its whole text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("similar_request", F.col("similar_request") & _some("seed_docs"))
    df = df.withColumn("affinity_genres", F.when(_some("affinity_terms"), F.filter(F.array(*[F.lit(g) for g in sorted(set(V.GENRES.values()))]), lambda g: F.arrays_overlap(stems(g), "affinity_terms"))).otherwise(F.array().cast("array<string>")))
    df = breadth(df)
    df = df.withColumn("fuzzy", F.col("fuzzy_words") | F.col("similar_request") | (F.col("setting") != "") | _some("tone") | _some("hints"))
    empty = F.array().cast("array<string>")
    listed = lambda xs: F.array(*map(F.lit, xs))
    filler = F.concat(listed(V.REQUEST_FILLERS), F.when(F.col("wants_quality"), listed(V.QUALITY_FILLERS)).when(F.col("wants_all_time"), listed(["all", "best", "greatest", "time"])).otherwise(empty))
    own = F.array_except(F.array_except(F.array_except(tokens(text), "avoid_tokens"), "seed_title_tokens"), filler)
    words = lambda c: F.flatten(F.transform(c, lambda x: F.array_distinct(stems(x))))
    seed = F.when(F.col("similar_request"), F.concat(words(F.col("seed_genres")), words(F.slice(F.sort_array("seed_keywords"), 1, 8)))).otherwise(empty)
    more = tokens(F.array_join(F.concat("genres", "countries", "subgenre_keywords", "tone", "hints", F.array("said_setting")), " "))
    every = F.array_union(own, F.array_distinct(F.concat(more, F.when(F.col("mood"), listed(V.MOOD_TERMS)).otherwise(empty), seed, "affinity_terms")))
    df = df.withColumn("query_tokens", F.sort_array(F.when(F.col("overridden"), F.array_except(every, filler)).otherwise(every)))
    spoken = F.filter(F.transform("query_tokens", stem), lambda w: ~w.isin(V.STOP_WORDS))
    whole = F.when(F.col("broad_request"), empty).otherwise(stems(text))
    said = F.when(F.trim(text) != "", F.trim(text)).otherwise(F.array_join("query_tokens", " "))
    hints = F.when(F.col("overridden"), F.concat_ws(" ", F.nullif("setting", F.lit("")), F.concat_ws(" ", "tone"), F.concat_ws(" ", "hints"), F.concat_ws(" ", "countries"))).otherwise("")
    return df.withColumns({"query_terms": F.when(_some("query_tokens"), spoken).otherwise(whole), "dense_text": F.trim(F.concat_ws(" ", said, F.nullif(F.trim(hints), F.lit(""))))})
