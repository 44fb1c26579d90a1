"""The whole retrieval plan over a table of requests: parse, recall, fuse, constrain, score, shortlist, route, choose."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions.values import DENSE_TOP, LEXICAL_TOP, POOL, SECOND_STAGE, SHORTLIST, TEXT_COLUMNS
from ..operators import answers, dense, hooks, index, lexical, matching, parsing, prompts, quality, ranking, selection
from ..sources.catalogue import ensure_columns
from ..sources.stages import scratch, written
from . import recall

#: Appended rows of each kind, and how many a request can have before they are taken: all recalled and appended ones.
APPENDED = 20
KINDS = ("person", "quality", "year", "runtime")
WIDE = LEXICAL_TOP + DENSE_TOP + APPENDED * (len(KINDS) + 1)
TEXTS = "array<string>"


def by_score() -> list[Column]:
    """The order of rows that no search found."""
    return [F.desc("score"), F.desc("consensus"), F.desc("rating"), F.desc("votes"), F.col("doc")]


def prepare(catalogue: DataFrame) -> DataFrame:
    """Typed and derived catalogue columns; ``doc`` is the item's id. Columns that lack are empty."""
    catalogue = ensure_columns(catalogue)
    votes = quality.effective(N.votes(F.col("imdb_votes")), N.votes(F.col("vote_count").cast("string")))
    rating = quality.effective(N.number(F.col("imdb_rating")), N.number(F.col("vote_average").cast("string")))
    df = catalogue.withColumns({"doc": F.col("tmdb_id").cast("long"), "rating": rating, "votes": votes})
    blob = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TEXT_COLUMNS])
    titles = F.transform(F.concat(F.array("title", "original_title"), N.json_strings(F.col("alternative_titles"))), lambda t: T.normalize(F.coalesce(t, F.lit(""))))
    df = df.withColumns(
        {
            "year_n": N.number(F.col("year").cast("string")).cast("int"),
            "runtime_n": N.number(F.col("runtime_min").cast("string")),
            "genre_set": T.csv_set(F.col("genres")),
            "keyword_set": T.csv_set(F.col("keywords")),
            "people": F.array_union(T.csv_set(F.col("top_cast")), T.csv_set(F.col("director"))),
            "places": F.array_union(T.csv_set(F.col("production_countries")), T.csv_set(F.col("spoken_languages"))),
            "similar_ids": N.json_ints(F.col("similar_tmdb_ids")),
            "recommended_ids": N.json_ints(F.col("recommended_tmdb_ids")),
            "native_rating": N.number(F.col("vote_average").cast("string")),
            "titles": F.array_distinct(F.filter(titles, lambda t: t != "")),
            "root": T.title_root(F.col("title")),
            "blob": T.normalize(blob),
            "terms": F.array_distinct(T.stems(blob)),
        }
    )
    return quality.add_quality(df, native="native_rating")


def understand(requests: DataFrame, items: DataFrame, strict: bool = False) -> DataFrame:
    """One row per request with its whole profile: text, override, and what the catalogue's own names add.

    People, places and titles are met by equality joins; ``seen`` holds the documents
    that must not come back: the history by id, title or variant, and seeds of a similarity request.
    """
    asked = written(parsing.profile(requests, strict=strict), "profile")
    people = parsing.named_from(asked, items.select(F.explode("people").alias("name")), 6, least_words=2)
    places = parsing.named_from(asked, items.select(F.explode("places").alias("name")), 3, least_chars=4)
    liked = parsing.affinity_terms(asked, items)
    told = asked.select("request_id", F.explode("history").alias("h")).select("request_id", F.col("h.id").cast("long").alias("id"), F.col("h.name").alias("name"))
    by_name = parsing.resolved_history(told, items, F.col("titles")).select("request_id", "doc")
    seen = told.select("request_id", F.col("id").alias("doc")).unionByName(by_name).filter("doc is not null")
    seen = seen.groupBy("request_id").agg(F.collect_set("doc").alias("history_docs"))

    seeds = parsing.seed_signals(parsing.mentioned_items(asked, items, F.col("titles")), items)

    for extra in (people.withColumnRenamed("names", "found_people"), places.withColumnRenamed("names", "found_places"), liked, seen, seeds):
        asked = asked.join(extra, "request_id", "left")
    lists = ("found_people", "found_places", "affinity_terms", "seed_genres", "seed_keywords", "seed_title_tokens")
    ids = ("history_docs", "seed_docs", "seed_similar_ids", "seed_recommended_ids")
    asked = asked.withColumns({c: F.coalesce(c, F.array().cast(TEXTS)) for c in lists} | {c: F.coalesce(c, F.array().cast("array<bigint>")) for c in ids})
    countries = F.when(F.size("said_countries") > 0, F.col("said_countries")).otherwise(F.col("found_places"))
    asked = asked.withColumns({"people": F.slice(F.array_union("found_people", "said_people"), 1, 6), "countries": countries})
    asked = parsing.completed(asked)
    seeds_out = F.when(F.col("similar_request"), F.col("seed_docs")).otherwise(F.array().cast("array<bigint>"))
    floor = matching.quality_floor(F.col("wants_quality"), F.col("wants_all_time"), backup=True)
    target = F.when(F.size("genres") > 0, F.col("genres")).when(F.col("similar_request") & (F.size("seed_genres") > 0), F.col("seed_genres")).otherwise(F.col("affinity_genres"))
    return asked.withColumns({"seen": F.array_union("history_docs", seeds_out), "quality_floor": floor, "target_genres": target}).drop("history", "found_people", "found_places", "said_people", "said_countries")


_RECALL = ["bm25_rank", "sem_rank", "bm25_score", "sem_score", "vote_score"]
_SAID = "similar_request broad_request needs_backup wants_quality wants_all_time short_requested fuzzy specificity min_rating".split()


def _unrecalled(pairs: DataFrame, present: bool) -> DataFrame:
    """Rows that no search found."""
    return pairs.select("request_id", "doc", F.lit(present).alias("present"), *[F.lit(None).cast("int").alias(c) if c.endswith("_rank") else F.lit(0.0).alias(c) for c in _RECALL])


#: Lists of documents that grow with the copies of a title.
_DOCS = ("seen", "history_docs", "seed_docs", "seed_similar_ids", "seed_recommended_ids")


def _relations(asked: DataFrame) -> DataFrame:
    """(request_id, doc, relation): the neighbours of requests' seeds; who is similar isn't just recommended."""
    near = lambda c, said: asked.select("request_id", F.explode(c).alias("doc"), F.lit(said).alias("relation"))
    return near("seed_similar_ids", "similar").unionByName(near("seed_recommended_ids", "recommended")).groupBy("request_id", "doc").agg(F.max("relation").alias("relation"))


def _evidence(pairs: DataFrame, asked: DataFrame, items: DataFrame) -> DataFrame:
    """Scalars about (request, item) rows: all that later steps need, so that no text or list is shuffled again.

    Rows of seen items and blocked genres go. ``pairs`` has request_id, doc, present and the recall columns.
    A request's lists of documents, as long as a title has copies, meet the pairs as rows and go with none of them.
    """
    wanted = asked.drop("query_terms", "text", "countries", *_DOCS).withColumnsRenamed({"genres": "genres_asked", "people": "people_asked"})
    pairs = ranking.without(pairs, recall.seen(asked), ["request_id", "doc"]).join(_relations(asked), ["request_id", "doc"], "left")
    rows = pairs.join(items.drop("genres", "year", "similar_ids", "recommended_ids"), "doc").join(wanted, "request_id")
    rows = rows.filter(~matching.overlaps(F.col("genre_set"), F.col("blocked_genres")))
    c, size, none, both = F.col, F.size, F.lit(0), matching.overlaps
    shared = F.coalesce(F.size(F.array_intersect("genre_set", "genres_asked")), none)
    refused = both(c("terms"), c("avoid_terms"))
    least = matching.quality_floor(c("wants_quality"), c("wants_all_time"))
    flags = {
        "wrong_language": ~matching.language_match(c("original_language"), c("production_countries"), c("language")),
        "wrong_certificate": ~matching.certificate_match(c("us_rating"), c("certificates")),
        "seed_overlap": both(c("genre_set"), c("seed_genres")) | both(c("keyword_set"), c("seed_keywords")),
        "asked_genre": shared > 0,
        "asked_person": both(c("people"), c("people_asked")),
        "asked_year": matching.year_match(c("year_n"), c("year")),
        "asked_runtime": matching.runtime_match(c("runtime_n"), c("runtime")),
        "avoid_hit": matching.avoid_hit(c("terms"), c("blob"), c("genre_set"), c("avoid_terms"), c("avoid_phrases"), c("blocked_genres")),
        "has_genres": size("genres_asked") > 0,
        "has_people": size("people_asked") > 0,
        "has_avoid": size("avoid_phrases") > 0,
        "has_year": c("year").isNotNull(),
        "has_runtime": c("runtime.min").isNotNull() | c("runtime.max").isNotNull(),
        "subgenre_request": size("subgenre_keywords") > 0,
        "good": c("needs_backup") & matching.well_rated(c("rating"), c("votes"), c("quality_floor")),
        "aimed": (size("target_genres") == 0) | both(c("genre_set"), c("target_genres")),
        "stable": matching.well_rated(c("rating"), c("votes"), least),
        "within_180": matching.known(c("runtime_n") <= 180),
        "doubtful": matching.doubtful(c("sem_score"), c("bm25_score"), shared, size("genres_asked"), refused, size("people_asked")),
    }
    relation = F.coalesce("relation", F.lit(""))
    overlap = F.coalesce(size(F.array_intersect("keyword_set", "subgenre_keywords")), none)
    return rows.select("request_id", "doc", "present", *_RECALL, *_SAID, "root", "rating", "votes", "consensus", F.lit("").alias("constraint_source"), relation.alias("seed_relation"), overlap.alias("subgenre_overlap"), *[v.alias(k) for k, v in flags.items()])


def _score(df: DataFrame) -> DataFrame:
    """``score`` from the evidence, source and recall columns."""
    c = F.col
    names = {k: c(k) for k in "wrong_language wrong_certificate bm25_rank sem_rank similar_request seed_relation seed_overlap constraint_source broad_request needs_backup subgenre_overlap subgenre_request consensus avoid_hit".split()}
    more = {"excluded": F.lit(False), "quality_request": c("wants_quality"), "genre_match": c("asked_genre"), "person_match": c("asked_person"), "year_match": c("asked_year"), "runtime_match": c("asked_runtime")}
    return df.withColumn("score", F.round(ranking.source_score(names | more), 6))


def candidates(asked: DataFrame, items: DataFrame, hits: DataFrame, near: DataFrame) -> DataFrame:
    """Scored rows of each request: recalled ones, then seeds' neighbours, people, quality, years and running times.

    Every row that could come in is in one table with its evidence, so each step is a
    change of ``present`` within a request's rows, not another read of the pool. A
    request's rows are bounded: of each kind only the best WIDE can matter, since no
    more than that can be present before.
    """
    fused = written(ranking.fuse(hits, near).select("request_id", "doc", F.lit(True).alias("present"), *_RECALL), "fused")
    wide = constraint_rows(asked, items).select("request_id", "doc")
    linked = asked.filter("similar_request").select("request_id", F.explode(F.array_union("seed_similar_ids", "seed_recommended_ids")).alias("doc"))
    rows = fused.unionByName(_unrecalled(wide.unionByName(linked), False))
    rows = rows.groupBy("request_id", "doc").agg(F.max("present").alias("present"), *[F.max(c).alias(c) for c in _RECALL]).na.fill(0.0, ["bm25_score", "sem_score", "vote_score"])
    df = written(_score(_evidence(rows, asked, items)), "evidence")

    return _score(constrained(df, by_score())).drop("narrowed")


def constraint_rows(asked: DataFrame, items: DataFrame, most: int = WIDE) -> DataFrame:
    """(request_id, doc, kind, score, ...): of each kind the best ``most`` rows that a request's people, quality, years or running time ask for.

    Seeds' neighbours come in first without a limit, so they don't count against the others.
    """

    def scored(pairs: DataFrame) -> DataFrame:
        rows = _score(_evidence(_unrecalled(pairs.select("request_id", "doc").distinct(), False), asked, items)).filter("not similar_request or seed_relation = ''")
        return pairs.join(rows.select("request_id", "doc", "score", "consensus", "rating", "votes"), ["request_id", "doc"])

    return recall.best(recall.cursors(asked, items, recall.narrowed(asked, items)), items, scored, by_score(), most)


def constrained(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows that are present after all steps, in their order: seeds' neighbours, people and quality come in; doubtful and
    badly rated rows leave; years and running times come in and narrow what is there.

    ``df`` has request_id, present, constraint_source, the recall columns, and the
    evidence of every row that could come in; ``order`` says which of those come first.
    """
    counted = Window.partitionBy("request_id")
    fit = F.count_if(F.col("good") & F.col("aimed")).over(counted) >= F.least(F.lit(5), F.count_if("good").over(counted))
    df = df.withColumns({"narrowed": fit, "year_available": F.max("asked_year").over(counted), "runtime_available": F.max("asked_runtime").over(counted)})
    df = ranking.tag_or_append(df, F.col("similar_request") & (F.col("seed_relation") != ""), "seed", order, most=None)
    df = ranking.tag_or_append(df, F.col("asked_person"), "person", order, APPENDED)
    df = ranking.tag_or_append(df, F.col("good") & (F.col("aimed") | ~F.col("narrowed")), "quality", order, APPENDED)
    df = df.withColumn("present", F.col("present") & ~F.col("doubtful"))
    df = ranking.narrow(df, F.col("stable"), 8, F.col("broad_request"))
    df = ranking.tag_or_append(df, F.col("asked_year"), "year", order, APPENDED)
    df = ranking.narrow(df, F.col("asked_year"), 1, F.col("year_available"))
    df = ranking.tag_or_append(df, F.col("asked_runtime"), "runtime", order, APPENDED)
    df = ranking.narrow(df, F.col("within_180"), 8, F.col("short_requested") & F.col("runtime_available"))
    df = ranking.narrow(df, F.col("asked_runtime"), 8, F.col("runtime_available"))
    return df.filter("present")


def fallback(asked: DataFrame, items: DataFrame, pool: DataFrame, most: int = POOL) -> DataFrame:
    """For requests that nothing was recalled for, the catalogue's best ``most`` rows join the pool; no more are looked at later."""
    lone = asked.join(pool.select("request_id").distinct(), "request_id", "left_anti")
    base = recall.told(lone).withColumns({"kind": F.lit("all"), "stem": F.lit("all:")})
    cursors = recall.marked(base).join(lone.select("request_id", F.when(F.col("similar_request"), 0.65).otherwise(0.0).alias("seeds")), "request_id").withColumn("bonus", F.when(F.col("bonus") > recall.WRONG, F.col("bonus") + F.col("seeds")).otherwise(F.col("bonus"))).drop("seeds")

    def scored(pairs: DataFrame) -> DataFrame:
        df = _evidence(_unrecalled(pairs, True), asked, items).withColumns({"year_available": F.col("asked_year"), "runtime_available": F.col("asked_runtime"), "kind": F.lit("all")})
        return _score(df)

    found = recall.best(cursors, items, scored, by_score(), most).drop("kind")
    return pool.unionByName(found)


def _prepared(catalogue: DataFrame, requests: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    items = written(prepare(catalogue), "items")
    return items, written(understand(requests, items, strict), "asked")


def _top(items: DataFrame, asked: DataFrame, vectors: DataFrame | None, embeddings: DataFrame | None, k: int) -> DataFrame:
    seen = recall.seen(asked)
    postings, stats, lengths = index.build(items, "doc", long_field="overview")
    terms = asked.select("request_id", F.explode("query_terms").alias("term")).groupBy("request_id", "term").agg(F.count("*").alias("qtf"))
    hits = written(lexical.search(terms, postings, stats, lengths, seen), "hits")
    kind = asked.schema["request_id"].dataType.simpleString()
    if vectors is None or embeddings is None:
        near = asked.sparkSession.createDataFrame([], f"request_id {kind}, doc long, sem_raw double, sem_rank int, sem_score double")
    else:
        near = written(dense.search(gated(vectors, asked, hits), embeddings, seen), "near")
    pool = written(candidates(asked, items, hits, near), "pool")
    every = fallback(asked, items, pool)
    found = lambda df, c: df.select("request_id").distinct().withColumn(c, F.lit(True))
    modes = asked.select("request_id").join(found(near, "d"), "request_id", "left").join(found(hits, "l"), "request_id", "left").join(found(pool, "p"), "request_id", "left")
    modes = modes.select("request_id", F.when(F.col("p").isNull(), "fallback").when(F.col("d"), "hybrid").when(F.col("l"), "lexical").otherwise("constraints").alias("mode"))
    order = [F.desc("score"), F.desc("vote_score"), F.desc("consensus"), F.desc("rating"), F.desc("votes"), F.col("doc")]
    first = ranking.second_stage(every, order, POOL, SECOND_STAGE)
    top = ranking.diversify(ranking.evidence(first), "root", ["request_id"], order, k)
    return top.join(items.select("doc", "title", "genre_set", "year_n", "runtime_n"), "doc").join(modes, "request_id")


def gated(vectors: DataFrame, asked: DataFrame, hits: DataFrame) -> DataFrame:
    """The vectors of requests that dense recall is for: vague ones, and those with few lexical hits and no named person."""
    n = hits.groupBy("request_id").agg(F.count("*").alias("n_hits"))
    wanted = asked.join(n, "request_id", "left").filter(parsing.wants_dense(F.coalesce("n_hits", F.lit(0))))
    return vectors.join(wanted.select("request_id"), "request_id", "left_semi")


def shortlist(catalogue: DataFrame, requests: DataFrame, vectors: DataFrame | None = None, embeddings: DataFrame | None = None, k: int = SHORTLIST, strict: bool = False) -> DataFrame:
    """Top ``k`` per request. ``requests``: request_id, text, history array<struct<id, name>>, and maybe override (parsing.OVERRIDE).

    Requests are one side of every join and partition every window by request_id,
    so many requests are one job. ``strict`` counts the first language or certificate
    of the tables instead of the longest one mentioned. The result is a written table; those of the stages before it are gone.
    """
    with scratch(catalogue.sparkSession) as keep:
        items, asked = _prepared(catalogue, requests, strict)
        return keep(written(_top(items, asked, vectors, embeddings, k), "shortlist"))


def record(top: DataFrame) -> DataFrame:
    """The shortlist as it is handed out: numbers at three decimals, ranks and votes whole, no rank as 0."""
    r = lambda c: N.rounded(F.coalesce(c, F.lit(0.0))).alias(c)
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    flags = ["genre_match", "avoid_hit", "person_match", "year_match", "runtime_match", "seed_match"]
    return top.select("request_id", "rank", "doc", "title", *map(r, ("score", "sem_score", "bm25_score", "vote_score", "rating", "consensus")), *map(whole, ("bm25_rank", "sem_rank", "votes")), "seed_relation", "constraint_source", *flags)


def enriched(top: DataFrame, items: DataFrame, asked: DataFrame) -> DataFrame:
    """Shortlist rows with the texts that prompts show; overviews of 220 characters, and years only where a request speaks of them."""
    texts = items.select("doc", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("genres", "director", "top_cast", "keywords", "production_countries")], F.substring(F.coalesce("overview", F.lit("")), 1, 220).alias("overview"))
    speaks = asked.select("request_id", (F.col("year").isNotNull() | F.col("year_said")).alias("__speaks"))
    rows = top.drop("genre_set").join(texts, "doc").join(speaks, "request_id")
    return rows.withColumn("year", F.when(F.col("__speaks"), F.col("year_n"))).drop("__speaks")


def described(best: DataFrame, items: DataFrame, asked: DataFrame) -> DataFrame:
    """``best`` (one row per request) with its deterministic description."""
    rows = enriched(best, items, asked).drop("target_genres", "wants_quality", "min_rating", "year")
    speaks = F.col("year").isNotNull() | F.col("year_said")
    opened = (F.size("genres") == 0) & (F.size("tone") == 0) & (F.size("avoid_phrases") == 0) & ~speaks & (F.col("setting") == "") & ~F.col("wants_quality") & (F.size("countries") == 0) & (F.size("hints") == 0)
    said = asked.select("request_id", F.col("genres").alias("target_genres"), "tone", "setting", "wants_quality", "min_rating", "year_label", opened.alias("open_request"))
    rows = rows.join(said, "request_id").withColumn("year_missing", F.col("has_year") & ~F.col("year_available"))
    return rows.withColumn("description", selection.describe(rows))


def notes(top: DataFrame, asked: DataFrame) -> DataFrame:
    """(request_id, note): what a prompt must own up to, where the catalogue has nothing of the asked years."""
    gone = top.filter("rank = 1 and has_year and not year_available").select("request_id")
    label = F.coalesce("year_label", F.lit("requested years"))
    return asked.join(gone, "request_id", "left_semi").select("request_id", F.concat(F.lit("The catalogue has nothing from the asked era ("), label, F.lit("). Take the closest candidate and say so briefly.")).alias("note"))


def recommend(catalogue: DataFrame, requests: DataFrame, vectors: DataFrame | None = None, embeddings: DataFrame | None = None, model: hooks.Model | None = None, intent_model: hooks.Model | None = None, strict: bool = False) -> DataFrame:
    """One item per request: request_id, doc, title, description, confidence, route, score and the reasons.

    Without a ``model`` the choice and its text are deterministic. With one, requests of
    high confidence get a description of their top row, the others a choice among five or
    eight; what a model leaves out or gets wrong falls back to the deterministic answer.
    An ``intent_model`` reads each request first and its findings are merged in. Requests may
    have a ``deadline``, in seconds since 1970: with too little time left until then a model isn't asked.
    The result is a written table; those of the stages before it are gone.
    """
    with scratch(catalogue.sparkSession) as keep:
        return keep(written(_answered(catalogue, requests, vectors, embeddings, model, intent_model, strict), "answers"))


def _answered(catalogue: DataFrame, requests: DataFrame, vectors: DataFrame | None, embeddings: DataFrame | None, model: hooks.Model | None, intent_model: hooks.Model | None, strict: bool) -> DataFrame:
    if intent_model is not None:
        genres = catalogue.select(F.explode(T.csv_list(F.col("genres"))).alias("genre")).distinct()
        found = hooks.intents(requests, genres, intent_model)
        requests = requests.drop("override").join(found, "request_id", "left")
    items, asked = _prepared(catalogue, requests, strict)
    top = written(_top(items, asked, vectors, embeddings, SHORTLIST), "top")
    gaps = ranking.score_gaps(top, ["request_id"], [F.col("rank")], "score").select("request_id", "top", F.coalesce("gap2", "top").alias("gap1"))
    routed = selection.confidence(top.filter("rank = 1").join(gaps, "request_id")).select("request_id", "confidence", "route", "convergence", "fulfilment", "specificity", "contradictions", "mode")
    safe = described(selection.choose(top, ["request_id"]), items, asked).select("request_id", "doc", "title", "description", "score").withColumn("used_llm", F.lit(False))
    if model is not None:
        handed = enriched(selection.routed(top, routed), items, asked)
        told = asked.select("request_id", "text", "setting", "people", "countries").join(notes(top, asked), "request_id", "left")
        choice = routed.filter("route <> 'description_only'").select("request_id")
        ask = prompts.selection(told.join(choice, "request_id", "left_semi"), handed).unionByName(prompts.description(told.join(choice, "request_id", "left_anti"), handed.filter("rank = 1")))
        due = hooks.with_deadline(requests).select("request_id", "deadline")
        said = written(hooks.ask(ask.join(due, "request_id"), model, hooks.CHOICE), "said")
        safe = merged_answers(said, handed, routed, safe, described(top.filter("rank = 1"), items, asked))
    return safe.join(routed, "request_id").select("request_id", "doc", "title", "description", "confidence", "route", "score", "convergence", "fulfilment", "specificity", "contradictions", "mode", "used_llm")


def merged_answers(said: DataFrame, handed: DataFrame, routed: DataFrame, safe: DataFrame, first: DataFrame) -> DataFrame:
    """Each request's answer: the model's row and text; the top row and its own text where the model named none; ``safe`` where it failed."""
    found = answers.resolve(said.filter("answer is not null"), handed).join(routed.select("request_id", "route"), "request_id")
    told = said.filter("answer is not null").select("request_id", F.trim(F.coalesce(answers.field("answer", "description"), F.lit(""))).alias("told"))
    top = first.select("request_id", F.col("doc").alias("top_doc"), F.col("description").alias("own"))
    picked = found.join(told, "request_id").join(top, "request_id")
    only = F.col("route") == "description_only"
    doc = F.when(only, F.col("top_doc")).otherwise(F.coalesce("doc", "top_doc"))
    text = F.when(only & (F.col("told") == "") | ~only & F.col("doc").isNull(), F.col("own")).otherwise(F.substring("told", 1, 500))
    picked = picked.select("request_id", doc.alias("doc"), text.alias("description")).join(handed.select("request_id", "doc", "title", "score"), ["request_id", "doc"])
    picked = picked.select("request_id", "doc", "title", "description", "score").withColumn("used_llm", F.lit(True))
    return picked.unionByName(safe.join(picked.select("request_id"), "request_id", "left_anti"))
