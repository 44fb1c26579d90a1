"""Offline enrichment of a catalogue: metadata objects, model-made tags, and embeddings, each resumable by a status column."""

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.json_object import extract_object
from ..sources import catalogue, commits, vectors
from ..sources.package import ship
from ..sources.stages import written
from . import hooks, quality

#: Version of metadata that counts as current, and how much of each list is kept.
VERSION, SIMILAR, RECOMMENDED, TITLES = "v2", 8, 8, 12
STATUS = "tmdb_enrichment_status"
METADATA = "collection_id collection_name similar_tmdb_ids similar_titles recommended_tmdb_ids recommended_titles alternative_titles spoken_languages us_rating".split()
TAG_STATUS, TAG_MODEL, TAG_ERROR = "llm_augmentation_status", "llm_augmentation_model", "llm_augmentation_error"
IMDB = ["imdb_rating", "imdb_votes", "imdb_source", "updated_at"]

_ITEM = "struct<id:string,title:string,original_title:string>"
DETAIL = (
    f"belongs_to_collection struct<id:string,name:string>, similar struct<results:array<{_ITEM}>>, recommendations struct<results:array<{_ITEM}>>, "
    "alternative_titles struct<titles:array<struct<title:string>>>, spoken_languages array<struct<english_name:string,name:string>>, "
    "release_dates struct<results:array<struct<iso_3166_1:string,release_dates:array<struct<certification:string>>>>>"
)


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def certification(detail: Column) -> Column:
    """The first non-blank certificate of the United States in a parsed detail, else empty."""
    here = F.filter(detail["release_dates"]["results"], lambda r: F.upper(_blank(r["iso_3166_1"])) == "US")
    all_ = F.flatten(F.transform(here, lambda r: F.coalesce(r["release_dates"], F.array().cast("array<struct<certification:string>>"))))
    marks = F.filter(F.transform(all_, lambda x: F.trim(_blank(x["certification"]))), lambda x: x != "")
    return F.coalesce(F.get(marks, 0), F.lit(""))


def flat_metadata(detail: Column) -> dict[str, Column]:
    """The catalogue columns that a metadata object (JSON text) gives: ids and titles as JSON lists, languages by commas."""
    d = F.from_json(detail, DETAIL)
    none = F.array().cast("array<string>")
    items = lambda c, n: F.slice(F.coalesce(c, F.array().cast(f"array<{_ITEM}>")), 1, n)
    ids = lambda c: F.filter(F.transform(c, lambda x: x["id"].try_cast("double").cast("bigint")), lambda i: i.isNotNull())
    said = lambda c: F.filter(c, lambda t: F.coalesce(t, F.lit("")) != "")
    near, advised = items(d["similar"]["results"], SIMILAR), items(d["recommendations"]["results"], RECOMMENDED)
    others = F.slice(F.coalesce(d["alternative_titles"]["titles"], F.array().cast("array<struct<title:string>>")), 1, TITLES)
    spoken = F.transform(d["spoken_languages"], lambda x: F.coalesce(F.nullif(x["english_name"], F.lit("")), x["name"]))
    return {
        "collection_id": _blank(d["belongs_to_collection"]["id"]),
        "collection_name": _blank(d["belongs_to_collection"]["name"]),
        "similar_tmdb_ids": F.to_json(ids(near)),
        "similar_titles": F.to_json(said(F.transform(near, lambda x: x["title"]))),
        "recommended_tmdb_ids": F.to_json(ids(advised)),
        "recommended_titles": F.to_json(said(F.transform(advised, lambda x: F.coalesce(F.nullif(x["title"], F.lit("")), x["original_title"])))),
        "alternative_titles": F.to_json(T.distinct_text(F.transform(others, lambda x: x["title"]))),
        "spoken_languages": F.array_join(T.distinct_text(F.coalesce(spoken, none)), ", "),
        "us_rating": certification(d),
    }


def needs_metadata(status: Column) -> Column:
    """Whether a row's status isn't the current version."""
    return F.trim(_blank(status)) != VERSION


def merge_metadata(rows: DataFrame, details: DataFrame, key: str = "tmdb_id") -> DataFrame:
    """``rows`` with the fields of ``details`` (key, detail as JSON text; keys once) and the current status.

    A certificate that a row has already stays; all other fields are replaced. Rows
    without a detail, or with one that isn't an object, stay as they are.
    """
    rows = catalogue.ensure_columns(rows, [*METADATA, STATUS])
    found = details.filter(F.trim("detail").startswith("{")).select(F.col(key), *[v.alias(f"__{c}") for c, v in flat_metadata(F.col("detail")).items()], F.lit(True).alias("__found"))
    met = rows.join(found, key, "left")
    has = F.coalesce("__found", F.lit(False))
    new = {c: F.when(has & ((F.trim(_blank(F.col(c))) == "") if c == "us_rating" else F.lit(True)), F.col(f"__{c}")).otherwise(_blank(F.col(c))) for c in METADATA}
    return met.withColumns(new | {STATUS: F.when(has, VERSION).otherwise(_blank(F.col(STATUS)))}).select(*rows.columns)


def enrich_metadata(rows: DataFrame, fetch: Callable[[list], dict], key: str = "tmdb_id", top_n: int | None = None) -> DataFrame:
    """Rows of the scope that aren't current are fetched, a batch at a time, and merged. ``fetch``: keys to objects by key; what it lacks is tried by the next run."""
    rows = catalogue.ensure_columns(rows, [*METADATA, STATUS])
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            got = fetch(list(x[key]))
            yield pd.DataFrame({key: list(got), "detail": [json.dumps(v) for v in got.values()]}, columns=[key, "detail"])

    stale = catalogue.first_rows(rows, [key], top_n).filter(needs_metadata(F.col(STATUS))).select(key).distinct()
    return merge_metadata(rows, written(stale.mapInPandas(run, f"{key} {kind}, detail string"), "details"), key)


def metadata_status(rows: DataFrame, top_n: int | None = None, key: str = "tmdb_id", by: list[str] | None = None) -> DataFrame:
    """rows_in_scope, rows_current and rows_needing_enrichment, in all or by group."""
    scope = catalogue.first_rows(catalogue.ensure_columns(rows, [STATUS]), [key], top_n)
    needs = needs_metadata(F.col(STATUS))
    return scope.groupBy(*(by or [])).agg(F.count("*").alias("rows_in_scope"), F.count_if(~needs).alias("rows_current"), F.count_if(needs).alias("rows_needing_enrichment"))


# ---- tags that a model makes


def sparse_keywords(keywords: Column) -> Column:
    """Whether an item has fewer than three keywords."""
    return F.size(T.csv_list(keywords)) < 3


def fields_to_generate(force: bool = False) -> Column:
    """The fields that a row still lacks, in their order; extra keywords only where there are few. ``force``: all fields that apply."""
    lacks = lambda f: F.lit(True) if force else F.trim(_blank(F.col(f))) == ""
    applies = {f: sparse_keywords(F.col("keywords")) if f == "keywords_augmented_json" else F.lit(True) for f in V.AUGMENTED}
    return F.array_compact(F.array(*[F.when(applies[f] & lacks(f), F.lit(f)) for f in V.AUGMENTED]))


def tag_status(rows: DataFrame, force: bool = False, by: list[str] | None = None) -> DataFrame:
    """rows_in_scope, rows_complete, rows_needing_llm and rows_error, in all or by group."""
    rows = catalogue.ensure_columns(rows, [*V.AUGMENTED, "keywords", TAG_STATUS])
    needs = F.size(fields_to_generate(force)) > 0
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("rows_in_scope"), F.count_if(~needs).alias("rows_complete"), F.count_if(needs).alias("rows_needing_llm"), F.count_if(F.trim(_blank(F.col(TAG_STATUS))) == "error").alias("rows_error")
    )


def context(rows: DataFrame) -> dict[str, Column]:
    """What a prompt tells of an item: short texts whole, the overview and tagline cut at a word, six recommended titles."""
    rows_ = set(rows.columns)
    text = lambda c: F.trim(_blank(F.col(c))) if c in rows_ else F.lit("")
    titles = F.coalesce(F.from_json(text("recommended_titles"), "array<string>"), T.csv_list(text("recommended_titles")))
    titles = F.filter(F.transform(titles, lambda t: F.trim(_blank(t))), lambda t: t != "")
    names = "title year genres overview tagline keywords director top_cast us_rating runtime_min recommended_titles collection_name production_countries spoken_languages".split()
    special = {"overview": T.limited(text("overview"), 900), "tagline": T.limited(text("tagline"), 220), "recommended_titles": F.array_join(F.slice(titles, 1, 6), ", ")}
    return {c: special.get(c, text(c)) for c in names}


def tag_prompt(rows: DataFrame, fields: Column) -> Column:
    """Asks for the fields that a row lacks, as JSON, within the closed vocabularies."""
    wants = lambda f: F.array_contains(fields, f)
    rules = [F.when(wants("essence"), F.lit("essence: 90 to 140 words on how the film feels, its pace and whom it suits; no plot, no spoilers."))]
    for f, (vocabulary, most) in V.TAGS.items():
        rules.append(F.when(wants(f), F.lit(f"{f}: at most {most} of {', '.join(vocabulary)}.")))
    rules.append(F.when(wants("keywords_augmented_json"), F.lit("keywords_augmented_json: 8 to 12 short thematic keywords.")))
    told = [F.concat(F.lit(f"{c}: "), v) for c, v in context(rows).items()]
    return F.concat_ws("\n", F.lit("Describe this film for a catalogue, from the facts below alone. Answer with one JSON object."), *told, F.concat(F.lit("Fields: "), F.array_join(fields, ", ")), *rules)


def normalised_tags(answer: Column, fields: Column) -> dict[str, Column]:
    """A model's answer as catalogue values, null where a field wasn't asked for; an essence of at most 170 words."""
    o = extract_object(answer)
    get = lambda f: F.get_json_object(o, f"$.{f}")
    listed = lambda f: F.coalesce(F.when(get(f).startswith("["), F.from_json(get(f), "array<string>")), F.array().cast("array<string>"))
    made = {"essence": T.word_cap(_blank(get("essence")), 170), "keywords_augmented_json": F.to_json(T.clean_keywords(listed("keywords_augmented_json")))}
    made |= {f: F.to_json(T.allowed_tags(listed(f), vocabulary, most)) for f, (vocabulary, most) in V.TAGS.items()}
    return {f: F.when(o.isNotNull() & F.array_contains(fields, f), made[f]) for f in V.AUGMENTED}


def augment(rows: DataFrame, model: hooks.Model, model_name: str, key: str = "tmdb_id", top_n: int | None = None, batch: int = 10, force: bool = False) -> DataFrame:
    """Rows with the tags that they lacked. Status is ok, or error with its first 500 characters; rows that lack nothing become ok without a call.

    Answers are written before they are merged, so a lost executor or a second run asks for the rest alone.
    """
    rows = catalogue.ensure_columns(rows, [*V.AUGMENTED, "keywords", TAG_STATUS, TAG_MODEL, TAG_ERROR])
    scope = catalogue.first_rows(rows, [key], top_n).select(key).distinct()
    todo = rows.join(scope, key, "left_semi").withColumn("__fields", fields_to_generate(force))
    asks = todo.filter(F.size("__fields") > 0)
    said = written(hooks.ask(asks.select(F.col(key).alias("request_id"), tag_prompt(asks, F.col("__fields")).alias("prompt")), model, {}, batch), "tags")
    got = said.join(asks.select(F.col(key).alias("request_id"), "__fields"), "request_id")
    got = got.select(F.col("request_id").alias(key), "error", "__fields", *[v.alias(f"__{f}") for f, v in normalised_tags(F.col("answer"), F.col("__fields")).items()])
    empty = F.array_contains("__fields", "essence") & (F.coalesce("__essence", F.lit("")) == "")
    unread = F.coalesce(*[F.col(f"__{f}") for f in V.AUGMENTED]).isNull()
    got = got.withColumn("__bad", F.coalesce("error", F.when(unread, F.lit("the answer holds no object")).when(empty, F.lit("essence is empty")))).drop("error", "__fields")
    done = todo.filter(F.size("__fields") == 0).select(key, F.lit(True).alias("__done"))
    met = rows.join(got.withColumn("__asked", F.lit(True)), key, "left").join(done, key, "left")
    ok = F.col("__asked").isNotNull() & F.col("__bad").isNull()
    fine, failed = ok | F.col("__done").isNotNull(), F.col("__asked").isNotNull() & F.col("__bad").isNotNull()
    new = {f: F.when(ok, F.coalesce(F.col(f"__{f}"), _blank(F.col(f)))).otherwise(_blank(F.col(f))) for f in V.AUGMENTED}
    new |= {
        TAG_STATUS: F.when(fine, "ok").when(failed, "error").otherwise(_blank(F.col(TAG_STATUS))),
        TAG_MODEL: F.when(fine, model_name).otherwise(_blank(F.col(TAG_MODEL))),
        TAG_ERROR: F.when(fine, "").when(failed, F.substring("__bad", 1, 500)).otherwise(_blank(F.col(TAG_ERROR))),
    }
    return met.withColumns(new).select(*rows.columns)


def augment_in_parts(rows: DataFrame, model: hooks.Model, model_name: str, path: str, key: str = "tmdb_id", size: int = 500, told: Callable[[str], None] | None = None, **more) -> DataFrame:
    """``augment`` part by part, ``size`` rows in the order of ``key`` each: every part is committed under ``path`` once its answers are there.

    A job that is killed goes on with the first part that lacks. ``told`` hears the name of each part when it is saved.
    """
    spark = rows.sparkSession
    rows = catalogue.ensure_columns(rows, [*V.AUGMENTED, "keywords", TAG_STATUS, TAG_MODEL, TAG_ERROR])
    parts = written(catalogue.chunked(rows, [key], size), "chunks")
    n = (parts.agg(F.max("chunk")).first()[0] or 0) + 1
    commits.resume(spark, path, (f"{i:08d}" for i in range(n)), lambda name: augment(parts.filter(F.col("chunk") == int(name)).drop("chunk"), model, model_name, key, **more), told)
    return commits.read_parts(spark, path, rows.schema)


# ---- embeddings

EMBEDDED = (("Genres", "genres"), ("Keywords", "keywords"), ("Tone", "tone_tags_json"), ("Audience", "audience_tags_json"), ("Country", "production_countries"), ("Language", "spoken_languages"), ("Overview", "overview"), ("Tagline", "tagline"))


def list_text(c: Column) -> Column:
    """A JSON list, or a comma list, as text with commas; items that differ in case alone once."""
    items = F.from_json(F.trim(c), "array<string>")
    return F.array_join(T.distinct_text(F.coalesce(items, T.csv_list(c))), ", ")


def embedding_text(rows: DataFrame, fields=EMBEDDED, title: str = "title") -> Column:
    """``Label: value`` lines of the fields that an item has, else its title. Columns that lack are blank."""
    value = lambda c: list_text(F.col(c)) if c.endswith("_json") else F.trim(_blank(F.col(c)))
    lines = [F.when(value(c) != "", F.concat(F.lit(f"{label}: "), value(c))) for label, c in fields if c in rows.columns]
    joined = F.concat_ws("\n", *lines) if lines else F.lit("")
    return F.when(joined != "", joined).otherwise(F.trim(_blank(F.col(title))))


def build_embeddings(rows: DataFrame, path: str, encoder: hooks.Encoder, dim: int, source: str | None = None, model: str = vectors.MODEL, batch: int = hooks.BATCH, key: str = "tmdb_id") -> None:
    """Vectors of all items at ``path``, with the source's fingerprint and the model in their metadata."""
    texts = rows.select(F.col(key).cast("long").alias("doc"), embedding_text(rows).alias("text"))
    meta = {"dim": dim, "model": model}
    if source:
        meta |= catalogue.fingerprint(rows.sparkSession, source).first().asDict()
    vectors.write_vectors(hooks.encode(texts, "doc", "text", encoder, dim, batch), path, meta)


def prepare_runtime(spark: SparkSession, rows: DataFrame, fetch: Callable | None = None, ratings: DataFrame | None = None, model: hooks.Model | None = None, model_name: str = "", refresh_metadata: bool = False, refresh_tags: bool = False) -> tuple[DataFrame, list[str]]:
    """All enrichment that isn't current yet, in order: metadata, ratings, tags. The rows, and what was done; a second run does nothing."""
    done = []
    if fetch is not None:
        rows = catalogue.ensure_columns(rows, [*METADATA, STATUS])
        if refresh_metadata:
            rows = rows.withColumn(STATUS, F.lit(""))
        if refresh_metadata or metadata_status(rows).first()["rows_needing_enrichment"]:
            rows = written(enrich_metadata(rows, fetch), "enriched")
            done.append("metadata")
    if ratings is not None:
        rows = catalogue.ensure_columns(rows, ["imdb_id", *IMDB])
        rows = rows.withColumn("tmdb_id", F.trim(F.col("tmdb_id").cast("string")))
        overlay = quality.overlay_of(rows, ratings)
        if quality.overlay_status(rows, overlay, "tmdb_id", IMDB).first()["needing"]:
            rows = written(quality.apply_overlay(rows, overlay, "tmdb_id", IMDB).drop("changed"), "rated")
            done.append("ratings")
    if model is not None and (refresh_tags or tag_status(rows).first()["rows_needing_llm"]):
        rows = written(augment(rows, model, model_name, force=refresh_tags), "tagged")
        done.append("tags")
    return rows, done
