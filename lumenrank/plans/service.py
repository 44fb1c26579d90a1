"""Requests and answers as they cross a border: payloads in, contract-checked answers out, and the evaluation of whole prompt tables."""

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import BUDGET, ROUTES
from ..operators import evaluation, hooks, selection
from ..sources import catalogue as C
from ..sources.stages import written
from .recommend import recommend

HISTORY = "array<struct<id:bigint,name:string>>"


def whole_number(text: Column) -> Column:
    """A JSON scalar's whole number, as far as it is one."""
    return F.when(text.rlike(r"^\s*-?\d+\s*$"), text.try_cast("bigint")).otherwise(F.signum(text.try_cast("double")).cast("bigint") * F.floor(F.abs(text.try_cast("double"))).cast("bigint"))


def history_items(items: Column) -> Column:
    """array<struct<id, name>> of items that are titles or objects with tmdb_id and name (as JSON text): each once, those with an id first, by id and name."""
    is_object = lambda x: F.trim(x).startswith("{")
    one = lambda x: F.struct(
        F.when(is_object(x), whole_number(F.get_json_object(x, "$.tmdb_id"))).alias("id"),
        F.when(is_object(x), F.coalesce(F.get_json_object(x, "$.name"), F.lit(""))).otherwise(x).alias("name"),
    )
    read = F.transform(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull()), one)
    kept = F.array_distinct(F.filter(read, lambda h: h["id"].isNotNull() | (h["name"] != "")))
    keyed = F.sort_array(F.transform(kept, lambda h: F.struct(h["id"].isNull().alias("last"), h["id"].alias("id"), h["name"].alias("name"))))
    return F.transform(keyed, lambda h: F.struct(h["id"].alias("id"), h["name"].alias("name"))).cast(HISTORY)


def history_cell(cell: Column) -> Column:
    """The items of a table's history cell: a JSON or quoted list, one object, one JSON text, else parts by semicolons or else commas."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    parts = lambda sep: F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    quoted = F.regexp_extract(text, r"""^(?:"([^"\\]*)"|'([^'\\]*)')$""", 1)
    single = F.regexp_extract(text, r"""^(?:"([^"\\]*)"|'([^'\\]*)')$""", 2)
    alone = F.trim(F.when(quoted != "", quoted).otherwise(single))
    whole = F.when(text.startswith("{") & F.get_json_object(text, "$").isNotNull(), F.array(text)).when(alone != "", F.array(alone))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.coalesce(listed, whole, F.when(F.contains(text, F.lit(";")), parts(";")).otherwise(parts(","))))


def payloads(raw: DataFrame, body: str = "body") -> DataFrame:
    """``raw`` with user_id, text, history and error of each JSON body. A body is an object with preferences that aren't blank; history items without an id or name go."""
    o = F.trim(F.coalesce(F.col(body), F.lit("")))
    read = F.get_json_object(o, "$").isNotNull()
    get = lambda k: F.get_json_object(o, f"$.{k}")
    user = F.coalesce(get("user_id"), F.lit("1"))
    items = F.transform(F.coalesce(F.from_json(get("history"), "array<string>"), F.array().cast("array<string>")), lambda x: F.struct(F.get_json_object(x, "$.tmdb_id").alias("raw"), whole_number(F.get_json_object(x, "$.tmdb_id")).alias("id"), F.trim(F.coalesce(F.get_json_object(x, "$.name"), F.lit(""))).alias("name")))
    told = F.filter(items, lambda h: (F.coalesce(h["raw"], F.lit("")) != "") & (h["name"] != ""))
    bad = ~read
    error = (
        F.when(bad, "invalid JSON")
        .when(~o.startswith("{"), "not an object")
        .when(whole_number(user).isNull() | F.exists(told, lambda h: h["id"].isNull()), "invalid values")
        .when(F.trim(F.coalesce(get("preferences"), F.lit(""))) == "", "empty preferences")
    )
    history = F.transform(told, lambda h: F.struct(h["id"].alias("id"), h["name"].alias("name")))
    fine = error.isNull()
    return raw.withColumns({"user_id": F.when(fine, whole_number(user)), "text": F.when(fine, F.trim(get("preferences"))), "history": F.when(fine, history).cast(HISTORY), "error": error})


def contract(answers: DataFrame, items: DataFrame, asked: DataFrame) -> DataFrame:
    """``answers`` (request_id, doc, ...) with status: ok, missing, unknown item, or already seen by its request's history ids. ``items``: doc."""
    known = items.select("doc").distinct().withColumn("__known", F.lit(True))
    seen = asked.select("request_id", F.explode("history.id").alias("doc")).filter("doc is not null").distinct().withColumn("__seen", F.lit(True))
    met = answers.join(known, "doc", "left").join(seen, ["request_id", "doc"], "left")
    status = F.when(F.col("doc").isNull(), "missing").when(F.col("__known").isNull(), "unknown item").when(F.col("__seen"), "already seen").otherwise("ok")
    return met.withColumn("status", status).drop("__known", "__seen")


def respond(catalogue: DataFrame, raw: DataFrame, body: str = "body", **more) -> DataFrame:
    """request_id, user_id, tmdb_id, description, status of raw requests (request_id, body): the service as a table. Bad bodies answer with their error.

    With an ``arrived`` time each request has the time budget from then on.
    """
    if "arrived" in raw.columns:
        raw = raw.withColumn("deadline", F.col("arrived").cast("timestamp").cast("double") + BUDGET)
    asked = written(hooks.with_deadline(payloads(raw, body)), "payloads")
    fine = asked.filter("error is null").select("request_id", "user_id", "text", "history", "deadline")
    got = contract(recommend(catalogue, fine.drop("user_id"), **more).select("request_id", "doc", "description"), catalogue.select(F.col("tmdb_id").cast("long").alias("doc")), fine)
    met = asked.select("request_id", "user_id", "error").join(got, "request_id", "left")
    ok = F.col("status") == "ok"
    return met.select("request_id", "user_id", F.when(ok, F.col("doc")).alias("tmdb_id"), F.when(ok, F.substring("description", 1, 500)).alias("description"), F.coalesce("error", "status", F.lit("missing")).alias("status"))


def health(catalogue: DataFrame) -> DataFrame:
    """One row: status and the number of candidates."""
    return catalogue.agg(F.lit("ok").alias("status"), F.count("*").alias("candidates"))


def shown(shortlist: DataFrame, routes: DataFrame) -> DataFrame:
    """A shortlist for people: each row with its route, the route's limit, and whether the last stage sees it."""
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv]), F.col("route")), F.lit(1))
    return shortlist.join(routes.select("request_id", "route"), "request_id").withColumns({"route_limit": limit, "sent_to_final": F.col("rank") <= limit})


def run_cases(cases: DataFrame, catalogue: DataFrame, **more) -> DataFrame:
    """The results of a prompt table (case_index, category, prompt, history cell): answer, its item, reasons, checks and match score.

    All cases are answered as one job, so ``runtime_s`` is its seconds a case.
    """
    cell = history_items(history_cell(F.col("watch_history")))
    asked = cases.select(F.col("case_index").alias("request_id"), "category", F.trim(F.coalesce("prompt", F.lit(""))).alias("text"), cell.alias("history"))
    asked = written(asked, "cases")
    started = time.perf_counter()
    got = written(recommend(catalogue, asked.drop("category"), **more), "results")
    seconds = (time.perf_counter() - started) / max(1, asked.count())
    item = C.ensure_columns(catalogue).select(F.col("tmdb_id").cast("long").alias("doc"), *["genres", "year", "director", "top_cast", "production_countries", "spoken_languages"])
    people = evaluation.people_asked(asked, C.ensure_columns(catalogue))
    met = asked.join(got, "request_id", "left").join(item, "doc", "left").join(people, "request_id", "left")
    judged = selection.evaluate(evaluation.checks(met), list(selection.CHECKS))
    none = F.col("doc").isNull()
    return judged.select(
        F.col("request_id").alias("case_index"),
        "category",
        F.col("text").alias("prompt"),
        F.to_json("history").alias("history"),
        F.col("doc").alias("output_tmdb_id"),
        F.coalesce("title", F.lit("")).alias("movie_title"),
        F.col("genres").alias("movie_genres"),
        F.col("year").alias("movie_year"),
        F.coalesce("description", F.lit("")).alias("recommendation_message"),
        F.coalesce("used_llm", F.lit(False)).alias("used_llm"),
        F.coalesce("mode", F.lit("")).alias("retrieval_mode"),
        "route",
        "confidence",
        "convergence",
        F.lit(round(seconds, 3)).alias("runtime_s"),
        evaluation.repeats(F.col("doc"), F.col("title"), F.col("history")).alias("history_repeat"),
        (F.size("history") > 0).alias("has_history"),
        F.when(none, 0.0).otherwise(F.col("match_score")).alias("match_score"),
        F.when(none, 0).otherwise(F.col("checked")).alias("checked"),
        F.when(none, 0).otherwise(F.col("passed")).alias("passed"),
        F.when(none, "no_movie_data").otherwise(F.col("match_details")).alias("match_details"),
        *[F.when(~none, F.col(c)).alias(c) for c in selection.CHECKS],
        F.when(none, "no answer").otherwise("").alias("error"),
    )


def run_benchmark(spark: SparkSession, prompts: str, catalogue: DataFrame, output: str | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """Results and their summary of a prompt file with a ``preference`` or ``prompt`` column; results are also written as CSV to ``output``."""
    table = C.read_prompts(spark, prompts)
    named = next((c for c in ("preference", "prompt") if c in table.columns), None)
    if named is None:
        raise ValueError(f"{prompts} must have a preference or prompt column")
    table = C.ensure_columns(table, ["category", "watch_history"]).withColumn("case_index", F.monotonically_increasing_id())
    results = written(run_cases(written(table.select("case_index", "category", F.col(named).alias("prompt"), "watch_history"), "prompts"), catalogue, **more), "benchmark")
    if output:
        results.write.mode("overwrite").option("header", True).option("escape", '"').csv(output)
    return results, selection.report(results)
