"""Pluggable models and encoders: plain functions over batches, called inside Arrow passes.

A model takes prompts and options and returns as many answers (or None); an encoder
takes texts and returns as many vectors. Neither is part of this engine; the offline
encoder hashes words, and without a model every answer is the deterministic one.
"""

import math
import time
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.json_object import extract_object
from ..sources.package import ship
from . import parsing

Model = Callable[[list[str], dict], list[str | None]]
Encoder = Callable[[list[str]], list[list[float]]]

#: Options of the three kinds of call.
INTENT = {"temperature": 0.0, "top_k": 5, "top_p": 0.3, "num_predict": 120}
CHOICE = {"temperature": 0.0, "top_k": 5, "top_p": 0.4, "num_predict": 150}
DESCRIPTION = {"temperature": 0.3, "top_k": 15, "top_p": 0.7, "num_predict": 180}
BATCH = 16


def seconds_left(deadline: float, now: float) -> float:
    """What is left until a request's deadline for a call, beside the buffer for its fallback and a margin."""
    return max(0.0, deadline - now - V.BUFFER - V.MARGIN)


def ask(prompts: DataFrame, model: Model, options: dict | None = None, batch: int = BATCH, clock: Callable[[], float] = time.time) -> DataFrame:
    """(request_id, answer, error) of ``prompts`` (request_id, prompt, and maybe deadline in seconds of the clock).

    A batch that fails has null answers and the error's first 500 characters. Each request's
    time runs on from batch to batch until its ``deadline``: with too little left it isn't
    asked, and of the others the least that is left is the call's timeout. Without a deadline a request has
    the whole budget when its batch begins. A failure stays with
    its batch: there is no flag that one request could set for others.
    """
    ship(prompts.sparkSession)
    kind = prompts.schema["request_id"].dataType.simpleString()
    options = dict(options or {})
    if "deadline" not in prompts.columns:
        prompts = prompts.withColumn("deadline", F.lit(None))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            prompts, deadlines = x["prompt"].tolist(), x["deadline"].tolist()
            answers, errors = [None] * len(x), ["no time left"] * len(x)
            for at in range(0, len(x), batch):
                part, now = range(at, min(at + batch, len(x))), clock()
                left = {i: seconds_left(now + V.BUDGET if pd.isna(deadlines[i]) else deadlines[i], now) for i in part}
                asked = [i for i in part if left[i] >= V.LEAST_LEFT]
                if asked:
                    try:
                        told = list(model([prompts[i] for i in asked], options | {"timeout": min(left[i] for i in asked)}))
                        if len(told) != len(asked):
                            raise ValueError(f"{len(told)} answers to {len(asked)} prompts")
                        error = None
                    except Exception as e:  # whatever a foreign model raises
                        told, error = [None] * len(asked), str(e)[:500] or type(e).__name__
                    for i, answer in zip(asked, told):
                        answers[i], errors[i] = answer, error
            yield pd.DataFrame({"request_id": x["request_id"].to_numpy(), "answer": answers, "error": errors})

    return prompts.select("request_id", "prompt", F.col("deadline").cast("double").alias("deadline")).mapInPandas(run, f"request_id {kind}, answer string, error string")


def intent_prompt(text: Column, genres: Column) -> Column:
    """Asks for the constraints of one request as JSON."""
    rules = (
        "Answer with one JSON object that holds only the constraints found in the request; leave out all others.",
        "Fields: genres, avoid, named_people, keyword_hints, tone, country_or_language (lists of text); release_year and runtime ({min, max}); setting_period (text); quality_preference (true or false).",
    )
    return F.concat_ws("\n", *map(F.lit, rules), F.concat(F.lit("Genres: "), F.array_join(genres, ", ")), F.concat(F.lit("Request: "), F.coalesce(text, F.lit(""))))


def sanitised(answer: Column, genres: Column) -> Column:
    """A model's answer as parsing.OVERRIDE, null if it holds no object; lists at three genres, refusals and people, four tones, five hints, three places."""
    o = extract_object(answer)
    get = lambda k: F.get_json_object(o, f"$.{k}")
    empty = F.array().cast("array<string>")
    listed = lambda k, n: F.slice(F.filter(F.transform(F.coalesce(F.from_json(get(k), "array<string>"), empty), lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))), lambda x: x != ""), 1, n)
    some = lambda c: F.when(F.size(c) > 0, c)
    known = F.transform(listed("genres", 100), lambda g: F.get(F.filter(genres, lambda k: T.normalize(k) == T.normalize(g)), 0))
    number = lambda *ks: F.coalesce(*[get(k).try_cast("double").cast("int") for k in ks])
    low, high = F.coalesce(number("release_year.min", "release_year.min_year"), F.lit(0)), F.coalesce(number("release_year.max", "release_year.max_year"), F.lit(9999))
    least, most = number("runtime.min", "runtime.min_runtime"), number("runtime.max", "runtime.max_runtime")
    short = F.coalesce(get("runtime.short_requested") == "true", F.lit(False))
    tone = F.when(F.size(listed("tone", 4)) > 0, listed("tone", 4)).otherwise(listed("tone_modifiers", 4))
    fields = (
        some(F.slice(F.array_compact(known), 1, 3)).alias("genres"),
        some(listed("avoid", 3)).alias("avoid"),
        some(listed("named_people", 3)).alias("people"),
        F.when((low > 0) & (high >= low), F.struct(low.alias("min"), high.alias("max"))).alias("year"),
        F.when(least.isNotNull() | most.isNotNull() | short, F.struct(least.alias("min"), F.coalesce(most, F.when(short, 110)).alias("max"), short.alias("short"))).alias("runtime"),
        F.substring(F.trim(F.regexp_replace(F.coalesce(get("setting_period"), F.lit("")), r"\s+", " ")), 1, 80).alias("setting"),
        some(tone).alias("tone"),
        some(listed("keyword_hints", 5)).alias("hints"),
        F.when(get("quality_preference").isin("true", "false"), get("quality_preference") == "true").alias("quality"),
        some(listed("country_or_language", 3)).alias("countries"),
    )
    return F.when(o.isNotNull(), F.struct(*fields)).cast(parsing.OVERRIDE)


def with_deadline(requests: DataFrame) -> DataFrame:
    """Requests with a ``deadline``, null where none is set."""
    return requests if "deadline" in requests.columns else requests.withColumn("deadline", F.lit(None).cast("double"))


def intents(requests: DataFrame, genres: DataFrame, model: Model) -> DataFrame:
    """(request_id, override) of requests that a model found constraints in. ``genres`` (genre) is the catalogue's short list."""
    known = genres.agg(F.sort_array(F.collect_set("genre")).alias("known"))
    told = with_deadline(requests).select("request_id", "text", "deadline").crossJoin(F.broadcast(known))  # one row
    said = ask(told.select("request_id", "deadline", intent_prompt(F.col("text"), F.col("known")).alias("prompt")), model, INTENT)
    found = said.filter("answer is not null").crossJoin(F.broadcast(known)).select("request_id", sanitised(F.col("answer"), F.col("known")).alias("override"))
    return found.filter("override is not null")


def hashing_encoder(dim: int = 384) -> Encoder:
    """An offline encoder: each word adds or takes one at the place that its checksum names; vectors have length one."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return encode


def checked_vectors(payload: object, n: int, dim: int) -> list[list[float]]:
    """An encoder's answer as ``n`` vectors of ``dim`` finite numbers and length one; one flat list counts as one vector. Anything else is an error."""
    if not isinstance(payload, (list, tuple)) or not len(payload):
        raise ValueError("an encoder must return a list of vectors")
    rows = [payload] if all(isinstance(x, (int, float)) for x in payload) else list(payload)
    if len(rows) != n:
        raise ValueError(f"{len(rows)} vectors for {n} texts")
    out = []
    for row in rows:
        if not isinstance(row, (list, tuple)) or not all(isinstance(x, (int, float)) for x in row):
            raise ValueError("a vector must be a list of numbers")
        if len(row) != dim:
            raise ValueError(f"a vector of {len(row)} numbers where {dim} are expected")
        norm = math.sqrt(sum(float(x) ** 2 for x in row))
        if not math.isfinite(norm):
            raise ValueError("a vector holds a number that isn't finite")
        out.append([float(x) / (norm or 1.0) for x in row])
    return out


def encode(rows: DataFrame, id_col: str, text_col: str, encoder: Encoder, dim: int, batch: int = BATCH) -> DataFrame:
    """(id, embedding): unit vectors of the texts, ``batch`` at a time; null counts as empty. A wrong shape fails the job."""
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for at in range(0, len(x), batch):
                part = x.iloc[at : at + batch]
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "embedding": checked_vectors(encoder(list(part["t"])), len(part), dim)})

    return rows.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(run, f"{id_col} {kind}, embedding array<float>")


def encode_requests(asked: DataFrame, encoder: Encoder, dim: int) -> DataFrame:
    """(request_id, vector) of the dense texts of completed profiles; blank ones have none."""
    return encode(asked.filter("trim(dense_text) <> ''"), "request_id", "dense_text", encoder, dim).withColumnRenamed("embedding", "vector")
