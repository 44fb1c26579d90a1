"""The first JSON object in a model's free-form answer. A brace scan has no SQL form, so this is an Arrow function."""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(text: str | None) -> str | None:
    """The first span that parses as a JSON object, re-serialised with sorted keys; None if there is none."""
    reader = json.JSONDecoder()
    at = (text or "").find("{")
    while at >= 0:
        try:
            found, _ = reader.raw_decode(text, at)
            return json.dumps(found, sort_keys=True)
        except ValueError:
            at = text.find("{", at + 1)
    return None


def last_balanced(text: str) -> str | None:
    """The last span from a brace to the brace that closes it, braces inside strings aside."""
    found, start, depth, quoted, escaped = None, -1, 0, False, False
    for i, c in enumerate(text):
        if start < 0:
            if c == "{":
                start, depth = i, 1
        elif quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                found, start = text[start : i + 1], -1
    return found


def _parsed(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def object_of(text: str | None) -> str | None:
    """The object that a model's answer holds, re-serialised with sorted keys.

    In this order: the whole answer, also without a code fence; what starts at the first brace; the last
    balanced span; the first span that parses. None if there is none.
    """
    raw = (text or "").strip()
    found = _parsed(raw)
    if found is None and raw.startswith("```"):
        raw = raw.split("\n", 1)[1] if "\n" in raw else raw
        raw = raw.removesuffix("```").strip()
        found = _parsed(raw)
    if found is None and "{" in raw:
        try:
            first = json.JSONDecoder().raw_decode(raw, raw.find("{"))[0]
            found = first if isinstance(first, dict) else None
        except ValueError:
            found = _parsed(last_balanced(raw) or "")
    return json.dumps(found, sort_keys=True) if found is not None else first_object(raw)


def extract_object(c: Column) -> Column:
    """``object_of`` each text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(object_of)

    return run(c)
