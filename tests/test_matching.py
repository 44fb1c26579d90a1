"""Names in texts of any length, and dense search for any number of requests, against plain versions."""

import random
import re
import time

import numpy as np
import pytest

from lumenrank.operators import dense, parsing

WORDS = "the of a rain storm night-train o'clock sci-fi élan x2 (dark) court, race. über 漢 quiet".split()


def texts(n, words, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, k=words)) + rng.choice(["", " ", "\n"])) for i in range(n)]


def normal(text):
    low = text.strip(" \t\n\r\x0b\x0c").lower()
    for spelling in ("sci-fi", "sci fi", "scifi"):
        low = low.replace(spelling, "science fiction")
    return low


@pytest.mark.parametrize("sent", [True, False])
def test_names_equal_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(parsing, "PASSAGE", 4)
    if not sent:
        monkeypatch.setattr(parsing, "SENT_NAMES", 0)
    rng = random.Random(3)
    rows = texts(30, 40) + [(90, None), (91, ""), (92, "Rain"), (93, "  the OF a ")]
    names = {" ".join(rng.choices(WORDS, k=rng.randint(1, 12))) for _ in range(200)} | {"", "...", "rain\nstorm", "Ofa", "2"}
    names |= {" ".join(t.split()[i : i + k]) for _, t in rows if t for i, k in ((0, 9), (5, 20), (20, 20), (39, 1))}
    requests = spark.createDataFrame(rows, "request_id long, text string")
    got = parsing.met(requests, spark.createDataFrame([(n,) for n in names], "name string")).collect()
    want = {(i, n) for i, t in rows for n in names if re.search("[a-z0-9]|[^\0-\x7f]", normal(n)) and re.search(f"(^|[^a-z0-9]){re.escape(normal(n))}([^a-z0-9]|$)", normal(t or ""))}
    found = set(map(tuple, got))
    assert not found ^ want, (len(found - want), sorted(want - found)[:3], sorted(found - want)[:3])
    assert len(got) == len(found) and len(want) > 100


def test_time_grows_with_the_text(spark):
    names = spark.createDataFrame([(f"w{i} w{i + 1} w{i + 2}",) for i in range(0, 3000, 3)], "name string")

    def seconds(words):
        rng = random.Random(words)
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(words)) + " w30 w31 w32 end"
        df = spark.createDataFrame([(1, text)], "request_id long, text string").coalesce(1)
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            assert "w30 w31 w32" in {r.name for r in parsing.met(df, names).collect()}
            runs.append(time.perf_counter() - began)
        return min(runs)

    seconds(500)
    short, long = seconds(5_000), seconds(40_000)
    assert long < 8 * 2 * short + 2, (short, long)


def brute(vectors, items, k, out=()):
    rows = []
    for r, q in vectors:
        q = np.array(q) / (np.linalg.norm(q) or 1)
        scored = [(-np.floor(np.clip((q @ (np.array(v) / (np.linalg.norm(v) or 1)) + 1) / 2, 0, 1) * 1e6 + 0.5) / 1e6, d) for d, v in items if (r, d) not in out]
        rows += [(r, d, n) for n, (_, d) in enumerate(sorted(scored)[:k], 1)]
    return rows


@pytest.mark.parametrize("n", [1, 511, 512, 513, 1024, 2048, 10_000])
@pytest.mark.parametrize("query_bytes", [dense.QUERY_BYTES, 512 * 4 * 8])
def test_dense_for_any_number_of_requests(spark, n, query_bytes):
    rng = np.random.default_rng(n)
    # eighths: products are exact, so ties are ties in any order of adding up
    draw = lambda m: rng.integers(-8, 9, (m, 4)).astype(float).tolist()
    items, asked = list(enumerate(draw(60))), list(enumerate(draw(n)))
    few = [asked[i] for i in sorted({0, n // 3, n // 2, n - 1})]
    out = {(r, d) for r, _ in few for d in range(0, 60, 7)}
    vectors = spark.createDataFrame(asked, "request_id long, vector array<double>")
    table = spark.createDataFrame(items + [(98, None), (99, [float("nan")] * 4), (97, [1.0])], "doc long, embedding array<double>")
    found = dense.search(vectors, table, spark.createDataFrame(sorted(out), "request_id long, doc long"), k=5, query_bytes=query_bytes, cell_bytes=1000)
    got = found.select("request_id", "doc", "sem_rank").collect()
    assert len(got) == 5 * n and len({r.request_id for r in got}) == n
    asked_for = {r for r, _ in few}
    close = lambda rows: sorted((r, n) for r, _, n in rows)
    want = brute(few, items, 5, out)
    mine = [tuple(r) for r in got if r.request_id in asked_for]
    assert close(mine) == close(want)
    scores = lambda rows: {(r, n): round(float(np.dot(dict(asked)[r], dict(items)[d]) / ((np.linalg.norm(dict(asked)[r]) or 1) * (np.linalg.norm(dict(items)[d]) or 1))), 4) for r, d, n in rows}
    assert scores(mine) == scores(want) and not {(r, d) for r, d, _ in mine} & out


def test_plan_does_not_grow_with_requests(spark):
    def size(n):
        vectors = spark.range(n).selectExpr("id AS request_id", "array(1D, 0D) AS vector")
        items = spark.range(9).selectExpr("id AS doc", "array(0.5D, 0.5D) AS embedding")
        return len(dense.search(vectors, items, query_bytes=512 * 16)._jdf.queryExecution().executedPlan().toString().splitlines())

    assert size(1024) == size(4096)
