"""Time budgets, sinks that survive a killed job, fingerprints, the HTTP source, embeddings and the service."""

import hashlib
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F
from test_plan import asked, items

from lumenrank.operators import enrichment, hooks
from lumenrank.plans import recommend as plan
from lumenrank.plans import service
from lumenrank.sources import catalogue, commits, objects, vectors
from lumenrank.sources.rest import JsonSource


def test_budget_is_spent_across_batches(spark):
    rows = spark.createDataFrame([(i, f"p{i}", 100.0 + 20) for i in range(6)] + [(6, "late", 100.0), (7, "free", None)], "request_id long, prompt string, deadline double").coalesce(1)
    at = [100.0]

    def slow(prompts, options):
        """Takes seven seconds of the clock for each call, and answers with its timeout."""
        at[0] += 7.0
        return [f"{options['timeout']:.0f}" for _ in prompts]

    # the function and its clock travel to one worker together
    got = {r.request_id: (r.answer, r.error) for r in hooks.ask(rows, slow, {}, 2, lambda at=at: at[0]).collect()}
    assert [got[i] for i in (0, 1)] == [("18", None)] * 2, "the whole budget but the buffer and margin"
    assert [got[i] for i in (2, 3)] == [("11", None)] * 2 and [got[i] for i in (4, 5)] == [("4", None)] * 2
    assert got[6] == (None, "no time left") and got[7] == ("18", None), "a request whose time is up isn't asked; one without a deadline has the whole budget"
    assert {r.error for r in hooks.ask(rows.filter("request_id < 2").drop("deadline"), lambda p, o: [], {}).collect()} == {"0 answers to 2 prompts"}


def test_a_killed_job_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Film {i}", "Drama", "") for i in range(23)], "tmdb_id long, title string, genres string, essence string")
    model = lambda prompts, options: [json.dumps({"essence": "A calm film. " * 30}) for _ in prompts]
    where, saved = str(tmp_path / "tags"), []

    def stop(name):
        saved.append(name)
        if len(saved) == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        enrichment.augment_in_parts(rows, model, "m", where, size=5, told=stop)
    assert commits.read_parts(spark, where).count() == 10
    spark.range(3).write.parquet(f"{where}/parts/00000002-left-behind")  # as a killed write leaves it
    assert commits.read_parts(spark, where).count() == 10
    more = []
    out = enrichment.augment_in_parts(rows, model, "m", where, size=5, told=more.append)
    assert more == ["00000002", "00000003", "00000004"]
    got = out.select("tmdb_id", "essence").collect()
    assert sorted(r.tmdb_id for r in got) == list(range(23)) and all(r.essence.startswith("A calm film") for r in got)


def test_swapped_tables(spark, tmp_path):
    where = str(tmp_path / "t")
    commits.swap(spark.range(3), where)
    commits.swap(commits.read_swapped(spark, where).selectExpr("id + 1 AS id"), where)
    assert sorted(r.id for r in commits.read_swapped(spark, where).collect()) == [1, 2, 3]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 1
    commits.write_part(spark.range(1), where, "x", rows=1)
    commits.write_part(spark.range(2), where, "x", rows=2)
    assert commits.manifests(spark, where)["x"]["rows"] == 2 and commits.read_parts(spark, where).count() == 2
    assert commits.read_parts(spark, str(tmp_path / "none")) is None


def test_fingerprints(spark, tmp_path):
    big, small = tmp_path / "big.bin", tmp_path / "small.csv"
    with open(big, "wb") as f:
        f.truncate((2 << 30) + 5)
    small.write_text("a,b\n1,2\n")
    got = {r.name: (r.sha256, r.size) for r in catalogue.fingerprint(spark, str(tmp_path)).collect()}
    digest = hashlib.sha256()
    for _ in range(2048):
        digest.update(bytes(1 << 20))
    digest.update(bytes(5))
    assert got == {"big.bin": (digest.hexdigest(), (2 << 30) + 5), "small.csv": (hashlib.sha256(small.read_bytes()).hexdigest(), 8)}
    now = catalogue.fingerprint(spark, str(small))
    told = spark.createDataFrame(now.collect(), now.schema)
    assert catalogue.is_current(spark, told, str(small))
    small.write_text("a,b\n1,3\n")
    assert not catalogue.is_current(spark, told, str(small)) and not catalogue.is_current(spark, None, str(small))


class Stub(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        key = self.path.split("?")[0].rsplit("/", 1)[-1]
        body = {"7": "[1]", "8": "no json"}.get(key, json.dumps({"id": int(key), "auth": self.headers.get("Authorization", "")}))
        self.send_response(500 if key == "9" else 200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


def test_objects_over_http(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        objects.register(spark)
        df = spark.read.format("json_objects").options(base=base, path="/movie/{key}", first="1", last="12", parts="5", token="t").load()
        assert df.rdd.getNumPartitions() == 5
        got = {r.key: r.detail and json.loads(r.detail) for r in df.collect()}
        assert got == {k: None if k in (7, 8, 9) else {"id": k, "auth": "Bearer t"} for k in range(1, 13)}
        assert spark.read.format("json_objects").options(base=base, path="/movie/{key}", first="5", last="4", token="t").load().collect() == []
        assert JsonSource(base).get("/movie/1") is None, "no credential, no call"
        merged = enrichment.merge_metadata(items(spark), df.withColumnRenamed("key", "tmdb_id"))
        assert {r.tmdb_id for r in merged.filter(F.col(enrichment.STATUS) == enrichment.VERSION).collect()} == {1, 2, 3, 4, 5}
    finally:
        server.shutdown()


def test_embeddings_and_readiness(spark, tmp_path, monkeypatch):
    source, where = tmp_path / "catalogue.csv", str(tmp_path / "vectors")
    source.write_text("tmdb_id,title\n1,Storm\n")
    assert vectors.readiness(spark, where, str(source))["reason"] == "artifacts_unavailable"
    for _ in range(2):  # the second build takes the first one's place
        enrichment.build_embeddings(items(spark), where, hooks.hashing_encoder(8), 8, str(source))
    assert vectors.read_vectors(spark, where).count() == 5 and vectors.metadata(spark, where)["dim"] == 8
    assert vectors.readiness(spark, where, str(source)) == {"ready": True, "reason": "ok", "model": vectors.MODEL, "dim": 8}
    monkeypatch.setenv("SOME_KEY", "xxxx")
    assert vectors.readiness(spark, where, str(source), "SOME_KEY")["reason"] == "credential_missing"
    source.write_text("tmdb_id,title\n1,Rain\n")
    assert vectors.readiness(spark, where, str(source))["reason"] == "artifacts_unavailable"


def test_recommend_with_models(spark):
    """A model that picks the last candidate, one that fails, and one that is out of time; intents come in before."""

    def last(prompts, options):
        ids = [[line.split(" | ")[0].strip("- ") for line in p.split("\n") if " | " in line] for p in prompts]
        return [json.dumps({"tmdb_id": i[-1], "description": "Because it is so."} if i else {"description": "Because."}) for i in ids]

    def broken(prompts, options):
        raise TimeoutError("late")

    requests = asked(spark).filter("request_id < 3")
    told = {r.request_id: r for r in plan.recommend(items(spark), requests, model=last).collect()}
    assert all(r.used_llm and r.description in ("Because it is so.", "Because.") for r in told.values())
    failed = {r.request_id: r for r in plan.recommend(items(spark), requests, model=broken).collect()}
    assert {k: (r.doc, r.used_llm) for k, r in failed.items()} == {1: (2, False), 2: (5, False)} and all(r.description for r in failed.values())
    reads = lambda prompts, options: [json.dumps({"genres": ["Horror"]}) for _ in prompts]
    over = asked(spark).filter("request_id = 3").withColumn("deadline", F.lit(5.0))
    early = over.withColumn("deadline", F.lit(None).cast("double")).withColumn("request_id", F.lit(5)).unionByName(over)
    late = {r.request_id: r for r in plan.recommend(items(spark), early, model=last, intent_model=reads).collect()}
    assert late[5].used_llm and late[5].doc == 4 and not late[3].used_llm, "nobody is asked about a request whose time is over"


def test_service(spark):
    bodies = [(1, '{"user_id": 7, "preferences": "a drama with rain", "history": [{"tmdb_id": 3, "name": "Quiet Rain"}]}'), (2, "nope"), (3, '{"preferences": " "}')]
    raw = spark.createDataFrame(bodies, "request_id int, body string").withColumn("arrived", F.current_timestamp())
    got = {r.request_id: r for r in service.respond(items(spark), raw).collect()}
    assert (got[1].user_id, got[1].status) == (7, "ok") and got[1].tmdb_id not in (None, 3) and got[1].description
    assert (got[2].status, got[3].status) == ("invalid JSON", "empty preferences") and got[2].tmdb_id is None
    assert tuple(service.health(items(spark)).first()) == ("ok", 5)


def test_benchmark_of_a_prompt_file(spark, tmp_path):
    (tmp_path / "prompts.csv").write_text('# cases\ncategory,preference,watch_history\ngenre,a drama,"[""Old Court""]"\nnone,,\n')
    results, summary = service.run_benchmark(spark, str(tmp_path / "prompts.csv"), items(spark), str(tmp_path / "out"))
    rows = {r.category: r for r in results.collect()}
    assert rows["genre"].genre_match and rows["genre"].has_history and not rows["genre"].history_repeat
    assert summary.first().n_cases == 2 and spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
