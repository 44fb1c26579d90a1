"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenrank.llm import bpe, exact_dedup, html_text, langid, mixing, quality_rules, secret_scan, simhash, toxicity, url_filter

LONG = "alpha beta gamma delta " * 20000
WORDS = " ".join(f"the word{i} of a sentence" for i in range(40))
DOCS = [
    (1, None, "en", "a", "x", 1), (2, "", None, "a", "x", 1), (3, LONG, "en", None, None, 1), (4, WORDS, "en", "a", "x", 1), (4, WORDS, "en", "a", "x", 1),
    (5, WORDS.upper(), "en", "b", "x", 1), (6, WORDS + " extra", "de", "b", "x", None), (None, "no id here", "en", "b", "x", 1), (7, " \t\n", "en", "b", "x", 1), (8, "ÀÉ 漢字 \U0001f600", "fr", "b", "x", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, digest string, keep long"
PAGES = [(1, None, None), (2, "no scheme", ""), (3, "http://A.example.NET/fr/x?q", "<p>hi</p>"), (3, "http://A.example.NET/fr/x?q", "<p>hi</p>"), (None, "https://com/", "<p>" + LONG)]


@pytest.fixture(scope="module", params=["rows", "none"])
def docs(spark, request):
    return spark.createDataFrame(DOCS if request.param == "rows" else [], SCHEMA).persist()


@pytest.fixture(scope="module", params=["rows", "none"])
def pages(spark, request):
    return spark.createDataFrame(PAGES if request.param == "rows" else [], "page_id long, url string, html string").persist()


@pytest.mark.parametrize("run", [exact_dedup.decide, simhash.decide, quality_rules.judge, secret_scan.scan, bpe.encode])
def test_one_row_per_document(docs, run):
    assert len(run(docs).collect()) == docs.count()


def test_learned(spark, docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (99, None), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    told = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert len(told) == docs.select("doc_id").distinct().count()
    if told:
        assert told[1].lang_pred == told[2].lang_pred == told[7].lang_pred == "und"


def test_stages_keep_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.collect()
    corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    rows = exact_dedup.decide(docs).collect()
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    stay = exact_dedup.deduplicate(docs).collect()
    assert len(stay) == len({r.text_sha256 for r in rows})
    assert sorted(r.doc_id for r in stay if r.text in (WORDS, WORDS.upper())) == [5]


def test_simhash_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    stay = simhash.deduplicate(docs, width=4).collect()
    groups = {r.component_id for r in simhash.decide(docs, width=4).collect()}
    assert len([r for r in stay if r.doc_id is not None]) == len({g for g in groups if g is not None})


def test_simhash_groups_are_not_told_apart_by_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (8, text(4)), (None, text(5)), (9, text(6)), (9, text(6)), (None, text(3))]
    stay = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, text(k)) for k in (1, 2, 3)] + [(7, text(4)), (7, text(5)), (9, text(6))]
    assert sorted(map(repr, map(tuple, stay))) == sorted(map(repr, want))


def test_near_copies_of_similarity_above_the_bound_go(spark):
    """Against brute force: word changes that leave a Jaccard similarity around 0.8."""
    rng, rows = random.Random(5), [(None, None), (None, ""), (900, "two words"), (901, "TWO words"), (None, "two words")]
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for c in range(3):
            copy = list(words)
            for i in rng.sample(range(150), c * rng.randrange(1, 4)):
                copy[i] = f"x{rng.randrange(10**6)}"
            rows.append((3 * k + c if k % 7 else None, " ".join(copy)))
    sets = [frozenset(zip(*[(t or "").lower().split()[i:] for i in range(min(5, len((t or "").split())))])) for _, t in rows]
    root, linked = list(range(len(rows))), 0
    for _ in range(4):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if (not a and not b) or (a | b and len(a & b) >= 0.8 * len(a | b)):
                    root[i] = root[j] = min(root[i], root[j])
                    linked += 1
    heads = {}
    for (ident, _), r in zip(rows, root):
        heads.setdefault(r, []).append((ident is None, ident))
    stay = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert linked > 100 and len(heads) > 60
    assert sorted(((r.doc_id is None, r.doc_id) for r in stay), key=repr) == sorted((min(h, key=lambda x: (x[0], x[1] or 0)) for h in heads.values()), key=repr)


def test_pages(pages):
    got = url_filter.judge(pages).collect()
    assert len(got) == pages.count()
    assert {(r.page_id, r.rule, r.verdict) for r in got if r.page_id == 3} <= {(3, "net/fr/", "block")}
    assert all(r.verdict == "allow" and r.host == "" for r in got if r.page_id in (1, 2))
    assert html_text.extract(pages).count() == pages.count()


def test_mixing_copies_follow_the_rate(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, None).otherwise("a").alias("source"))
    assert abs(mixing.mix(docs).count() - 4000) < 4 * 4000**0.5
    big = mixing.replicate(docs.limit(40), weights={"a": 1.0}, size=100.0)
    assert {r.source for r in big.select("row.source").distinct().collect()} == {"a"}
    assert abs(big.count() - 4000) < 4 * 4000**0.5, "rates above one Poisson part"
