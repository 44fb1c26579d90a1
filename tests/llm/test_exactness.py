"""Operators against brute force, the library, and hand-made cases."""

import array
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenrank.llm import bpe, html_text, quality_rules, queries, secret_scan, simhash, toxicity, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_secrets_base(spark, texts):
    pattern = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
    for r in queries.op1_secret_scan(spark, SF).collect():
        t = texts[r.doc_id]
        spans = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[1]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_secrets_method(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = secret_scan.MarkovRatio(secret_scan.training_samples(docs))
    secret = "x9Qv2LmT7kRzW4bN8pYc"
    text = f"key {secret} and internationalization of the getUserProfileInformation"
    assert secret_scan.spans_of(text, model)[1] == [(4, 4 + len(secret), "random")]
    assert secret_scan.redact(text, model).startswith("key <SECRET> and inter")
    assert secret_scan.base_spans("secret=token: abcdefghijklmnop") == []


def test_bpe_equals_the_library(texts):
    tool = bpe.encoder(None)
    rng = random.Random(3)
    odd = ["".join(rng.choice("aábB  \n\t\x0b\x0c\x1c  's½²!?.,<|endoftext|>") for _ in range(rng.randint(0, 900))) for _ in range(200)]
    odd += ["<|endoftext|>" * 200, "x" * 5000, "É" * 3000 + ".,", "日本語" * 500, "a.,́ b", "..a, <,x. Y,"]
    every = list(texts.values()) + odd + odd
    got = tool.encode(every)
    for t, g, w in zip(every, got, tool.library.encode_batch(every, add_special_tokens=False)):
        assert list(array.array("I", g)) == w.ids
        assert tool.decode(w.ids) == tool.library.decode(w.ids, skip_special_tokens=False)
    assert tool.hits > 0


def brute_fingerprint(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(spark, texts):
    got = {r.doc_id: r for r in queries.op4_simhash(spark, SF).collect()}
    fps = {i: brute_fingerprint(t, 4) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    least = {i: i for i in fps}
    for _ in range(12):
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    least[i] = min(least[i], least[j])
    assert {i: r.component_id for i, r in got.items()} == least


@pytest.mark.parametrize("bucket", [2, 1024])
def test_simhash_large_buckets(spark, bucket):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 4)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False)) for b in base for _ in range(60)}
    links = simhash.links_of(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, bucket).collect()
    root = {f: f for f in fps}

    def settle(pairs):
        out = dict(root)
        for _ in range(len(fps)):
            before = dict(out)
            for a, b in pairs:
                out[a] = out[b] = min(out[a], out[b])
            if out == before:
                return out
        return out

    assert settle([(r.u, r.v) for r in links]) == settle([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])


def test_quality_counts(spark, texts):
    for r in queries.op6_quality_rules(spark, SF).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        seen = Counter(zip(words, words[1:], words[2:]))
        covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
    row = quality_rules.judge(spark.createDataFrame([(1, "a b c\n\na b c a b c \nx")], "doc_id int, text string")).first()
    assert (row.n_words, row.n_repeat_words, row.n_dup_lines, row.base_failed) == (10, 9, 0, True)


def test_toxicity_restores():
    model = toxicity.CharModel([("idiot", 50.0), ("clown", 50.0), ("the", 900.0), ("tion", 80.0)])
    got = {w: toxicity.restore_token(w, model) for w in ("1d10t", "i.d.i.o.t", "cl0wn!", "idiooot", "the", "idiot")}
    assert got == {"1d10t": "idiot", "i.d.i.o.t": "idiot", "cl0wn!": "clown", "idiooot": "idiot", "the": "the", "idiot": "idiot"}
    assert "idiot" in toxicity.tokens_of("you i d i o t now")


SPACED_PHRASES = ["you i d i o t.", "such a c l o w n, go", "are a i d i o t now", "y o u i d i o t", "you i  d  i\n o t now", "I a m a c l o w n!", "(1 d 1 0 t)", "a g i t"]


@pytest.mark.parametrize("text", SPACED_PHRASES)
def test_toxicity_spacing(text):
    words = [("idiot", 50.0), ("clown", 50.0), ("git", 50.0), ("you", 500.0), ("a", 400.0), ("i", 400.0), ("are", 300.0), ("am", 300.0), ("such", 100.0), ("now", 100.0), ("the", 900.0), ("tion", 80.0)]
    model = toxicity.Model({"idiot": 0.95, "clown": 0.95, "git": 0.95}, toxicity.CharModel(words))
    assert model.score(text) > 0.9
    assert model.score("a b c d e f g, x y z") < 0.1 and model.score("you are a i now") < 0.1


def test_html():
    page = """<html><head><title>no</title></head><body><nav><a href=/>Home</a></nav><div class="cookie notice">We use cookies</div>
    <header>Site</header><article><h1>A &amp; B</h1><p>one <b>t</b>wo&nbsp;three<br>four<aside>ad</aside><p>five</p><script>x("</p>")</script>
    <section id="comments"><article><p>nice post</p></article></section></article><footer>&copy;</footer></body>"""
    assert html_text.extract_text(page) == "A & B one two three four five"
    bare = "<div><a href=1>x</a></div>" * 8 + "<div>" + "long words here " * 20 + "</div><div>short end</div>" + "<div><a href=1>y</a></div>" * 8
    assert html_text.extract_text(bare) == ("long words here " * 20).strip() + " short end"
    assert html_text.extract_text("<p>cut &amp; off<b") == "cut & off" and html_text.extract_text(None) == ""


def test_html_marks_without_text_and_small_regions():
    body = "<p>" + "long words here " * 20 + "</p>"
    want = ("long words here " * 20).strip()
    for mark in ("<script>'<article>'</script>", "<!-- <main> -->", "<section class=comments><article><p>nice</p></article></section>", "<article></article>"):
        assert html_text.extract_text(body + mark) == want, mark
    gap = "<div><a href=1>x</a></div>" * 8
    long = "long words here " * 200
    assert html_text.extract_text(f"<p>{long}</p>{gap}<p>{'second part ' * 9}</p>") == f"{long}{'second part ' * 9}".strip()


def test_url_propagation(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    pages = [(1, "http://bad.net/es/1", ""), (2, "http://farm.org/", link("bad.net") * 3), (3, "http://good.com/a", link("fine.org")), (4, "http://fine.org/", ""), (5, "http://www.example.com/en/", ""), (6, "http://sub.example.com/en/1", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == {1: ("net/es/", "block"), 2: (None, "block"), 3: ("com/", "allow"), 4: (None, "allow"), 5: ("www.example.com/en/", "allow"), 6: ("example.com/en/", "block")}


@pytest.mark.parametrize("farm", [2, 10, 1000])
def test_url_farms_of_any_size(spark, farm):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    pages = [("http://bad.net/es/1", ""), ("http://good.com/a", link("fine.org") + link("bad.net"))]
    pages += [(f"http://farm{i}.org/", link("bad.net")) for i in range(farm)]
    pages += [(f"http://two{i}.org/", link(f"farm{i % farm}.org")) for i in range(2 * farm)]
    pages += [("http://fine.org/", ""), ("http://mixed.org/", link("bad.net") + "".join(link(f"other{i}.org") for i in range(9)))]
    got = {r.host: r.verdict for r in url_filter.judge(spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id int, url string, html string")).collect()}
    assert {v for h, v in got.items() if h.startswith(("farm", "two"))} == {"block"}
    assert got["fine.org"] == got["mixed.org"] == got["good.com"] == "allow"


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    langs = queries.op9_langid(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert langs.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    toxic = queries.op5_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert toxic.filter("toxic = 0").agg(F.avg("predicted")).first()[0] < 0.05
    assert toxic.filter("toxic = 1").agg(F.avg("predicted")).first()[0] > 0.6
