"""Operators against plain versions of their rules, on inputs small enough for those."""

import hashlib
import html as entities
import itertools
import math
import random
import re
import time
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenrank.llm import bpe, html_text, langid, mixing, quality_rules, secret_scan, simhash, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


# ---- op1


def test_secrets_on_held_out_strings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = secret_scan.MarkovRatio(secret_scan.training_samples(docs, sample_docs=100))
    secrets = [s for s in secret_scan.random_samples(600, seed=99) if len(s) >= 20]
    rng = random.Random(5)
    parts = "user account session handler manager request response builder factory index buffer stream parser config service worker queue table column value token cache entry record".split()
    makers = ("_".join, "-".join, "/".join, lambda ws: "".join(w.capitalize() for w in ws), lambda ws: "_".join(ws).upper())
    plain = [makers[i % len(makers)](rng.choices(parts, k=rng.randint(3, 5))) for i in range(600)]
    plain = [w for w in plain if 16 <= len(w) <= 60]
    found = sum(model.is_random(s) for s in secrets)
    false = sum(model.is_random(w) for w in plain)
    assert found / len(secrets) > 0.9 and found / (found + false) > 0.98


# ---- op2


def test_bpe_of_other_tokenizers_and_joins_that_disagree():
    import public_tokenizers

    other = bpe.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["Two  words.\n" * 60, "", "naïve é́ <|endoftext|> x", "tail " * 300]
    assert not other.reuse
    assert [list(array("I", x)) for x in other.encode(texts)] == [e.ids for e in other.library.encode_batch(texts, add_special_tokens=False)]
    ids = other.library.encode(texts[0], add_special_tokens=False).ids
    assert other.decode(ids) == other.library.decode(ids, skip_special_tokens=False)
    tool = bpe.Encoder(str(public_tokenizers.path("word_bpe_49k.json")))
    text = " ".join(f"word{i}" for i in range(400))
    want = tool.library.encode(text, add_special_tokens=False).ids
    assert list(array("I", tool.encode([text])[0])) == want and tool.whole == 0
    for c in tool.chunks.young.values():
        c.last = (c.last[0], b"\1\0\0\0")  # as if a neighbour changed a chunk's last word
    assert list(array("I", tool.encode([text])[0])) == want and tool.whole == 1


# ---- op4 and the pipeline's near duplicates


def test_links_of_similar_sets():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 40, 60, dtype=np.uint64)) for _ in range(6)]
    common = rng.integers(0, 1 << 40, 30, dtype=np.uint64)
    sets = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    for b in base:
        for drop in (0, 1, 3, 6, 7, 12, 30):
            sets.append(np.unique(np.concatenate([b[drop:], common[: drop // 2]])))
    marks, roots = np.arange(len(sets)), np.arange(len(sets))

    def parts(links):
        label = list(range(len(sets)))
        for _ in sets:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    want = [(i, j) for i, j in itertools.combinations(range(2, len(sets)), 2) if simhash.similarity_of(sets[i], sets[j]) >= 0.8]
    assert parts(simhash.alike_links(marks, roots, sets, 0.8)) == parts(want)


def near_texts():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)] + "the of and to in is that it for was with as be by on are this from or an at which".split() * 60
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for i in range(8):
        words = rng.choices(vocabulary, k=rng.randint(80, 200))
        if i % 2:
            words = words[:40] + passage + words[40:]
        texts += [" ".join(words), " ".join(words[:-2] + ["end", "here"]), " ".join(words[: len(words) * 2 // 3])]
    return texts


def jaccard(a, b):
    sets = []
    for text in (a, b):
        words = WORD.findall(lower(text))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def components(texts, linked):
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if linked[i][j]:
                label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("group", [3, 256])
def test_near_duplicates_in_small_blocks(spark, group):
    texts = near_texts()
    label = components(texts, [[jaccard(a, b) >= 0.8 for b in texts] for a in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicate_similar(docs, group=group).collect()}
    assert kept == {label.index(x) for x in set(label)}


def brute_quality(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    known = {form(w) for w in quality_rules.stop_word_list() for form in (str.lower, str.capitalize, str.upper)}
    seen = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    per = lambda a, b: a / b if b else 0.0
    measure = {
        "n_words": len(words), "mean_word_chars": per(sum(map(len, words)), len(words)), "symbols_per_word": per(sum(c in quality_rules.SYMBOLS for c in text), len(words)), "stop_word_ratio": per(sum(w in known for w in words), len(words)),
        "dup_line_ratio": per(len(lines) - len(set(lines)), len(lines)), "bullet_line_ratio": per(sum(bool(re.match(r"\s*[-*•]\s", x)) for x in lines), len(lines)), "ellipsis_line_ratio": per(sum(bool(re.search(r"(\.\.\.|…)\s*$", x)) for x in lines), len(lines)),
        "repeat_word_ratio": per(len(repeated), len(words)),
    }
    inside = lambda x, least, most: (least is None or x >= least) and (most is None or x <= most)
    return len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and all(inside(measure[m], least, most) for _, m, least, most in quality_rules.THRESHOLDS)


def brute_copies(rows):
    counts = Counter(r["source"] for r in rows)
    weight = {s: n**mixing.ALPHA for s, n in counts.items()}
    out = []
    for r in rows:
        rate = weight[r["source"]] * len(rows) / (sum(weight.values()) * counts[r["source"]])
        parts = max(1, math.ceil(rate / mixing.PART))
        mean, copies = rate / parts, 0
        for j in range(parts):
            u = int(hashlib.md5(f"{mixing.SEED}|{j}|{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:12], 16) / 2**48
            k, p, total = 0, math.exp(-mean), math.exp(-mean)
            while total < u:
                k += 1
                p *= mean / k
                total += p
            copies += k
        out += [r] * copies
    return out


def test_pipeline_stage_by_stage(spark):
    texts = near_texts()
    rows = [(i, t, "en", "abc"[i % 3] if i % 7 else None, len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[0].upper(), "en", "a", 1), (100, texts[3], "de", "b", 1), (101, None, "en", "a", 0), (102, "too short", "en", "a", 9), (None, texts[6] + " tail", "en", "b", 3), (None, " ".join(f"unlike {i} the of" for i in range(40)), None, None, 4)]
    rows += [(103, "the same line of words\n" * 30, "en", "a", 5), (104, " ".join(f"# sym{i} * the" for i in range(40)), "en", "a", 6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    now = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]
    key = lambda r: repr((r["doc_id"], r["text"], r["source"]))

    def check(name):
        nonlocal docs
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
        got = [r.asDict() for r in out.collect()]
        assert sorted(map(key, got)) == sorted(map(key, now)), name
        docs = spark.createDataFrame([tuple(r.values()) for r in got], schema)

    now = [r for r in now if brute_quality(r["text"])]
    assert 24 <= len(now) < len(rows)
    check("quality_rules")
    best = {}
    for r in now:
        k = lower(r["text"])
        if k not in best or (best[k]["doc_id"] is None, -(best[k]["doc_id"] or 0)) > (r["doc_id"] is None, -(r["doc_id"] or 0)):
            best[k] = r
    now = list(best.values())
    check("exact_dedup")
    now.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    linked = [[jaccard(a["text"], b["text"]) >= 0.8 for b in now] for a in now]
    label = components(now, linked)
    now = [r for i, r in enumerate(now) if label.index(label[i]) == i]
    check("simhash_near_dedup")
    now = brute_copies(now)
    check("mixing")
    told = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    library = bpe.encoder(None).library
    want = []
    for r in now:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in told)


def test_pipeline_runs(spark, tmp_path):
    texts = near_texts()
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= set(range(len(texts)))


# ---- op5


def test_viterbi_against_all_paths():
    model = toxicity.CharModel([("idiot", 50.0), ("clown", 30.0), ("the", 90.0), ("silly", 20.0), ("ill", 15.0)])

    def cost(word, empties):
        padded = f"^^{word}$"
        return sum(model.cost(*padded[i - 2 : i + 1]) for i in range(2, len(padded))) + 0.5 * empties

    for token in ("1d10t", "c1@wn", "i.d.i.o.t", "s!!!lly", "1111", "th33e", "0*1", "iiidiot"):
        places = toxicity.lattice(token)
        paths = itertools.product(*places)
        best = min((cost("".join(p), sum(not c for c in p)), "".join(p)) for p in paths)
        assert toxicity.viterbi(places, model) == best[1], token


def test_evidence_against_plain_counts(spark):
    rng = random.Random(2)
    bad, good = ["venomous", "scornful", "vile"], [f"plain{chr(97 + i)}" for i in range(20)]
    rows, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        words = rng.choices(good, k=12) + (rng.sample(bad, 2) if toxic else []) + [f"own{chr(97 + i % 26)}{chr(97 + i // 26)}"]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    import zlib

    used = [(t, dict(labels)[i]) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    pos, neg = Counter(), Counter()
    for text, toxic in used:
        (pos if toxic else neg).update({f for w in set(text.split()) for f in toxicity.features(w)})
    e1, e0 = sum(pos.values()), sum(neg.values())
    assert model.evidence
    for f, weight in model.evidence.items():
        assert weight == pytest.approx((pos[f] + 0.1) / (pos[f] + neg[f] * e1 / e0 + 0.3)) and toxicity.g_test(pos[f], neg[f], e1, e0) >= toxicity.LEAST_G
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    for r in toxicity.score(docs, model).collect():
        hits = {w: max(model.evidence.get(f, 0.0) for f in toxicity.features(w)) for w in set(dict(rows)[r.doc_id].split())}
        clean = 1 - toxicity.PRIOR
        for weight in filter(None, hits.values()):
            clean *= 1 - weight
        assert r.held_out == (r.doc_id in held) and r.score == pytest.approx(1 - clean)


# ---- op7


def brute_regions(weights, window, surge, dive):
    half, n = window // 2, len(weights)
    sums = [sum(weights[max(0, i - half) : i + half + 1]) for i in range(n)]
    high = min(surge, max(sums, default=0) / 2)
    if high <= 0:
        return []
    marks = "".join("x" if s >= high else "-" if s >= min(dive, high) else "." for s in sums)
    return [m.span() for m in re.finditer("[x-]+", marks) if "x" in m[0]]


def test_windows_against_plain_sums():
    rng = random.Random(1)
    for _ in range(400):
        weights = [rng.choice((0, 0, 5, 30, 90, 400)) for _ in range(rng.randint(0, 30))]
        window, surge, dive = rng.choice((1, 3, 5)), rng.choice((0, 40, 80, 500)), rng.choice((1, 20, 90))
        assert html_text.regions(weights, window, surge, dive) == brute_regions(weights, window, surge, dive)


def made_page(rng):
    """A page and its article: unmarked clutter around it, and a menu, an advert and a footer."""
    say = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet tempor magna aliqua & veniam".split()) for _ in range(n))
    article = [say(rng.randint(2, 8))] + [say(rng.randint(1, 80)) for _ in range(rng.randint(1, 9))]
    body = f"<h1>{entities.escape(article[0])}</h1>" + "".join(f"<p>{entities.escape(x)}</p>" for x in article[1:])
    clutter = lambda: "".join(f"<div>{entities.escape(say(rng.randint(1, 4)))}</div>" for _ in range(rng.randint(1, 4))) + "<div><a href=x>more</a> <a href=y>other</a></div>"
    holder = rng.choice(("article", "main", "div role=main"))
    page = f"<html><body><nav><ul><li><a href=/>{say(1)}</a></li></ul></nav>{clutter()}<{holder}>{body}</{holder.split()[0]}>{clutter()}<div class=ad>{say(9)}</div><footer>{say(5)}</footer></body></html>"
    return page, " ".join(article)


def hard_page(rng, kind):
    """A page and its text: a teaser as the marked article and the text outside; a second, short article; or links and share lines in the article."""
    say = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet tempor magna aliqua et veniam".split()) for _ in range(n))
    p = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
    long = [say(rng.randint(150, 250)) for _ in range(rng.randint(3, 7))]
    menu = "<nav><a href=/>home</a></nav>"
    if kind == "teaser":
        return f"<body>{menu}<article><p>{say(2)}</p></article><div>{p(long)}</div><div>{say(2)}</div><footer>{say(5)}</footer></body>", " ".join(long)
    if kind == "second":
        return f"<body>{menu}<article>{p(long)}</article><div class=ad>{say(5)}</div><article><p>{say(2)}</p></article></body>", " ".join(long)
    short = [say(rng.randint(1, 4)) for _ in range(3)]
    links = "<div><a href=a>share this</a> | <a href=b>print it</a></div><ul>" + "".join(f"<li><a href=x>{say(6)}</a></li>" for _ in range(4)) + "</ul>"
    return f"<body>{menu}<article><h1>{short[0]}</h1>{links}{p(long)}<p>{short[1]}</p><p>{short[2]}</p></article></body>", " ".join([short[0], *long, *short[1:]])


def test_the_distribution_decides():
    rng = random.Random(7)
    plain = [made_page(rng) for _ in range(300)]
    hard = [hard_page(rng, kind) for kind in ("teaser", "second", "links") for _ in range(60)]

    def right(pages, rule):
        return sum(rule(page) == text for page, text in pages)

    def inside(page):
        return " ".join(x.text for x in html_text.lines_of(page) if x.text and x.inside and not x.never)

    def marks(page):
        lines = html_text.lines_of(page)
        return " ".join(lines[i].text for i, w in html_text.weights_of(lines) if w > 0)

    assert right(plain, html_text.extract_text) == len(plain) and right(plain, marks) < 0.1 * len(plain)
    assert right(hard, html_text.extract_text) == len(hard) and right(hard, inside) == 0


def test_html_in_linear_time_and_clashing_columns(spark):
    for unit in ("<button>ab</b>", '<div class="ad">x', "<nav><article>", '<a title="x>y '):
        page = unit * (1_100_000 // len(unit))
        began = time.process_time()
        html_text.extract_text(page)
        assert time.process_time() - began < 2, unit
    pages = spark.createDataFrame([(1, "u", "<p>hello</p>", "mine", 7)], "page_id long, url string, html string, text string, n_chars int")
    row = html_text.extract(pages).first()
    assert (row.text, row.n_chars, row.text_of_page, row.n_chars_of_page) == ("hello", 5, "mine", 7)


# ---- op9


def test_languages_against_plain_scores(spark):
    rng = random.Random(3)
    stock = {"en": ["the", "house", "river", "stone"], "de": ["das", "haus", "fluss", "stein"], "fr": ["la", "maison", "fleuve", "pierre"]}
    rows = [(i, " ".join(rng.choices(stock[lang], k=9)), lang) for i, lang in enumerate(rng.choices(list(stock), k=120))]
    rows += [(500, "housing rivers", None), (501, "Steine 42 häuser", "de"), (502, "1234", "en"), (503, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    import zlib

    words = {lang: Counter() for lang in stock}
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            words[lang].update(re.findall(r"[^\W\d_]+", (text or "").lower()))
    langs = sorted(words)

    def log_shares(counts):
        return [{x: math.log(n / sum(c.values())) for x, n in c.items()} for c in counts]

    grams = {}
    for n in (1, 2, 3, 4):
        found = [Counter() for _ in langs]
        for c, lang in zip(found, langs):
            for w, k in words[lang].items():
                base = w if n == 1 else f"_{w}_"
                for at in range(len(base) - n + 1):
                    c[base[at : at + n]] += k
        grams[n] = log_shares(found)
    known = log_shares([words[lang] for lang in langs])

    def score(word):
        if any(word in t for t in known):
            return [t.get(word, langid.FLOOR) for t in known]
        for n in (4, 3, 2, 1):
            base = word if n == 1 else f"_{word}_"
            met = [[t.get(base[i : i + n], langid.FLOOR) for t in grams[n]] for i in range(len(base) - n + 1) if any(base[i : i + n] in t for t in grams[n])]
            if met:
                return [sum(col) / len(met) for col in zip(*met)]
        return [0.0] * len(langs)

    for r in langid.identify(docs, model).collect():
        ws = re.findall(r"[^\W\d_]+", (next(t for i, t, _ in rows if i == r.doc_id) or "").lower())
        if not ws:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = [sum(col) for col in zip(*map(score, ws))]
        best = max(range(len(langs)), key=lambda i: total[i])
        assert r.lang_pred == langs[best] and r.score == pytest.approx(1 / sum(math.exp(max(t - total[best], -700)) for t in total))


def test_top_items_stay_within_the_limit(spark):
    rows = [("en", 0, f"w{i}", 5 if i < 10 else 2) for i in range(300)] + [("de", 0, f"v{i}", 1) for i in range(40)]
    kept = langid._top(spark.createDataFrame(rows, "lang string, n int, item string, count long"), F.lit(100)).collect()
    by = Counter(r.lang for r in kept)
    assert by["de"] == 40 and 80 <= by["en"] <= 100 and sum(r["count"] == 5 for r in kept) == 10


@pytest.mark.parametrize("name", ["score", "held_out", "lang_pred", "predicted"])
def test_clashing_columns_of_learned_operators(spark, name):
    docs = spark.createDataFrame([(i, f"the river stone {i}", "en", "x") for i in range(30)], f"doc_id long, text string, lang string, {name} string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert langid.identify(docs, langid.train(docs)).count() == 30
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 30


# ---- op10


def test_propagation_against_a_dense_matrix(spark):
    rng = random.Random(6)
    hosts = [f"h{i}.org" for i in range(24)]
    edges = {(a, b): rng.randint(1, 5) for a in hosts for b in rng.sample(hosts, rng.randint(0, 4)) if a != b}
    seeds = {h: rng.random() for h in rng.sample(hosts, 6)}
    n, at = len(hosts), {h: i for i, h in enumerate(hosts)}
    share = np.zeros((n, n))
    for (a, b), k in edges.items():
        share[at[a], at[b]] = k
    share = np.divide(share, share.sum(axis=1, keepdims=True), out=np.zeros_like(share), where=share.sum(axis=1, keepdims=True) > 0)
    base = np.zeros(n)
    for h, v in seeds.items():
        base[at[h]] = (1 - url_filter.DAMPING) * v
    given = spark.createDataFrame([(a, b, k) for (a, b), k in edges.items()], "src string, dst string, n long")
    start = spark.createDataFrame(list(seeds.items()), "host string, seed double")
    for back in (False, True):
        step = share if back else share.T
        want = np.linalg.solve(np.eye(n) - url_filter.DAMPING * step, base)
        got = {r.host: r.score for r in url_filter.propagate(start, given, back=back).collect()}
        assert all(abs(got.get(h, 0.0) - want[at[h]]) < 1e-4 for h in hosts), back
