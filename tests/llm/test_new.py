"""Vector codes, packing and importance resampling against plain versions."""

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenrank.llm import bpe, merges, packing, queries, resampling, units, vector_codes

SF = "/root/testdata/sf0.001"
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


def library():
    tool = Tokenizer.from_file(TOKENIZER)
    tool.no_truncation()
    tool.no_padding()
    return tool


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_resampling"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ---- op11


def plain_nearest(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(entries))


def plain_codes(vectors, parts, entries, rounds):
    ints = [[math.floor(256 * c) for c in v] for v in vectors]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            own = [plain_nearest(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(c[p][j] for c, o in zip(cut, own) if o == i) // own.count(i) for j in range(w)] if i in own else e for i, e in enumerate(books[p])]
    found = [[plain_nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [("".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for f in found], books


@pytest.mark.parametrize("scale", [1, 200])
def test_codes_equal_a_plain_search(spark, scale):
    """Small integers make many ties; entries repeat."""
    rng = np.random.default_rng(scale)
    vectors = (rng.integers(-3, 4, (400, 32)) * scale / 256).tolist()
    vectors[5] = vectors[3]
    df = spark.createDataFrame([(i, v, i % 3 or None) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    books = vector_codes.train(df)
    got = {r.vec_id: r for r in vector_codes.decide(df.repartition(5)).collect()}
    want, plain = plain_codes(vectors, 16, 64, 2)
    assert books.entries.tolist() == plain
    assert [(got[i].code, got[i].error) for i in range(400)] == want
    by = Counter()
    for i, (_, e) in enumerate(want):
        by[i % 3 or None] += e
    assert all(got[i].label_error == by[i % 3 or None] for i in range(400))
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(",".join(str(x) for part in plain for e in part for x in e).encode()).hexdigest()}


def test_tree_search_is_exact_and_prunes(monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.integers(-2000, 2000, (8, 4))
    entries = (centres[rng.integers(0, 8, 64)] + rng.integers(-9, 10, (64, 4))).astype(np.int64)
    entries[40] = entries[11]
    x = np.concatenate([entries + rng.integers(-2, 3, (64, 4)) for _ in range(20)])
    met, plain = [], vector_codes.squared
    monkeypatch.setattr(vector_codes, "squared", lambda a, b: (met.append(len(a) * len(b)), plain(a, b))[1])
    index, d = vector_codes.nearest(vector_codes.build(entries), entries, x)
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert sum(met) < 0.6 * every.size


def test_vectors_that_do_not_count(spark):
    fine = [0.5] * 32
    rows = [(1, None, 1), (2, [], 1), (3, [float("nan")] + fine[1:], 1), (4, [None] + fine[1:], 1), (5, [float("-inf")] + fine[1:], 1), (6, fine, None), (6, fine, None), (7, fine * 2, 1), (8, fine[:31], 1), (None, fine, None), (9, [3e38] + fine[1:], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"code": F.lit(1), "error": F.lit("x"), "id": F.lit(0), "vector": F.lit(2)})
    got = vector_codes.decide(df).collect()
    assert sorted((r.vec_id or 0, r.label_error) for r in got) == [(0, 0), (6, 0), (6, 0), (9, 0)]
    assert vector_codes.decide(df.filter("vec_id < 4")).collect() == []


def test_labels_beyond_the_broadcast_and_decompression(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = sorted(map(tuple, vector_codes.decide(df).collect()))
    monkeypatch.setattr(vector_codes, "LABELS", 1)
    assert sorted(map(tuple, vector_codes.decide(df).collect())) == want
    books = vector_codes.train(df)
    back = vector_codes.decompress(vector_codes.compress(df, books), books).join(df.select("vec_id", "embedding"), "vec_id").collect()
    rows = [(np.array(r.vector), np.array(r.embedding), r.error) for r in back]
    assert all(abs(((a - b) ** 2).sum() * 256**2 - e) < 64 + 2 * 64**0.5 * e**0.5 for a, b, e in rows), "within half a cell of each component"


# ---- op12


def test_hilbert_keys_visit_neighbouring_cells():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    along = cells[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_units_equal_the_library():
    tool, fast = library(), units.Units(TOKENIZER, merges.merges_agree(TOKENIZER))
    assert fast.base.words is not None
    odd = ["it's don't 's x's, y'll. a.b. 3.14, 5% #tag, (foo) foo) foo'] bar`` é… éa!! ÀB?! <|endoftext|> a<b c> x_y_ _z  n ! k̈.. Œu, ß? İ. æ!~ 10×, ÷! ÷", "", " ", "a" * 3000 + "!", "漢字, 漢字!! ひ。 1! ½! Ⅷ.", "x y! z. \x85q\x1c r", "é! ́a."]
    texts = odd + ["".join(chr(c) for c in np.random.default_rng(i).choice([*range(9, 127), *range(160, 400), 0x300, 0x4E00], 300)) for i in range(60)]
    assert [list(array("I", x)) for x in fast.encode(texts)] == [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]
    assert not merges.merges_agree(str(public_tokenizers.path("byte_bpe_50k.json")))


DOCS = [(1, "one two three"), (2, None), (3, ""), (None, "no id"), (5, "long words here " * 4000), (6, "same text"), (6, "same text"), (7, "same text"), (8, " \t\n"), (9, "ÀÉ 漢字 \U0001f600 <|endoftext|>")]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, capacity):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"ids": F.lit(1), "part": F.lit("x"), "offset": F.lit(2)})
    tool = library()
    want = Counter((i, tuple(tool.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in DOCS)
    pieces = packing.pack(docs.repartition(3), capacity)
    rows = pieces.collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) // 4 > 0
    lengths = []
    for k in range(len(sequences)):
        at = 0
        for r in sorted(sequences[k], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        lengths.append(at)
    assert all(n == capacity for n in lengths if n & (n - 1)) and max(lengths) <= capacity
    # the stream of all sequences is the documents, one after the other
    stream = [r for k in sorted(sequences) for r in sorted(sequences[k], key=lambda r: r.offset)]
    got, ids = Counter(), b""
    for r in stream:
        assert r.start == len(ids) // 4
        ids += r.ids
        if len(ids) // 4 == r.doc_tokens:
            got[r.doc_id, tuple(array("I", ids))] += 1
            ids = b""
    assert got == want
    joined = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert {k: len(r.ids) // 4 for k, r in joined.items()} == dict(enumerate(lengths))
    crc = packing.digests(pieces).select("doc_id", "start", "ids_crc32").collect()
    assert Counter(map(tuple, crc)) == Counter((r.doc_id, r.start, zlib.crc32(r.ids)) for r in rows)
    assert packing.pack(docs.limit(0)).collect() == []


def test_alike_documents_are_packed_near_each_other(spark):
    rng = np.random.default_rng(3)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(6)]
    rows = [(i, i % 6, " ".join(rng.choice(topics[i % 6], 60))) for i in range(240)]
    placed = packing.pack(spark.createDataFrame(rows, "doc_id long, topic int, text string"), 1 << 30).orderBy("sequence_id", "offset").select("doc_id").distinct().collect
    order = [r.doc_id for r in packing.pack(spark.createDataFrame(rows, "doc_id long, topic int, text string")).filter("start = 0").orderBy("sequence_id", "offset").collect()]
    same = sum(a % 6 == b % 6 for a, b in zip(order, order[1:]))
    assert len(order) == 240 and same > 0.6 * 239 and len(placed()) == 240


# ---- op13


def plain_resample(docs, target, max_n, percent, buckets=10_000):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})

    def features(text):
        ws = word.findall(lower(text))
        return ws, [" ".join(ws[i : i + n]) for n in range(1, max_n + 1) for i in range(len(ws) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    total = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total[0] + buckets) / ((s[b] + 1) * (total[1] + buckets))))
    out = []
    for i, text in docs:
        ws, fs = features(text)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = len(able) * percent // 100
    ranks = {id(r): n for n, r in enumerate(able[:drawn], 1)}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


@pytest.mark.parametrize("max_n, heavy", [(1, 1 << 19), (1, 8), (2, 8), (3, 1 << 19)])
def test_resampling_equals_plain(spark, monkeypatch, max_n, heavy):
    monkeypatch.setattr(resampling, "HEAVY", heavy)
    rng = np.random.default_rng(max_n)
    vocabulary = [f"w{i}" for i in range(200)] + ["the", "a", "Of", "é", "漢字", "x9"] * 15
    docs = [(i, ", ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(120)] + [(200, None), (201, ""), (None, "the " * 30), (5, "the " * 25), (202, "w" * 5000), (203, "...")]
    docs += [docs[7], docs[7]]
    target = [" ".join(rng.choice(vocabulary[:40], 30)) for _ in range(10)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit("k"), "word": F.lit(1), "gain": F.lit(0.5)})
    got = resampling.resample(df.repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), percent=30, max_n=max_n).collect()
    assert Counter(map(tuple, got)) == plain_resample(docs, target, max_n, 30)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resample(docs, one).collect() == []
    assert [r.n_features for r in resampling.resample(one, docs).collect()] == [2]


def test_words_encode_as_in_the_bpe_operator():
    text = "Some, words. and (more) words!\n" * 30
    assert units.Units(TOKENIZER, True).encode([text]) == bpe.Encoder(TOKENIZER).encode([text])
