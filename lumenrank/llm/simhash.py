"""SimHash near-duplicates through one-wildcard deletion variants of segments.

Fingerprint. A-Z lower-cased words, ``width``-word shingles (repeats count, a
shorter text is one shingle, a text without words has fingerprint zero), XXH64
with seed 42 of each shingle; a bit is set if it is set in over half the hashes.

Links. Two fingerprints that differ in at most ``max_bits`` bits have, among
``segments(max_bits)`` segments, one that differs by at most one bit. So each
distinct fingerprint is indexed under every segment with one bit wiped out (64
keys), and fingerprints that share a key meet by an equality shuffle and are
verified on all 64 bits. Every linked pair meets; no pair is made up.

Hot keys. Equal fingerprints collapse before the index, so copies never meet. A
bucket gives a star of its verified components, n - 1 rows and not n * n. A
bucket above ``BUCKET`` fingerprints isn't held by its task: its rows pass
through, and a second shuffle spreads them over pairs of blocks of bounded size.

Defined cases: a null text is empty; empty texts share fingerprint zero and so
are one group; a null ``doc_id`` belongs to its group but never names it; rows
that repeat an id are single nodes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_name, one_row_of, ship, text_or_empty
from .components import connected_components

SEED = 42
#: Fingerprints of one key that a task compares at once; larger buckets go to block pairs.
BUCKET = 1024
#: Verified pairs that a task holds before it folds them into components.
PAIRS = 1 << 16
#: Fingerprints that one task turns into index rows (64 each), and about as many whose rows one task compares.
PART = 8192
#: Texts of one min-hash key that a task holds as one block, of two at a time.
GROUP = 256
#: Min-hash keys of a text and minima in each: of pairs with similarity 0.8, (1 - 0.8**6)**25 = 0.05 % share none.
BANDS, BAND_ROWS = 25, 6
_ODD, _ADD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
_ODD |= np.uint64(1)


def hashes_of(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z, and \x20 \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    take = min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    whole, stops, digest = b" ".join(words), (ends - 1).tolist()[take - 1 :], xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_of(text: str | None, width: int) -> int:
    return bits_of(hashes_of(text, width))


def fingerprint(text: Column, width: int) -> Column:
    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, width) for t in texts], dtype="int64")

    return compute(text)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the fewest segments of which one differs by at most one bit."""
    n = max_bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variant_keys(fp: Column, max_bits: int) -> Column:
    """The 64 keys of a fingerprint: the wiped bit's number in the top byte, and its segment without that bit."""
    keys = []
    for low, bits in segments(max_bits):
        seg = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))
        for bit in range(bits):
            rest = seg.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << bit)))
            keys.append(F.lit((low + bit) << 56).cast("long").bitwiseOR(rest))
    return F.array(*keys)


def _contracted(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of the components that links (a, b) and the links behind ``label`` make together."""
    while True:
        before = label
        low = np.minimum(label[a], label[b])
        label = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            return label


def _stars(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the verified components in each run of equal keys.

    Verified pairs are folded into labels every ``PAIRS`` of them, so memory follows
    the rows and not their pairs, of which near copies have a square number.
    """
    n = len(key)
    label = np.arange(n)
    left, right, held = [], [], 0
    first, step = np.arange(n - 1), 1
    while len(first):
        first = first[first + step < n]
        first = first[key[first] == key[first + step]]
        far = first[label[first] != label[first + step]]
        near = far[np.bitwise_count((fp[far] ^ fp[far + step]).view(np.uint64)) <= max_bits]  # signed counts take absolute values
        left.append(near)
        right.append(near + step)
        held += len(near)
        if held >= PAIRS:
            label = _contracted(label, np.concatenate(left), np.concatenate(right))
            left, right, held = [], [], 0
        step += 1
    if held:
        label = _contracted(label, np.concatenate(left), np.concatenate(right))
    moved = np.nonzero(label != np.arange(n))[0]
    return fp[moved], fp[label[moved]]


def _meet(max_bits: int, most: int | None):
    """A pass over rows (key, fp) sorted by key.

    Rows out are u, v, key: links (u, v) with a null key from buckets of up to
    ``most`` rows (all buckets if None), and (fp, fp, key) for the rows of larger
    ones. Only the open bucket is held between batches, and never over ``most``.
    """

    def batch(u, v, key) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(key, pa.int64())], names=["u", "v", "key"])

    def whole_buckets(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if most is not None:
            _, n = np.unique(key, return_counts=True)
            large = np.repeat(n > most, n)
            if large.any():
                yield batch(fp[large], fp[large], key[large])
                key, fp = key[~large], fp[~large]
        u, v = _stars(key, fp, max_bits)
        if len(u):
            yield batch(u, v, np.ma.masked_all(len(u), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, passing = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for x in batches:
            key = np.concatenate((key, x.column(0).to_numpy()))
            fp = np.concatenate((fp, x.column(1).to_numpy()))
            if passing is not None:  # the first bucket is too large, and its rows go on as they come
                end = int(np.searchsorted(key, passing, side="right"))
                if end:
                    yield batch(fp[:end], fp[:end], key[:end])
                key, fp = key[end:], fp[end:]
            if not len(key):
                continue
            passing = None
            done = int(np.searchsorted(key, key[-1]))
            yield from whole_buckets(key[:done], fp[:done])
            key, fp = key[done:], fp[done:]
            if most is not None and len(key) > most:
                passing = key[0]
                yield batch(fp, fp, key)
                key, fp = key[:0], fp[:0]
        yield from whole_buckets(key, fp)

    return run


def links_of(fps: DataFrame, max_bits: int, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ``fps`` within ``max_bits`` bits."""
    parts = -(-fps.count() // PART) + 1
    # A number of its own for both shuffles: sizes on disk would put all of these short rows in a few tasks.
    keyed = fps.repartition(parts, "fp").select(F.explode(variant_keys(F.col("fp"), max_bits)).alias("key"), "fp")
    schema = "u long, v long, key long"
    met = cut(keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_meet(max_bits, bucket), schema))
    links, hot = met.filter("key is null").select("u", "v"), met.filter("key is not null").select("key", F.col("u").alias("fp"))
    sizes = cut(hot.groupBy("key").agg(F.ceil(F.count("*") / bucket).cast("int").alias("blocks")))
    if not sizes.take(1):
        return links
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    spread = (
        hot.join(sizes, "key")
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "fp")
    )
    blocks = spread.repartition("pair").sortWithinPartitions("pair").mapInArrow(_meet(max_bits, None), schema)
    return links.unionByName(cut(blocks).select("u", "v"))


def decide(docs: DataFrame, width: int = 5, max_bits: int = 4, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (the least id reachable)."""
    ship(docs.sparkSession)
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), width).alias("fp")))
    reps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = connected_components(links_of(reps.select("fp"), max_bits, bucket))
    placed = reps.join(parts, reps["fp"] == parts["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rows.join(placed.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _one_of_each(docs: DataFrame, rows: DataFrame, roots: DataFrame, by: str, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that head their group: least id, nulls last, then least text hash.

    ``rows``: doc_id, mark and the column ``by``; ``roots`` (node, root) has a row for
    each value of ``by`` that has a link. Groups are told apart by their root, never by an id.
    """
    head, mark = fresh_name("head"), fresh_name("mark")
    placed = rows.join(roots, rows[by] == roots["node"], "left").select("doc_id", "mark", F.coalesce("root", by).alias("root"))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("h"))
    heads = cut(first.select(F.col("h.doc_id").alias(head), F.col("h.mark").alias(mark)))
    marked = docs.select("*", mark_of(text_col).alias("mark_" + mark))
    mine = (F.col("mark_" + mark) == heads[mark]) & marked[f"`{id_col}`"].eqNullSafe(heads[head])
    stay = marked.join(heads, mine, "left_semi")
    repeated = rows.groupBy("doc_id", "mark").count().filter("count > 1").select(F.col("doc_id").alias(head), F.col("mark").alias(mark))
    repeated = cut(repeated)
    if not repeated.take(1):
        return stay.drop("mark_" + mark)
    again = (F.col("mark_" + mark) == repeated[mark]) & marked[f"`{id_col}`"].eqNullSafe(repeated[head])
    once = one_row_of(stay.join(repeated, again, "left_semi"), [id_col, "mark_" + mark])
    return stay.join(repeated, again, "left_anti").unionByName(once).drop("mark_" + mark)


def mark_of(text_col: str) -> Column:
    """A 64-bit hash of the whole text, which tells rows with one id apart."""
    return F.xxhash64(text_or_empty(text_col))


def deduplicate(docs: DataFrame, width: int = 5, max_bits: int = 4, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the least id; all columns stay.

    Rows without an id head a group only if no row of it has one. Rows that share an
    id are told apart by their texts, and of rows that share both, the one with the least hash of its columns is kept.
    """
    ship(docs.sparkSession)
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), mark_of(text_col).alias("mark"), fingerprint(F.col(text_col), width).alias("fp")))
    roots = connected_components(links_of(rows.select("fp").distinct(), max_bits, bucket))
    return _one_of_each(docs, rows, roots, "fp", id_col, text_col)


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys: each a hash of ``BAND_ROWS`` minima of the shingle hashes under fixed random maps."""
    if not len(hashes):
        return np.arange(BANDS, dtype=np.int64)
    least = np.full((BANDS * BAND_ROWS, 1), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[at : at + 512] * _ODD + _ADD).min(axis=1, keepdims=True))
    rows = np.ascontiguousarray(least.reshape(BANDS, BAND_ROWS))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], dtype=np.uint64).view(np.int64)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes; empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _alike(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of ``pairs`` (u, v) of marks, those whose texts (mark, text) have at least this similarity."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([similarity_of(np.unique(hashes_of(a, width)), np.unique(hashes_of(b, width))) >= similarity for a, b in zip(left, right)], dtype="bool")

    side = lambda end: texts.select(F.col("mark").alias(end), F.col("text").alias(f"text_{end}"))
    met = pairs.join(side("u"), "u").join(side("v"), "v")
    return cut(met.filter(alike("text_u", "text_v")).select("u", "v"))


def deduplicate_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bits: int = 4, bucket: int = BUCKET, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``deduplicate``, but texts are linked if their ``width``-word shingle sets have this Jaccard similarity.

    Candidates are the links of SimHash fingerprints and texts that share one of
    ``BANDS`` min-hash keys, for at similarity 0.8 two fingerprints differ in some
    ten of 64 bits, which no few segments of them can find. All candidates are
    verified exactly. First the texts of each key are held against its least one;
    then, in keys whose texts aren't one component yet, all are compared within a task,
    by their rarest shingles. So every two of a key are compared or within one
    component, no pairs of a group are written, and a large group of near copies costs a star for each key.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("fp long, bands array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        got = [(bits_of(h), bands_of(np.unique(h))) for h in (hashes_of(t, width) for t in texts)]
        return pd.DataFrame({"fp": pd.Series([x[0] for x in got], dtype="int64"), "bands": pd.Series([x[1] for x in got], dtype="object")})

    rows = cut(docs.select(F.col(id_col).alias("doc_id"), mark_of(text_col).alias("mark"), sketch(text_col).alias("s")).select("doc_id", "mark", "s.fp", "s.bands"))
    nodes = rows.groupBy("mark").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    reps = cut(nodes.groupBy("fp").agg(F.min("mark").alias("rep"), F.count("*").alias("n")))
    keyed = cut(nodes.select(F.explode("bands").alias("key"), "mark"))
    least = cut(keyed.groupBy("key").agg(F.min("mark").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first"))
    shared = cut(keyed.join(least, "key"))
    # Links of fingerprints and texts with one fingerprint are candidates as well.
    same = nodes.select("fp", "mark").join(reps.filter("n > 1").select("fp", "rep"), "fp").select(F.col("mark").alias("u"), F.col("rep").alias("v"))
    near = links_of(reps.select("fp"), max_bits, bucket)
    end = lambda a, b: reps.select(F.col("fp").alias(a), F.col("rep").alias(b))
    near = near.join(end("u", "ru"), "u").join(end("v", "rv"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    pairs = shared.select(F.col("mark").alias("u"), F.col("first").alias("v")).unionByName(same).unionByName(near)
    pairs = cut(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    wanted = shared.select("mark").unionByName(pairs.select(F.explode(F.array("u", "v")).alias("mark"))).distinct()
    texts = docs.select(mark_of(text_col).alias("mark"), text_or_empty(text_col).alias("text")).join(wanted, "mark", "left_semi").dropDuplicates(["mark"])
    links = _alike(pairs, texts, width, similarity)
    parts = cut(connected_components(links))
    placed = cut(shared.join(parts, shared["mark"] == parts["node"], "left").select("key", "mark", F.coalesce("root", "mark").alias("root")))
    split = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
    open_ = cut(placed.join(split, "key", "left_semi"))
    if not open_.take(1):
        return _one_of_each(docs, rows, parts, "mark", id_col, text_col)
    more = _links_within(open_, texts, width, similarity, group)
    # The components so far stand for their links, so few rounds are left.
    roots = connected_components(parts.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    return _one_of_each(docs, rows, roots, "mark", id_col, text_col)


def alike_links(marks: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the sets of at least this Jaccard similarity, beside those that ``roots`` joins already.

    Two such sets share one of their rarest hashes: of a set of n, of the n - similarity * n + 1
    that fewest sets hold. So sets meet over those alone, and one that differs in size too much,
    or is in the same component by now, isn't compared.
    """
    first: dict[int, int] = {}
    parent = [first.setdefault(int(r), i) for i, r in enumerate(roots)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    every, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    holders: dict[int, list[int]] = {}
    links = []
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(marks[i]))):
        own, n = sets[i], len(sets[i])
        n_of = counts[np.searchsorted(every, own)]
        rare = np.lexsort((own, n_of))[: n - int(np.ceil(similarity * n - 1e-9)) + 1] if n else np.zeros(0, np.int64)
        met = set()
        for h in own[rare][n_of[rare] > 1].tolist():
            held = holders.setdefault(h, [])
            met.update(held)
            held.append(i)
        for j in met:
            if len(sets[j]) >= similarity * n - 1e-9 and find(i) != find(j) and similarity_of(own, sets[j]) >= similarity:
                links.append((int(marks[i]), int(marks[j])))
                parent[find(i)] = find(j)
    return links


def _links_within(open_: DataFrame, texts: DataFrame, width: int, similarity: float, group: int) -> DataFrame:
    """Links (u, v) of the texts that share a key and aren't one component: every two of a key are compared within a task, and no pairs are written.

    ``open_``: key, mark, root. Keys of more than ``group`` texts go to pairs of blocks, so that a task holds two blocks at most.
    """

    @F.pandas_udf("binary")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.unique(hashes_of(t, width)).tobytes())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def joined(part: pd.DataFrame) -> pd.DataFrame:
            found = alike_links(part["mark"].to_numpy(), part["root"].to_numpy(), [np.frombuffer(h, np.uint64) for h in part["h"]], similarity)
            return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

        held = None
        for x in frames:
            x = x if held is None else pd.concat([held, x], ignore_index=True)
            last = x["pair"].iloc[-1] if len(x) else None
            for _, part in x[x["pair"] != last].groupby("pair", sort=False):
                yield joined(part)
            held = x[x["pair"] == last]
        if held is not None and len(held):
            yield joined(held)

    sizes = open_.groupBy("key").agg(F.ceil(F.count("*") / group).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int")
    dealt = (
        open_.join(sizes, "key")
        .select("key", "mark", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "mark", "root")
    )
    sets = texts.join(open_.select("mark").distinct(), "mark", "left_semi").select("mark", hashes("text").alias("h"))
    spread = dealt.join(cut(sets), "mark").repartition("pair").sortWithinPartitions("pair")
    return cut(spread.select("pair", "mark", "root", "h").mapInPandas(run, "u long, v long").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
