"""Vector codes: product quantisation with a vantage-point tree over each part's codebook.

Codes. A component x becomes the integer floor(256 * x). Vectors are cut into
``PARTS`` equal parts, and each part position has a codebook that starts as that
part of the ``ENTRIES`` rows with the least ids. Each round assigns every part to its
nearest entry (squared Euclidean distance, ties to the lower index) and replaces
an entry by the floored mean of its parts.

Search. The entries of a part position form a vantage-point tree. Branch and bound
over it visits a side unless the triangle inequality rules it out: distances and
radii are rounded outwards by more than a square root's error, and a side at exactly the bound
is visited, so ties are met. What counts in the end are exact integer distances.
The rows of an Arrow batch go down the tree together.

Spark. Training is one job a round: each task adds up its rows by (part, entry),
the sums meet in one aggregate of at most PARTS * ENTRIES rows, and only those
reach the driver. A hot vector or label is added up before any shuffle.

Defined cases: rows whose vector is null, empty, not divisible into the parts, or
holds a null or non-finite component are dropped, and so are vectors of another
length than that of the least id; ``LIMIT`` bounds a component, larger ones count as it; with fewer rows than
entries the codebooks are smaller; rows that repeat are rows of their own; a null id
comes last; an empty table has no codebooks and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components stay within this, so that a squared distance of 2^10 components fits 64 bits.
LIMIT = 1 << 25
#: Entries of a leaf of the tree.
LEAF = 4
#: By this share distances are rounded outwards.
SLACK = 1e-12
#: Distinct labels whose sums are broadcast at most; beyond that they are joined by salted keys.
LABELS, SALTS = 100_000, 32


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, one row each."""
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


@dataclass
class Node:
    """A vantage entry, the others on either side of its median distance; or a leaf."""

    indexes: np.ndarray
    radius: tuple[float, float] = (0.0, 0.0)
    inside: Node | None = None
    outside: Node | None = None


def build(entries: np.ndarray, indexes: np.ndarray | None = None) -> Node:
    indexes = np.arange(len(entries)) if indexes is None else indexes
    if len(indexes) <= LEAF:
        return Node(indexes)
    # The entry that is farthest from the mean sees the others at the most varied distances.
    own = entries[indexes].astype(float)
    vantage = int(np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1)))
    rest = np.delete(indexes, vantage)
    d = squared(entries[indexes[vantage]][None], entries[rest])[0]
    order = np.argsort(d, kind="stable")
    half = len(rest) // 2
    near, far = order[:half], order[half:]
    root = np.sqrt([float(d[near].max()), float(d[far].min())])
    radius = float(root[0] * (1 + SLACK)), float(root[1] * (1 - SLACK))
    return Node(indexes[[vantage]], radius, build(entries, rest[near]), build(entries, rest[far]))


def nearest(tree: Node, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of each row, the lower one of a tie, and its squared distance."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    index = np.full(len(x), len(entries))

    def meet(at: int, rows: np.ndarray, d: np.ndarray) -> None:
        better = (d < best[rows]) | ((d == best[rows]) & (at < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], at

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        d = squared(x[rows], entries[node.indexes])
        for k, at in enumerate(node.indexes):
            meet(int(at), rows, d[:, k])
        if node.inside is None:
            return
        root = np.sqrt(d[:, 0].astype(float))
        low, high = root * (1 - SLACK), root * (1 + SLACK)
        first = low <= node.radius[0]
        visit(node.inside, rows[first])
        visit(node.outside, rows[~first])
        reach = np.sqrt(best[rows].astype(float)) * (1 + SLACK)
        visit(node.outside, rows[first & (high + reach >= node.radius[1])])
        visit(node.inside, rows[~first & (low - reach <= node.radius[0])])

    visit(tree, np.arange(len(x)))
    return index, best


@dataclass
class Codebooks:
    """The entries of each part position: parts x entries x length of a part, integers."""

    entries: np.ndarray
    trees: list[Node] = field(default_factory=list)

    def __post_init__(self):
        self.trees = [build(e) for e in self.entries]

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of integer vectors, the codes (rows x parts) and the squared distances summed over parts."""
        parts = x.reshape(len(x), len(self.entries), -1)
        found = [nearest(t, e, np.ascontiguousarray(parts[:, p])) for p, (t, e) in enumerate(zip(self.trees, self.entries))]
        return np.stack([f[0] for f in found], axis=1), np.sum([f[1] for f in found], axis=0)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column, parts: int) -> Column:
    """Neither null nor empty, divisible into the parts, and finite in every component."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(finite & (F.size(vector) > 0) & (F.size(vector) % parts == 0), F.lit(False))


def integers(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return np.clip(np.floor(x * SCALE), -LIMIT, LIMIT).astype(np.int64)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks | None:
    """Codebooks from all usable rows; None without any."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(usable(F.col(vector_col), parts))
    order = F.col("id").asc_nulls_last(), F.col("vector")
    least = rows.orderBy(*order).limit(1).collect()
    if not least:
        return None
    width = len(least[0]["vector"])
    rows = rows.filter(F.size("vector") == width)
    seeds = np.array([r["vector"] for r in rows.orderBy(*order).limit(entries).collect()], dtype=float)
    seeds = np.clip(np.floor(seeds * SCALE), -LIMIT, LIMIT).astype(np.int64)
    books = Codebooks(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = Codebooks(_updated(rows, books))
    return books


def _updated(rows: DataFrame, books: Codebooks) -> np.ndarray:
    parts, entries, length = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, length), np.int64)
        for batch in batches:
            x = integers(batch.column("vector"), books.width)
            codes, _ = books.assign(x)
            for p in range(parts):
                np.add.at(counts[p], codes[:, p], 1)
                np.add.at(sums[p], codes[:, p], x.reshape(len(x), parts, length)[:, p])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    partial = rows.select("vector").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(length)])
    new = books.entries.copy()
    for r in total.collect():  # at most parts * entries rows
        new[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(length)]
    return new


def compress(vectors: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("vec_id", "label"), vector_col: str = "embedding") -> DataFrame:
    """The columns ``keep``, ``codes`` (binary, one byte for each part) and ``error`` of every usable row."""
    ship(vectors.sparkSession)
    fits = usable(F.col(vector_col), len(books.entries)) & (F.size(vector_col) == books.width)
    names = [f"kept_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = books.assign(integers(batch.column("vector"), books.width))
            packed = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], packed, pa.array(error)], [*names, "codes", "error"])

    kinds = [f"{n} {vectors.schema[c].dataType.simpleString()}" for n, c in zip(names, keep)]
    rows = vectors.filter(fits).select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(vector_col).alias("vector"))
    out = rows.mapInArrow(run, ", ".join([*kinds, "codes binary", "error long"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "codes", "error")


def decompress(codes: DataFrame, books: Codebooks) -> DataFrame:
    """All columns of ``codes`` and ``vector``: the middle of the cells of each part's entry."""
    tables = F.array(*[F.array(*[F.array(*[F.lit((v + 0.5) / SCALE) for v in e]) for e in part]) for part in books.entries.tolist()])
    digit = lambda p: F.conv(F.hex(F.substring("codes", p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.array(*[tables[p][digit(p)] for p in range(len(books.entries))])))


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``label_error``: ``error`` summed over the rows of a label; nulls are one label."""
    coded = cut(coded)
    sums = coded.groupBy(F.col(label_col).alias("__label")).agg(F.sum("error").alias("label_error"))
    if sums.limit(LABELS + 1).count() <= LABELS:
        return coded.join(F.broadcast(sums), coded[label_col].eqNullSafe(sums["__label"])).drop("__label")
    sums = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("__row_salt", F.pmod(F.xxhash64("codes", "error", *[c for c in coded.columns if c not in ("codes", "error")]), F.lit(SALTS)).cast("int"))
    return dealt.join(sums, dealt[label_col].eqNullSafe(sums["__label"]) & (dealt["__row_salt"] == sums["__salt"])).drop("__label", "__salt", "__row_salt")


def decide(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error, codebooks_sha256 of every usable row."""
    books = train(vectors)
    if books is None:
        return vectors.filter(F.lit(False)).select("vec_id", *[F.lit(None).cast(k).alias(c) for c, k in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    coded = with_label_error(compress(vectors, books))
    return coded.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
