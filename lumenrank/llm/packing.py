"""Packing token sequences along a space-filling curve.

Order. The token ids of a document are counted in ``BUCKETS`` hashed buckets, and
that vector, centred and of unit length, is projected to ``AXES`` dimensions by
fixed random directions. Each coordinate becomes one of 2^``BITS`` cells, and the
cells' place on the Hilbert curve is the document's key. Rows are range-sorted by
it, so neighbours on the curve, which are alike in their words, are packed next to each other.

Packing. All documents in that order, each with the end token, are one stream,
cut every ``capacity`` tokens. So only the very end could need padding, and that
is cut into sequences whose lengths are powers of two: nothing is padded.

Spark. Documents are encoded once and written (key and ids); the sorted rows are
written with the number of tokens before them in their partition; only the
partitions' totals, one number each, meet on the driver. Pieces then come from a scan.
Both tables lie in the shared checkpoint folder, the first one until the second is written. Equal
keys are told apart by doc_id and ids, so copies don't crowd a partition.

Defined cases: a null text is empty and is its end token alone; rows that repeat
are packed as often as they occur; a null doc_id is carried; an empty table gives
no pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .common import ensure_checkpoint_dir, remove, ship, text_or_empty
from .merges import merges_agree
from .units import units

CAPACITY = 4096
#: The token after each document.
END_ID = 2
BUCKETS, AXES, BITS = 512, 4, 12
#: Standard deviations that the cells of an axis cover on either side.
REACH = 3.0
SEED = 12
#: Documents encoded together.
SLICE = 512


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of non-negative integers below 2^bits (Skilling's transform)."""
    x = [c.astype(np.int64) for c in np.asarray(cells).T]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ flip) >> b) & 1)
    return key


def curve_keys(documents: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document's hashed vector of token counts."""
    directions = np.random.default_rng(SEED).standard_normal((BUCKETS, AXES))
    at = [(d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS for d in documents]
    v = np.log1p(np.stack([np.bincount(a, minlength=BUCKETS) for a in at]))
    v -= v.mean(axis=1, keepdims=True)
    length = np.linalg.norm(v, axis=1, keepdims=True)
    z = (v / np.where(length > 0, length, 1)) @ directions
    cells = np.clip((z + REACH) * ((1 << BITS) / (2 * REACH)), 0, (1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.int64), BITS)


def coded(docs: DataFrame, path: str | None, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, curve, tokens, ids (binary; 16-bit integers where all of them fit, else ``wide``)."""
    ship(docs.sparkSession)
    fast = merges_agree(tokenizer_path(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = units(path, fast)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                ids = [np.frombuffer(b + end, dtype="<u4") for b in tool.encode(part.column("text").to_pylist())]
                wide = [bool(i.max() >= 1 << 16) for i in ids]
                packed = [(i if w else i.astype("<u2")).tobytes() for i, w in zip(ids, wide)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(curve_keys(ids)), pa.array([len(i) for i in ids], pa.int64()), pa.array(wide), pa.array(packed, pa.binary())], ["doc_id", "curve", "tokens", "wide", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, curve long, tokens long, wide boolean, ids binary")


def placed(rows: DataFrame) -> DataFrame:
    """The rows in order, with their partition and the tokens before them in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for x in batches:
            tokens = x.column("tokens").to_numpy()
            ends = before + np.cumsum(tokens)
            more = [pa.array(np.full(len(x), part, dtype=np.int64)), pa.array(ends - tokens)]
            yield pa.RecordBatch.from_arrays([*x.columns, *more], [*x.schema.names, "part", "before"])
            before = int(ends[-1]) if len(x) else before

    tie = F.xxhash64("ids")
    ordered = rows.repartitionByRange("curve", "doc_id", tie).sortWithinPartitions("curve", "doc_id", tie)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"doc_id {kind}, curve long, tokens long, wide boolean, ids binary, part long, before long")


def tails(total: int, capacity: int) -> list[int]:
    """Where the sequences after the last whole one start, and the end: powers of two that add up to what is left."""
    left = total % capacity
    lengths = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    return [total - left, *accumulate(lengths, initial=total - left)][1:]


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/packing-{uuid.uuid4().hex}"
    coded(docs, path, end_id, id_col, text_col).write.option("compression", "zstd").parquet(f"{folder}/coded")
    placed(spark.read.parquet(f"{folder}/coded")).write.option("compression", "zstd").parquet(f"{folder}/placed")
    remove(spark, f"{folder}/coded")
    rows = spark.read.parquet(f"{folder}/placed")
    sums = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}  # one number for each partition
    first, total = {}, 0
    for part in sorted(sums):
        first[part] = total
        total += sums[part]
    ends = tails(total, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array(ends)
        for x in batches:
            of, out = [], []
            for i, (n, wide, data, part, before) in enumerate(zip(*[x.column(c).to_pylist() for c in ("tokens", "wide", "ids", "part", "before")])):
                ids = np.frombuffer(data, dtype="<u4" if wide else "<u2").astype("<u4", copy=False)
                start, at = 0, first[part] + before
                while start < n:
                    if at < last[0]:
                        sequence, offset = divmod(at, capacity)
                        room = capacity - offset
                    else:
                        k = int(np.searchsorted(last, at, side="right")) - 1
                        sequence, offset, room = ends[0] // capacity + k, at - ends[k], ends[k + 1] - at
                    length = min(room, n - start)
                    of.append(i)
                    out.append((start, length, ids[start : start + length].tobytes(), n, sequence, offset))
                    start, at = start + length, at + length
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([x.column("doc_id").take(pa.array(of, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "tokens", "wide", "ids", "part", "before").mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (binary, of at most ``capacity`` tokens) and the doc_ids of their pieces, in order."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = F.aggregate("inside", F.lit(b""), lambda sofar, x: F.concat(sofar, x["ids"]))
    return pieces.groupBy("sequence_id").agg(inside.alias("inside")).select("sequence_id", joined.alias("ids"), F.col("inside.doc_id").alias("doc_ids"))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
