"""Exact cosine retrieval for many requests at once."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import DENSE_TOP
from ..sources.package import ship
from .lexical import ranked
from .ranking import without

#: Query vectors that go to every task at once, in bytes, and the best rows that a task holds for all of them.
QUERY_BYTES, STATE = 32 << 20, 4_000_000
#: Item vectors of one cell of the grid, in bytes.
CELL_BYTES = 64 << 20
#: Queries and items of one matrix product.
ROWS, COLUMNS = 512, 4096


def matrix(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors of ``dim`` finite components, and their places. A zero vector stays zero."""
    at = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
    rows = np.array([np.asarray(vectors.iloc[i], dtype=np.float64) for i in at], dtype=np.float64).reshape(len(at), dim)
    fine = np.isfinite(rows).all(axis=1)
    rows, at = rows[fine], np.array(at, dtype=np.int64)[fine]
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms), at


def best_of(scores: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, lower documents first among equals."""
    if len(scores) > k:
        some = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0]
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((docs[some], -scores[some]))][:k]


class Best:
    """The best rows of many requests so far; ``most`` says how many each of them keeps."""

    def __init__(self, ids: list, vectors: pd.Series, most: np.ndarray, dim: int, digits: int):
        self.queries, at = matrix(vectors, dim)
        self.ids, self.most, self.dim, self.step = [ids[i] for i in at], [int(most[i]) for i in at], dim, 10.0**digits
        self.scores, self.docs = [np.zeros(0)] * len(at), [np.zeros(0, dtype=object)] * len(at)

    def add(self, items: pd.DataFrame) -> None:
        for start in range(0, len(items), COLUMNS):
            part = items.iloc[start : start + COLUMNS]
            rows, at = matrix(part["embedding"], self.dim)
            docs = part["doc"].to_numpy()[at]
            for first in range(0, len(self.ids) if len(docs) else 0, ROWS):
                cosine = self.queries[first : first + ROWS] @ rows.T
                scores = np.floor(np.clip((cosine + 1) / 2, 0.0, 1.0) * self.step + 0.5) / self.step
                for i, s in enumerate(scores, first):
                    if len(self.scores[i]) == self.most[i] > 0:
                        some = np.nonzero(s >= self.scores[i][-1])[0]
                        if not len(some):
                            continue
                        s, d = np.concatenate([self.scores[i], s[some]]), np.concatenate([self.docs[i], docs[some]])
                    else:
                        s, d = np.concatenate([self.scores[i], s]), np.concatenate([self.docs[i], docs])
                    best = best_of(s, d, self.most[i])
                    self.scores[i], self.docs[i] = s[best], d[best]

    def rows(self) -> Iterator[pd.DataFrame]:
        for first in range(0, len(self.ids), ROWS):
            ids, docs, scores = self.ids[first : first + ROWS], self.docs[first : first + ROWS], self.scores[first : first + ROWS]
            yield pd.DataFrame({"request_id": [i for i, d in zip(ids, docs) for _ in d], "doc": np.concatenate(docs), "sem_raw": np.concatenate(scores)})


def search(vectors: DataFrame, items: DataFrame, exclude: DataFrame | None = None, k: int = DENSE_TOP, digits: int = 6, query_bytes: int = QUERY_BYTES, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(request_id, doc, sem_raw, sem_score, sem_rank): top ``k`` by cosine, mapped to [0, 1].

    ``vectors`` (request_id, vector) is a stated query set held against all of
    ``items`` (doc, embedding), in one plan of the same size for any number of requests. Vectors
    within ``query_bytes`` are broadcast, and items stay where they are. More of them
    make a grid: blocks of requests by blocks of items, each cell of bounded size a
    group of its own. A task keeps the best ``k`` of each of its requests, beside as many as
    the request excludes, over all items it reads, so what is shuffled doesn't grow with the
    items of a task. Vectors that aren't as long as the longest query, or not finite, have no similarity.
    """
    spark = vectors.sparkSession
    ship(spark)
    asked = vectors.filter("vector is not null").select("request_id", "vector")
    if exclude is not None:
        excluded = exclude.groupBy("request_id").agg(F.count("*").alias("out"))
        asked = asked.join(excluded, "request_id", "left")
    else:
        asked = asked.withColumn("out", F.lit(0))
    asked = asked.select("request_id", "vector", (F.coalesce("out", F.lit(0)) + k).alias("most"))
    n, dim, kept = asked.agg(F.count("*"), F.max(F.size("vector")), F.sum("most")).first()
    dim = max(dim or 1, 1)
    blocks = max(1, -(-n * dim * 8 // query_bytes), -(-(kept or 0) // STATE))
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((vectors, "request_id"), (items, "doc"))]
    schema = f"request_id {kinds[0]}, doc {kinds[1]}, sem_raw double"
    rows = items.select("doc", "embedding")
    if blocks == 1:
        told = asked.toPandas()  # within query_bytes
        sent = spark.sparkContext.broadcast((list(told["request_id"]), told["vector"], told["most"].to_numpy()))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = Best(*sent.value, dim, digits)
            for x in frames:
                best.add(x)
            yield from best.rows()

        scored = rows.mapInPandas(run, schema)
    else:
        parts = -(-rows.count() * dim * 8 // cell_bytes)

        def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            best = Best(list(left["request_id"]), left["vector"], left["most"].to_numpy(), dim, digits)
            best.add(right)
            found = list(best.rows())
            return pd.concat(found) if found else pd.DataFrame({"request_id": [], "doc": [], "sem_raw": []})

        each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        dealt = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
        left = asked.withColumns({"block": dealt("request_id", blocks), "part": each(max(parts, 1))})
        right = rows.withColumns({"part": dealt("doc", max(parts, 1)), "block": each(blocks)})
        scored = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(cell, schema)
    if exclude is not None:
        scored = without(scored, exclude, ["request_id", "doc"])
    return ranked(scored, "sem", k).withColumn("sem_score", F.col("sem_raw"))
