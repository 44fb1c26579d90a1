"""Exact de-duplication with a heavy-hitter split. Native DataFrame operations only.

1. Each text becomes a SHA-256 digest of its A-Z lower-cased form; (doc_id, row,
   digest) is cut into a checkpoint, so texts are read and hashed once.
2. ``freqItems`` (the Misra-Gries / Karp-Shenker-Papadimitriou counter, merged
   over partitions) names every digest that may make up more than ``support`` of
   the rows: 1 / support names at most, whatever the input.
3. The exact counts of those names verify them; the verified winners, at most
   1 / support rows, are broadcast, and their copies are settled map-side.
4. All other digests are aggregated (partially before the shuffle) and joined
   back by ordinary shuffles, whose largest group is now a ``support`` share.

Defined cases: a null text is empty and equals an empty text; a null ``doc_id``
never stays while the group has another id; of repeated rows with the same id
and text exactly one is kept; an empty table gives an empty result; further
columns are carried along untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fresh_name, one_row_of, text_or_empty

#: A digest with more than this share of the rows counts as heavy. Bounds the broadcast to 1 / SUPPORT rows.
SUPPORT = 0.001


def digest_of(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(ascii_lower(text), 256)


def heavy_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """digest, keep, group_size of each digest that makes up more than ``support`` of ``rows``."""
    names = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    total = rows.count()
    return _settled(rows.join(F.broadcast(names), "digest", "left_semi")).filter(F.col("group_size") > support * total)


def _settled(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("at").alias("keep"), F.count("*").alias("group_size"))


def decide(docs: DataFrame, support: float = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(
        docs.select(F.col(id_col).alias("doc_id"), digest_of(text_or_empty(text_col)).alias("digest")).select(
            F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("at"), "digest"
        )
    )
    winners = cut(heavy_digests(rows, support))
    marked = rows.join(F.broadcast(winners), "digest", "left")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    settled = marked.filter(F.col("keep").isNotNull()).unionByName(light.join(_settled(light), "digest"))
    return settled.select(
        F.col("at.doc_id").alias("doc_id"),
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size"),
        (F.col("at.row") == F.col("keep.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, support: float = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Rows are matched by id and digest. Rows that repeat the same id and text pass
    that match together; where they occur, the one with the least hash of all its columns stays.
    """
    keep, digest = fresh_name("keep"), fresh_name("digest")
    kept = decide(docs, support, id_col, text_col).filter("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias("digest"))
    tagged = docs.withColumn(digest, digest_of(text_or_empty(text_col)))
    stay = tagged.join(kept, tagged[f"`{id_col}`"].eqNullSafe(kept[keep]) & (tagged[digest] == kept["digest"]), "left_semi")
    repeated = cut(docs.groupBy(F.col(id_col).alias(keep)).count().filter("count > 1").select(keep))
    if not repeated.take(1):
        return stay.drop(digest)
    again = stay[f"`{id_col}`"].eqNullSafe(repeated[keep])
    once = stay.join(repeated, again, "left_anti")
    picked = one_row_of(stay.join(repeated, again, "left_semi"), [id_col, digest])
    return once.unionByName(picked).drop(digest)
