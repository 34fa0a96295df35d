"""Exact duplicates of whole texts, by DataFrame operations only.

1. Digests (32 bytes a row) are counted; a digest that occurs once settles its row without moving its text.
2. Texts of the other digests are combined where they are read (map-side aggregation by digest, text and salt), so that
   each task sends a text once at most; a salt takes the task's number modulo ``salts``, so that a group of any size meets in
   ``salts`` places.
3. The salts' winners are combined. Both groupings are by the whole normalised text beside the digest.

The commonest digests (a fixed number) are broadcast to the rows, all others meet them by shuffle, so no task gets the rows of
a large group; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.common import BLANKS, join_skewed, unused
from peerscope.session import materialize


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space is one blank; null counts as empty. The smallest id of a
    group stays. Rows that repeat an id and a text are kept or dropped together; null ids come after all others and are
    never a group's keep_id unless it has no other. An empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{BLANKS}]+", " ").alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("body"), 256)))
    repeated = materialize(rows.groupBy("digest").agg(F.count("*").alias("rows")).filter("rows > 1"))
    salted = (
        join_skewed(rows, repeated, "digest", "rows")
        .withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "body", "salt")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    )
    groups = salted.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).drop("body")
    return (
        join_skewed(rows.drop("body"), materialize(groups), "digest", "group_size", "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names. Null counts as empty; rows that repeat an id and a text stay or go together."""
    id_key, digest_key = unused(docs, "id", "digest")
    digest = F.lower(F.sha2(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), f"[{BLANKS}]+", " "), 256))
    dropped = exact_duplicates(docs, doc_id, text).filter("not kept").select(F.col("doc_id").alias(id_key), F.col("text_sha256").alias(digest_key)).distinct()
    return docs.join(dropped, (digest == F.col(digest_key)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(id_key)), "left_anti")
