"""Exact dedup: 128-bit content hash, one row of each group kept, bytes compared inside the groups.

Main path: DataFrame functions only.

Plan. Every text is hashed (md5 of the normalised bytes). Texts are first
collapsed map-side by (hash, bytes), so a group of copies crosses the shuffle
once per map task, however large it is; the bytes are part of the grouping
key, so two texts of one hash stay apart. The member rows join the groups on
(md5, sha256) with the hashes only, no text; AQE may split a hot key there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import NULL_ID, long_id

AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalise(text: Column) -> Column:
    """Null is empty; only A-Z are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), AZ, AZ.lower())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row for each input row: (id, keep_id, group_size, kept, text_sha256).

    keep: "min" or "max" id of a group stays. Null text: empty. Null id: kept
    only if a group has no other id, and keep_id is null then. Repeated rows
    (same id and text) all count in group_size and all carry the same
    decision. An empty table gives an empty result.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), normalise(F.col(text_col)).alias("norm")).select(
        "id", F.md5(F.col("norm").cast("binary")).alias("h"), "norm"
    )
    groups = (
        rows.groupBy("h", "norm")
        .agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    members = rows.select("id", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    return members.join(groups, ["h", "text_sha256"]).select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The documents that stay, with all their columns; of repeated rows with one id and text one stays."""
    kept = (
        exact_groups(docs, id_col, text_col, keep)
        .filter("kept")
        .select(F.coalesce(F.col("id").cast("long"), F.lit(NULL_ID)).alias("__id"), F.col("text_sha256").alias("__sha"))
    )
    tagged = docs.withColumns(
        {
            "__id": F.coalesce(long_id(docs, id_col), F.lit(NULL_ID)),
            "__sha": F.sha2(normalise(F.col(text_col)).cast("binary"), 256),
        }
    )
    return (
        tagged.join(kept, ["__id", "__sha"], "left_semi").dropDuplicates(["__id", "__sha"]).select(*docs.columns)
    )
