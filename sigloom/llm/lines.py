"""Line deduplication with built-in functions only.

Lines are exploded with their position, normalised and hashed; the documents of each hash are
counted; lines over the threshold are dropped everywhere but in the document with the largest
id; the other lines are put together again by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.text import WHITE_CHARS, ascii_lower
from sigloom.session import cut_lineage


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text (kept lines), n_lines, n_dropped,
    and the columns named in ``carry``.

    A key is a line without white space at both ends and with A-Z in lower case. Keys of at
    least ``min_chars`` code points that are found in at least ``min_docs`` different doc_ids
    lose all their lines, except in the largest doc_id that holds them.

    A null or empty text is one empty line. All rows with a null doc_id count as one document,
    smaller than any other; rows that share a doc_id count once and are judged alike. A text
    whose lines are all dropped becomes empty. Other columns are not looked at.

    Only hashes travel for counting. A line that a third of the documents hold is first counted
    per (hash, document), then partially summed, so no task holds it; the joins on hashes and on
    ids are left to the adaptive skew split.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("_"), *carry).alias("_carry"),
    ).select(
        "doc_id",
        "_carry",
        F.xxhash64("text", F.length("text")).alias("row_key"),
        F.split("text", "\n", -1).alias("lines"),
    )
    key = ascii_lower(F.btrim(F.col("line"), F.lit(WHITE_CHARS)))
    lines = (
        rows.select("doc_id", "row_key", F.posexplode("lines").alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("doc_id", "row_key", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    common = (
        lines.groupBy("h1", "h2", "doc_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    # Written out, so that a line that a third of the documents hold can be split in the join.
    common = cut_lineage(common)
    dropped = (
        lines.join(common, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set("pos").alias("gone"))
        .select(F.col("doc_id").alias("d_id"), F.col("row_key").alias("d_key"), "gone")
    )
    same = F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("row_key") == F.col("d_key"))
    joined = rows.join(dropped, same, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.transform(left, lambda i: F.element_at("lines", i + 1))
    )
    return joined.select(
        "doc_id",
        F.array_join(kept, "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col(f"_carry.{c}").alias(c) for c in carry],
    )
