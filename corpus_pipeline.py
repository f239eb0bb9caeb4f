"""Corpus pipeline: the stages that turn ``documents`` into token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents that it leaves, with the columns
of ``documents``; the last one returns ids. ``run`` writes every stage as Parquet in the shared
folder and reads it again as the next one's input, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import bpe, langid, lines, mixing, neardup
from sigloom.llm.store import stored
from sigloom.llm.text import id_bucket
from sigloom.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Language ID rejects texts without letters, and those of which the best language's filter
#: knows less than this part of the n-grams.
LEAST_COVERAGE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose text is in one of the learned languages; ``lang`` becomes the
    predicted one. The filters are learned from the given languages."""
    known = docs.select("text", "lang", id_bucket(F.col("doc_id"), 4).alias("part"))
    filters = langid.train(known.where("part <> 2"))
    tagged = langid.predict(docs.select(*COLUMNS), filters)
    kept = tagged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("coverage") >= LEAST_COVERAGE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrite every text without the lines that many documents share. All documents stay; one
    that keeps no line has an empty text."""
    return lines.dedup_lines(docs, min_chars=40, min_docs=5, carry=("lang", "source")).select(
        "doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars")
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of every group of near duplicates. Rows that
    share a doc_id stay together, if any of them is kept."""
    judged = neardup.near_duplicates(docs, words=5, threshold=0.8)
    gone = judged.groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_or("kept").alias("stays")).where("NOT stays").select("_gone")
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as the mix of sources says: not at all, once or twice."""
    sized = cut_lineage(mixing.sizes(docs))
    rule = mixing.balance(sized)
    taken = mixing.copies(docs.select(*COLUMNS, mixing.n_words(F.col("text")).alias("size")), rule)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    return taken.where("copies > 0").select(*COLUMNS, copies.alias("_copy")).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with the hashes of the ids and of the text decoded from them."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_tokens),
]
#: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
