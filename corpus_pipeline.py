"""A corpus-cleaning pipeline over documents: each stage is one operator of basewise.llm.

Rows with a null doc_id are their own documents in every stage.  An empty table gives an empty one in every stage; the columns of documents, and others beside them, stay in all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.llm import bpe_words, lang_id
from basewise.llm.common import stash, table
from basewise.llm.decontam import decontaminate, row_key
from basewise.llm.near_copies import hinted, near_copy_groups
from basewise.llm.secret_scan import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are like none of the languages learned from docs: null texts, texts without letters, and scores below LEAST_SCORE."""
    judged = lang_id.identify(docs, lang_id.profiles(docs), docs.columns)
    return judged.filter((F.col("lang_pred") != lang_id.UND) & (F.col("score") >= lang_id.LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest id, a null one last, and of equal ids the least hash of the text.

    Rows are told apart by id and text, so texts that share an id are judged each by its own group.  An empty table gives no rows; all columns stay.
    """
    rows = stash(near_copy_groups(docs), "pipeline-rows")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")
    first = stash(rows.groupBy("grp").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("grp", "first"), "pipeline-first")
    judged = stash(rows.join(hinted(first), "grp").select("id", "text_hash", (order == F.col("first")).alias("kept")), "pipeline-groups")
    row = F.xxhash64("text").alias("text_hash")
    same = lambda other: docs.doc_id.eqNullSafe(other.id) & (F.xxhash64(docs.text) == other.text_hash)
    gone = judged.filter("not kept").select("id", "text_hash").distinct()
    repeated = judged.filter("kept").groupBy("id", "text_hash").count().filter("count > 1").select("id", "text_hash")
    out = docs.join(hinted(gone), same(gone), "left_anti")
    if repeated.isEmpty():
        return out
    others = out.join(hinted(repeated), same(repeated), "left_anti")
    once = out.join(hinted(repeated), same(repeated), "left_semi").withColumn("__text_hash", row).dropDuplicates(["doc_id", "__text_hash"])
    return others.unionByName(once.drop("__text_hash"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold a window of a benchmark item; others that share their id, null included, stay."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), slop=None, by_row=True).filter("n_hit > 0").select(F.col("row").alias("__row"))
    return docs.join(found, row_key() == F.col("__row"), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in texts; every document stays."""
    return redact(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text; return its ids and the text they decode to."""
    return bpe_words.encode(docs, bpe_words.default_path(), decoded=True).select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("secret_scans", secrets), ("bpe_encoding", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs


ORACLE_SQL = None
