"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``; the last
returns each kept document's place.

Cases: every stage keeps extra columns, whatever their names, until the last; repeated rows count once after the second
stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm import decontam, interleave, langid, mixing, simhash
from quirelight.llm.common import free_name, materialise, row_hash, table

#: A text is rejected if it has no letter, or if no language holds this share of its words.
LEAST_SHARE = 0.35
#: Keys (8 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_KEYS = 2_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the model is learned from the documents given.

    A null lang is filled with the language found. Texts that are null or have no letter go; so does all if no document
    has a language to learn from.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = free_name(docs, "_language")
    columns = docs.columns
    docs = docs.withColumn(found, langid.identify(docs, model))
    docs = docs.where((F.col(f"{found}.lang_pred") != langid.UND) & (F.col(f"{found}.lang_score") >= LEAST_SHARE))
    return docs.withColumn("lang", F.coalesce("lang", F.col(f"{found}.lang_pred"))).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: word shingles of five, a similarity of 0.8 or more.

    That with the smallest id stays, a null id coming last; texts without words are one group.
    """
    return simhash.representatives(docs, 0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item; with an empty benchmark all stay.

    Contaminated documents are named by id and by a hash of id and text, in which nulls count.
    """
    found = decontam.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    key = free_name(docs, "_key")
    bad = materialise(found.where("n_hit > 0").select(F.col("key").alias(key), F.col("doc_id").alias(f"{key}_id")).distinct(), "pipeline-contaminated")
    few = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    rows = docs.withColumn(key, row_hash("doc_id", "text"))
    return rows.join(few, (rows[key] == few[key]) & F.equal_null(rows["doc_id"], few[f"{key}_id"]), "left_anti").drop(key)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents by calibrated probabilities that meets the target weights."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and slot, with its source, size and checksum; a null text has none but a size of 1."""
    return interleave.interleave(materialise(interleave.sized(docs), "pipeline-sized"), ties=("text_crc32", "size"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

#: Language ID and SimHash groups can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
