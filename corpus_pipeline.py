"""A training-corpus pipeline of four stages: quality, toxicity, near duplicates, packing.

Every stage works on all documents that the one before kept. STAGES lists (name, function);
a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import near_dedup, packing, quality, toxicity
from veriframe.llm._common import stage, table

#: Words of a shingle and similarity in percent of the near-duplicate stage.
WIDTH, PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose mean importance ratio is below the threshold placed on labelled rows."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of the threshold or more."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near duplicates (five words, similarity of 0.8 or more).

    Rows without a doc_id take part under a stand-in that is larger than every doc_id, made from their text, so one of them
    stays only where its group has no doc_id. Repeated rows of a doc_id and text count once. Documents without
    words all stay. doc_ids must be below 2**62, else a ValueError is raised.
    """
    least = 1 << 62
    id_, none = F.col("doc_id").cast("long"), F.col("doc_id").isNull()
    largest, unnamed = docs.agg(F.max(id_), F.count(F.when(none, 1))).first()
    if (largest or 0) >= least:
        raise ValueError("doc_ids must be below 2**62")
    stand_in = F.lit(least) + F.xxhash64("text").bitwiseAND(F.lit(least - 1))
    named = docs.withColumn("doc_id", F.coalesce(id_, stand_in)) if unnamed else docs
    found = stage(near_dedup.near_duplicates(named, WIDTH, PERCENT), "near-duplicates")
    kept = found.where("kept").groupBy(F.col("doc_id").alias("kept_id")).count()
    out = named.join(kept.select("kept_id"), F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi")
    if not kept.where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    if unnamed:
        out = out.withColumn("doc_id", F.when(F.col("doc_id") < least, F.col("doc_id")).cast(docs.schema["doc_id"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 4096 tokens."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("quality", keep_good), ("toxicity", keep_clean), ("near_dedup", keep_first), ("packing", pack)]

#: Learned models, MinHash and tokenizers are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table.

    Null texts count as empty. An empty table gives an empty result; extra columns are carried along and never read. Very
    long texts are worked on whole. Repeated rows count once from the near-duplicate stage on; ties there go to the smaller doc_id.
    """
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"kept-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
