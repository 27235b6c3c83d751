"""The corpus pipeline: documents in, token ids of the kept documents out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.

1. quality: documents that the quality classifier rejects go.
2. line_dedup: lines that repeat an earlier line, or are within two edits of
   one, go; so do documents of which nothing is left.
3. near_duplicates: of each group linked by a Jaccard similarity of 0.8 or
   more on five-word shingles the document with the smallest id stays.
4. decontamination: documents that hold a benchmark passage go.
5. tokens: byte-level BPE ids, with digests of the ids and of their decoding.

Rows without an id are judged by quality and decontamination only and stay
otherwise.  Rows that repeat an id are documents of their own to stage 3: of a
group the row with the smallest id stays (of equal ids the one with the
smallest digest of its text), rows with unrelated texts all stay.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from tessera.llm.common import fresh, small, written
from tessera.plans.rolling import spread
from tessera.session import ensure_checkpoint_dir
from tessera.sources.tables import read_table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.classify(spread(docs)).where("quality_score >= 0.5").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(spread(docs)).where("n_removed = 0 or length(trim(text)) > 0")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
                          ).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = lambda df, key: written(jaccard_join.join(spread(df), shingle=5, num=80, den=100, id_col=key), "groups")
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = linked(named, "doc_id").where("doc_id <> component_id").select("doc_id")
        return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    # some id has several rows: each row is a document of its own under a key that is fixed by writing it
    key, = fresh(docs, "row_key")
    rows = written(named.withColumn(key, F.monotonically_increasing_id()), "rows")
    place = rows.select(F.col(key).alias("place"), F.struct("doc_id", F.sha2("text", 256), F.col(key)).alias("order"))
    first = linked(rows, key).join(place, F.col(key) == F.col("place")).groupBy("component_id").agg(F.min("order")[key].alias("kept"))
    return (rows.join(first, F.col(key) == F.col("kept"), "left_semi").drop(key)
                .unionByName(docs.where("doc_id is null")).select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(spread(docs), read_table(spark, sf_dir, "benchmark"))
    return out.where(F.size("leaks") == 0).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(spread(docs), VOCABULARY, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), F.col("ids").alias("token_ids"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: The learned classifier, the random walks and the merges cannot be written in SQL; the
#: stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
