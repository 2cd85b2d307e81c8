"""From raw documents to packed training sequences, in five stages.

Each stage is one operator of ``textpulse.llm``, takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and reread as the next
stage's documents:

1. quality: documents that the classifier rejects go; nothing else does.
2. exact:   of equal texts the row with the largest id stays.
3. near:    of documents alike in 0.8 of their 5-word shingles one stays.
4. mix:     all documents, in the order of a Pfair mix of their sources.
5. pack:    token pieces with their place in sequences of 2048 tokens; the
   sequences follow the mix, whose places are computed again from the same
   documents (the order of a table's rows isn't relied on).

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm import exact, minhash, mixing, packing, quality
from textpulse.llm.common import fresh_path, table

#: Target weights: the named source's share, the others share the rest equally.
TARGETS = {"src0": 0.25}


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.interleave(docs, TARGETS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select("doc_id", "text", "source"), TARGETS)
    place = F.col("mix_slot") * mixing.BLOCK_DOCS + F.col("mix_place")
    return packing.pack_documents(mixed.select("doc_id", "text", place.alias("place")), order_col="place")


STAGES = [
    ("quality", select_quality),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The classifier's scores and the tokenizer's ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
