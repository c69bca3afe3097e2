"""From raw documents to packed training sequences in five stages, each one operator of lodestar.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and reads it
back as the next stage's input. All but the last return the columns of `documents`.

1. quality: scores whole texts with naive Bayes support vectors fitted on `labels`; rejected documents go.
2. near_duplicates: groups of documents whose sets of five-word shingles are similar at 0.8 or more; of each group the
   document with the smallest id stays.
3. repeats: bytes of a 50-byte string that also starts in a document with a smaller id go (whole characters only);
   n_chars is counted again.
4. mixture: sources are mixed by temperature to 95 % of the greatest entropy, no source more than twice, as many tokens as
   there are; a document that is taken twice is there twice.
5. packing: sequences of at most 1024 tokens of the byte-level vocabulary, one row for each piece.

Cases: a null text is empty and stays null. Rows with a null id are never near duplicates, neither lose repeats nor cause any. Of
rows that repeat an id, those with different texts are documents of their own. Other columns pass through all stages but
the last, whatever their names (dots, names that operators use). An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bwt_dedup, nbsvm, packing, simhash, temperature_mix
from lodestar.llm.common import nest, unnest
from lodestar.llm.queries import tokenizer_file
from lodestar.session import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    scored = nbsvm.score(nest(docs, "text"), model)
    return unnest(scored.where("predicted = 1"), docs, "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ("doc_id", "text")
    clean = unnest(bwt_dedup.remove_repeats(nest(docs, *own)).withColumn("text", F.when(F.col("text").isNotNull(), F.col("text_clean"))), docs, *own)
    if "n_chars" in docs.columns:
        count = F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", count)
    return clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return temperature_mix.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("packing", pack)]

# The classifier, the suffix structure and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
