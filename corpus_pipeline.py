"""The corpus pipeline: documents to training sequences.

``STAGES`` lists its stages; each takes (spark, docs, sf_dir) and returns a
DataFrame.  ``run`` applies them to ``documents``; between stages the rows are
written as Parquet to the shared checkpoint folder and read again, so a lost
executor costs the stage it worked on.

1. language ID: documents without a letter, or in no learned language (score below 0.3), go;
   where no document has a label, all with a letter stay.
2. exact dedup: one document of each group of equal texts stays.
3. MinHash near-dedup: one document of each component (word 5-grams, 0.8) stays.
4. secret scan: secrets are masked, every document stays.
5. packing: the texts become pieces of 2048-token sequences.

Defined results: a null text has no letter and goes in stage 1; a null doc_id or lang, very long
texts and ties are handled as the operators say; rows are told by their place in the files, so of
fully repeated rows one stays (stage 2); an empty table gives an empty table in every stage; further
columns of any name pass through the first four stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlens.llm import exact_dedup, langid, minhash, packing as packer, secret_scan
from credlens.llm.common import scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train_model(langid.training_rows(docs))
    return langid.keep_identified(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packer.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("minhash", near),
          ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs


#: The learned stages and the tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
