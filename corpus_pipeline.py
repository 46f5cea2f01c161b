"""From raw documents to token ids: language ID, near-duplicates, secret scans, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each to the shared folder and reads it
back for the next. All but the last return the columns of ``documents``; the last carries the training order.

Null texts have no language and go. Rows without an id are kept by every stage. Extra columns of the documents go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import bpe, langid, minhash, mixing, secrets
from headway.llm.queries import bpe_file, language_model
from headway.llm.shared import forget, saved, table, written_place

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: those that have no text or no letter. Ambiguous ones stay."""
    seen = langid.predict(docs.withColumn("__copy", F.col("text")), language_model(docs), [*COLUMNS], "__copy")
    return seen.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of the smallest id, and every row without an id."""
    kept = minhash.keepers(docs)
    tagged = docs.withColumn("__tag", minhash.tag(F.col("text")))
    one = tagged.join(kept.select("doc_id", F.col("tag").alias("__tag")), ["doc_id", "__tag"], "left_semi")
    # repeated rows of one id and text are copies of each other; rows without an id are linked with nothing
    return one.dropDuplicates(["doc_id", "__tag"]).select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in the texts; no document goes."""
    scanned = secrets.scan(docs.select(*COLUMNS), secrets.scanner(docs))
    return scanned.withColumn("text", F.col("redacted")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it (rounded), each copy at its own place in training order."""
    return mixing.in_training_order(mixing.each_copy(mixing.mix(docs, COLUMNS)).select(*COLUMNS, "position")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its ``place`` in training order (the order in which ``mix`` was written)."""
    return bpe.encode(docs.withColumn("place", written_place(docs)), bpe_file(), ["doc_id", "source", "place"])


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix", mix), ("encode", encode)]

#: Language models, signatures, forests and merges are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table(sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        read, docs = docs, saved(stage(spark, docs, sf_dir), name)
        if k:
            forget(read)
    return docs
