"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns that came in; the
last returns the pieces of the packed sequences. Every stage is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import language, minhash, packing, secrets, suffixes
from bitloom.llm.common import boxed, col, small_batches, stored, unboxed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those in no learned language (mixed ones stay).

    What fits no language has a label of its own, learned from letter junk and foreign scripts, so a document stays if a
    language fits it better than that, with more than its share by chance. Null and empty texts go; without labelled
    rows every text with a letter stays; repeated rows fare alike; texts of any length are read whole.
    """
    small_batches(spark)
    model = language.fit(docs, background=True)
    return language.accepted(docs, model, least=1 / len(model.labels) if model else 0.0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document of the smallest id.

    Null and empty texts and rows without an id are in no group and stay; rows that share an id are one document and
    stay or go together; texts of any length are compared whole.
    """
    small_batches(spark)
    gone = minhash.near_duplicates(docs).where("not kept and component_id is not null").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), boxed(docs).alias("box"))
    return unboxed(rows.join(stored(gone), "id", "left_anti"), docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every 100-byte string that also starts earlier in the corpus; n_chars follows the text.

    Null texts stay null and empty ones empty; a text that is all repeated becomes empty and its row stays; of equal texts
    the first by id (null ids last), then by row, stays whole; texts of any length are read whole.
    """
    small_batches(spark)
    rest = [c for c in docs.columns if c != "text"]
    cut = suffixes.remove_repeated(docs, keep=rest, with_text=True)
    cols = {"text": F.col("kept_text"), **{c: col(f"_keep_{c}") for c in rest}}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("kept_text").isNotNull(), F.length("kept_text")).otherwise(cols["n_chars"])
    return cut.select(*[cols[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask credentials; n_chars follows the text.

    Null texts stay null, empty ones and those without a credential as they are; no row goes; repeated rows are masked
    alike; texts of any length are read whole. Owners are sources, and the documents of a language of a source one repository.
    """
    out = secrets.redact(docs, owner_col="source", repo_col="lang", copied_repos=4)
    if "n_chars" not in docs.columns:
        return out
    n_chars = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[n_chars.alias(c) if c == "n_chars" else col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens.

    Null and empty texts give their end id alone; repeated rows are packed each for itself; very long texts are cut; the
    columns of the documents other than the id don't come back.
    """
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), **packing.INSTRUCTION)


STAGES = [("language", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("secrets", secret_scan), ("packing", pack)]

#: Networks, components, suffix orders and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
