"""Cleans a corpus: toxicity, language, near duplicates, source mix, token ids. Each stage works on what the one before kept.

The filters keep a document whenever its text gives no reason against it: a null or empty text is neither toxic nor in a wrong
language by itself, so only the language stage, which finds no letter in it, rejects it. Columns other than those of `documents`
pass through the stages that keep documents; an empty table passes as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covary.llm import bpe, langid, mixing, neardup, toxicity
from covary.llm.store import fresh, materialize

TOXIC = 0.5
UNSURE = 0.35


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is TOXIC or more; learns from the labels of the corpus."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mark = fresh(docs.columns, "toxicity")
    return toxicity.score(docs, model, score_col=mark).filter(F.col(mark) < TOXIC).select(docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is found, or none that is likelier than UNSURE."""
    model = langid.fit(docs)
    said, score = fresh(docs.columns, "said"), fresh(docs.columns, "sure")
    found = langid.predict(docs, model, pred_col=said, score_col=score)
    return found.filter((F.col(said) != langid.UNKNOWN) & (F.col(score) >= UNSURE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of every group linked at a similarity of 0.8 or more; of rows that repeat an id and its text, one.

    Rows that repeat an id with different texts share one fate; rows of null ids and rows without words are linked with nothing and stay.
    """
    marks = neardup.near_duplicates(docs, share=80, of=100)
    gone = marks.filter(~F.col("kept")).select("id").distinct()
    once = docs.dropDuplicates([c for c in ("doc_id", "text") if c in docs.columns])
    return once.join(gone, once["doc_id"] == gone["id"], "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: once per whole round over a source, and the words that its last round takes."""
    out = mixing.mixed_texts(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document of the mix."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
