"""A corpus from raw documents: language, near duplicates, personal data, source mix, token ids.

STAGES are (name, function) in order. A function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm.common import discard, materialize
from murmuration.llm.language_id import fit, predict
from murmuration.llm.mixing import apply_mix, mix_sources
from murmuration.llm.ngram_join import near_duplicate_documents
from murmuration.llm.pii import pseudonymize
from murmuration.llm.queries import pii_key, tokenizer_path
from murmuration.llm.sentencepiece_bpe import encode_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a probability of half at least; texts without letters go. lang becomes the one told."""
    told = predict(docs, fit(docs), keep=tuple(COLUMNS))
    return told.where("lang_pred <> 'und' AND score >= 0.5").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates (five words, similarity 0.8); rows with a null id stay."""
    found = near_duplicate_documents(docs, n=5, num=80, den=100)
    return docs.join(found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms."""
    return pseudonymize(docs, pii_key(spark)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: a row per document and epoch."""
    return apply_mix(docs, mix_sources(docs)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text that they decode to."""
    return encode_texts(docs, tokenizer_path(), ids=True, decoded=False)


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("pii", personal_data), ("source_mixing", mix), ("sentencepiece", token_ids)]

#: Naive Bayes, multinomial draws and merges have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs, old = materialize(stage(spark, docs, sf_dir), name), docs
        if i:
            discard(old)
    return STAGES[-1][1](spark, docs, sf_dir)
