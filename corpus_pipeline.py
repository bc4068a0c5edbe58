"""Corpus preparation in stages, each written as Parquet and read again as the next one's documents.

language: drops documents whose text has no language, or too little of one (operator 9, learned from the documents
that the stage is given, less one fifth by id). near_duplicates: of each class of near copies the document with the
smallest id stays (6). decontaminate: drops documents that hold a window of the benchmark (3). secrets: masks secrets
in the text and n_chars follows (8). encode: token ids of the text, checked by decoding (4).

All stages but the last return the columns of documents. No stage can be expressed in SQL as a whole (the first learns
a model), so there is no oracle; tests hold the stages against brute force.

Edge cases: a null or empty text has no language and goes in the first stage, as does one without letters; a very long
text is worked on whole and alone in every stage; of repeated rows one stays; documents without an id count as the last
of their class, and those without a label are not learned from; an empty table gives an empty result of the same columns;
further columns are carried through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import byte_bpe, decontaminate, language, minhash, secrets
from jobtide.llm.batches import Scratch
from jobtide.llm.registry import BPE_RANKS, table

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learn(docs.where(language.remainder("doc_id", 5) != 0))
    return language.keep_accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_of_each(docs)


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.mask_secrets(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BPE_RANKS)
    return byte_bpe.verified(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate_texts),
    ("secrets", mask_secrets),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; every stage's is written to the shared folder."""
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        made = scratch.table(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs, before = made, made
    return docs
