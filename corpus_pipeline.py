"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, pieces, pii, simhash, toxicity
from tessella.llm.common import delete, free_name, scratch, shared_dir, small_batches, table
from tessella.llm.lm import fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5. It learns from the labelled documents outside fold 0.

    Null and empty texts, which have no features, stay unless most labelled texts are toxic; repeated rows fare alike; an empty
    table gives none. All columns of `docs` come back, whatever their names.
    """
    model = toxicity.train(docs.where(fold("doc_id") != 0), table(spark, sf_dir, "labels"))
    mark = free_name("score", docs.columns)
    return toxicity.score(docs, model, docs.columns, to_col=mark).where(F.col(mark) < 0.5).drop(mark)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.

    The one with the smallest id stays, null ids last. Texts without words (null too) are copies of each other. All columns come back.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those of which most words are such passages go.

    Null and empty texts stay as they are, repeated rows fare alike, and all columns come back, n_chars set anew where a text changed.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced; no row goes. Null stays null, and n_chars is set anew where a text changed."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, their number and digest, and whether they decode to the very text.

    Null and empty texts have no ids and decode to an empty text; repeated rows give repeated rows; other columns are dropped.
    """
    small_batches(spark)
    return pieces.round_trip(docs, ["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("personal_data", sanitise),
    ("sentencepiece", encode),
]

#: SQL can't express the stages (trained models, exact similarities, Viterbi search); tests hold their parts against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again.

    What a stage made on its way is deleted when it has been written, and a stage's output when the next one has.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        at = f"{shared_dir(spark)}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(at)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(at), at
    return STAGES[-1][1](spark, docs, sf_dir)
