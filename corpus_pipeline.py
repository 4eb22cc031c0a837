"""Corpus pipeline: toxic documents go, one of each group of near-duplicates stays, personal data gets
pseudonyms, sources are mixed to their target weights in training order, and texts become pieces.

Each stage takes and returns a whole DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import cut, table
from glyphmill.llm.mixing import mix, training_order
from glyphmill.llm.near_dedup import keep_one
from glyphmill.llm.pii import pseudonymise, session_key
from glyphmill.llm.sentencepiece_codec import encode
from glyphmill.llm.toxicity import score_documents, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labels of these documents, does not take for toxic."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).where("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each component: five words, similarity 0.8."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows the text where it has changed."""
    new = pseudonymise(docs, session_key(spark))
    n_chars = F.when(F.col("n_replaced") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return new.select(*[n_chars if c == "n_chars" else c for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time that a document is taken, in training order."""
    return training_order(mix(docs)).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with piece_ids and, read back from them, decoded."""
    return encode(docs, read_back=True)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: No SQL: the first, second, third and last stage aren't expressible; tests/llm holds the run against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
