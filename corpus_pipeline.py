"""A corpus pipeline: five operators over documents, each stage written as Parquet and read again before the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents, whatever others there are and however they are named; the last returns the pieces of packed
sequences. Every stage takes nulls in any column, empty and very long texts, repeated rows and an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import decontaminate, jaccard, packing, secrets, toxicity
from shelfmark.llm.common import table, written

#: Learnt models and an iterative join can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the model is learnt from labelled documents of the input.

    Null and empty texts have the model's base score; repeated rows are judged alike; without labels of both kinds the
    score is constant; an empty table stays empty.
    """
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least doc_id, null last.

    Of rows repeated in doc_id and text one stays; all rows without words stay; an empty table stays empty.
    """
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in windows of benchmark items.

    Null and empty texts stay; rows of one text stay or go together; without items all stay; an empty table stays empty.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked parts of credentials masked in their texts.

    Null and empty texts stay as they are, repeated rows are each masked, n_chars follows the text; an empty table stays empty.
    """
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in token sequences.

    Null and empty texts are the end id alone; repeated rows and null doc_ids are packed as rows of their own; an empty table
    gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
