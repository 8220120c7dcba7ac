"""The corpus pipeline: five of the text operators, one after the other, from documents to tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs. All but the last return the columns of documents. Empty tables stay empty, extra columns
are carried along whatever their names, and each stage reads whole texts of any length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import exact_dedup, jaccard_join, language_id, mixing, sentencepiece_codec
from tidewright.llm.common import documents, in_written_order, shared_folder
from tidewright.llm.queries import piece_model


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression leaves in doubt go, null and letterless texts among them. A null
    lang teaches nothing; rows that repeat stay or go together; long texts are encoded whole."""
    return language_id.keep_known_language(docs)


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal ones stays, that with the smallest id (null before all), and of rows
    that repeat it the first. Null is the empty text."""
    return exact_dedup.keep_one_of_equal(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join stays, chosen in the same way: five words, a similarity of
    0.75. Texts without words, null among them, all stay."""
    return jaccard_join.keep_one_of_near(docs)


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of sources; null is a source of its own, and ties are in the
    order of the rows."""
    return mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their pieces, in the order of the mix; decoding gives each text back exactly. A null
    text has null pieces. Columns named like the new ones are replaced."""
    return sentencepiece_codec.encode(in_written_order(docs), piece_model())


STAGES = [
    ("language ID", keep_known_language),
    ("exact dedup", keep_one_of_equal),
    ("n-gram Jaccard join", keep_one_of_near),
    ("mixing sources", in_mixed_order),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what one returns is written to the shared folder for the next."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_folder(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: SQL has neither zstandard's sizes nor the pieces' agenda.
ORACLE_SQL = None
