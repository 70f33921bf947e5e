"""The corpus pipeline: documents in, encoded training documents out; each stage calls one operator of strataledger.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataledger.llm import line_dedup, minhash, mixing, pieces, quality
from strataledger.llm.common import crc_mod, cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score at least 0.5), whole.

    Null and empty texts are scored as texts without words; repeated rows score alike and stay or go together; null ids
    take part; without usable labels nothing goes. Empty tables give no rows; columns beyond those of documents go.
    """
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return quality.score_quality(docs.select(*COLUMNS), model).where("score >= 0.5").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their host's boilerplate lines; n_chars follows the text where it changed. No row goes.

    A null text stays null; a text of boilerplate only becomes empty; a null source is a host of its own; every row is
    a page, repeated ones too. Empty tables give no rows; columns beyond those of documents go.
    """
    found = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    changed = F.when(F.col("n_dropped") > 0, F.length("clean_text").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select("row.doc_id", F.col("clean_text").alias("text"), "row.lang", "row.source", changed.alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Rows without words (null or empty texts) all stay, repeated ones too. Of rows that agree in id and text, one is
    left. Null ids take part. Empty tables give no rows; columns beyond those of documents go.
    """
    return minhash.deduplicate(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a row each time.

    Rows without words are never taken; a null source is a source of its own; repeated rows and rows with a null id are
    taken alike where source and size agree. Empty tables give no rows; columns beyond those of documents go.
    """
    return mixing.mix(docs.select(*COLUMNS), weights=(5.0, 2.0, 1.0), max_epochs=3.0)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document: doc_id, source, n_tokens, ids.

    Null and empty texts have no pieces (n_tokens 0); repeated rows, null ids and sources stay as they are. Empty
    tables give no rows; columns beyond those of documents go.
    """
    encoded = pieces.encode(docs.select("doc_id", "source", "text"))
    return encoded.select("row.doc_id", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: Neither the classifier, the near duplicates, the seeded draw nor the merge order of pieces has a form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each cut in the shared folder like the tables between stages."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
