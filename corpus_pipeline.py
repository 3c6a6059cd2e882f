"""A pipeline over documents: quality, near copies, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and
returns a DataFrame that is written and read again before the next one. All stages but
the last return the columns of documents; other columns of docs, whatever their names,
are left out. An empty table gives an empty result in every stage, and so does the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unitweave.llm import lexpack, mixing, overlap_join, puquality, surrogates
from unitweave.llm.common import cut, table
from unitweave.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts to be of quality 1, unchanged.

    It learns from docs and the table labels, without the held-out fold's labels. Null and
    empty texts are scored as texts without words, repeated rows alike and kept or
    dropped together; a score of exactly 1/2 is kept. Null ids are never positives. Without
    a usable label every row is kept.
    """
    return puquality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, unchanged.

    Five words a shingle, Jaccard 0.8 or more, groups by links. Null, empty and blank
    texts are no copies of anything and stay, as do rows with a null id. Rows that repeat
    the id that stays, stay.
    """
    return overlap_join.keep_representatives(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates in their texts; n_chars is counted again.

    A null text stays null (n_chars null), an empty one empty; equal texts get equal
    results.
    """
    return surrogates.replace_entities(docs.select(*COLUMNS)).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows repeated by whole epochs, a seeded part of them once more, and one of each source cut to its first words.

    Rows without words weigh nothing and stay once. A null source is one source. Rows of
    one id follow each other by their texts' hash. n_chars is counted again.
    """
    return mixing.repeat_documents(docs.select(*COLUMNS)).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece, with all tokens of all rows.

    A null text is an empty one: its end id alone. Rows of one id (mixture repeats them)
    are told apart by row_id.
    """
    return lexpack.pack(docs.select(*COLUMNS), tokenizer_path())


STAGES = [("quality", quality), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]
#: The classifier and the retrieval are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's pieces for the table documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
