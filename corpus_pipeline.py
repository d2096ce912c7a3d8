"""A corpus pipeline: five stages over ``documents``, each one operator of ``tessera.llm``.

A stage is a function of (spark, docs, folder): ``docs`` is what its predecessor
kept, ``folder`` holds the other tables. All but the last return the columns of
documents. A text that loses passages is its kept words joined by one space, and
n_chars follows it.

In every stage a null text counts as the empty text and stays null where the row
stays; a null doc_id is carried; no rows give no rows; other columns pass through
whatever their names, but for the last stage, which has its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, piece_bpe, quality_classifier, simhash, substring_dedup
from tessera.llm.common import discard, ship, stored, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier rejects go.

    Repeated rows share one fate. An empty text resembles nothing and has the share
    of good labels as its score. Without labels every document stays.
    """
    ship(spark)
    return quality_classifier.accepted(docs, table(spark, folder, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Of repeated rows one stays, of several texts with that id the one of least
    hash. Empty and null texts are one group. Rows with a null id all stay.
    """
    ship(spark)
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages that occur more than once are cut out; no document goes.

    Repeated rows are copies of each other, so a text of ``WIDTH`` words or more
    loses all its words. Shorter and empty texts stay as they are.
    """
    ship(spark)
    return substring_dedup.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Repeated rows share one fate. Empty texts hold nothing. Without items every
    document stays.
    """
    return decontaminate.without_leaks(docs, table(spark, folder, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that they decode to, one row for each row.

    Null and empty texts have no ids and decode to the empty text.
    """
    ship(spark)
    coded = piece_bpe.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.when(F.col("n_tokens") > 0, F.split("ids", ",").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return coded.select("doc_id", "n_tokens", ids.alias("ids"), "decoded")


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: Nearest-neighbour scores and fingerprints are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written and read again by the next, what came before is deleted."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        discard(spark, since=before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
