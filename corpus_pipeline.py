"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the
next one's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import common, decontam, langid, mixing, simhash, tokenids


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language PPM tells; texts without letters or like no language learnt go.

    Nulls: a null or empty text goes; a null label isn't learnt from, but its row is judged like any other, as is one without an id or source.
    Very long texts are coded in slices, whole.  Ties between languages score at most 0.5, which stays.  Repeated rows each stay or go.
    An empty table, or one without labels, teaches nothing and keeps nothing.
    """
    return langid.keep_identified(docs, langid.learn(docs, F.lit(True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest id.

    Nulls: a null text counts as empty, empty texts are copies of each other; a row without an id stays only if no copy has one.  Very long texts
    are compared whole.  Ties: of equal ids the text of the smaller hash stays.  Rows repeated whole stay once.  An empty table stays empty.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs.

    Nulls: a null or empty text has no words and stays, as do null items without effect.  Very long texts are searched whole.
    Ties and repeated rows are judged alike.  An empty table or benchmark takes nothing away.
    """
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources evened out until the smallest would be repeated more than twice; a row for each draw.

    Nulls: a null source is a source of its own; a null or empty text has no tokens and is drawn where it falls in its source.  Very long texts
    take up their words of the budget.  Ties in the permutation go by id.  Rows repeated whole are drawn as one.  An empty table stays empty.
    """
    return mixing.mixed(docs, max_repeats=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in the bit-plane container; returns its document index as read back.

    Nulls: a null text is its end id alone; null ids come first.  Very long texts span blocks.  Ties and repeated rows: rows of one
    id are ordered by text, and each is written.  An empty table gives an empty container and no rows.
    """
    return tokenids.read_index(tokenids.write_ids(docs))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix_sources", mix_sources), ("token_ids", token_ids)]

#: SQL expresses neither SimHash over XXH64 nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written on its way, and the table before it, go when its result is whole."""
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with common.cleared():
            out = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if before is not None:
            common.dropped(before)
        docs = before = out
    return STAGES[-1][1](spark, docs, sf_dir)
