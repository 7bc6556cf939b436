"""The corpus pipeline: toxic documents go, recurring lines go, one document of each group of near
copies stays, sources are mixed to their target weights, and all that is left is packed.

Each stage takes and, but for the last, returns the columns of `documents`; the mix is the order of
the rows as written, which packing reads back: sequences in order of their ids follow the mix. The
last returns one row for each piece of a document with its sequence. Nulls in any column, repeated
rows, empty tables and other columns pass through as the operators of the stages say; tables that a
stage writes on its way are deleted once its result is written.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import drop_written, settled, table
from factloom.llm.line_dedup import dedup_lines
from factloom.llm.mixing import mixed
from factloom.llm.ngram_join import one_of_each
from factloom.llm.packing import packed_along
from factloom.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, by a model of the labelled rows of the tables."""
    model = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drop_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs stay in their first document only; documents left without text go."""
    return dedup_lines(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    return one_of_each(docs, width=5, num=8, den=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: weights follow the square root of each source's size."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there; sequence ids ascend along the mix."""
    return packed_along(docs).drop("item")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("packing", packing)]
#: Trained scores and templates can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(partial(stage, spark, docs, sf_dir), name)
        drop_written(before)  # but for the table itself, which nothing here wrote
    return STAGES[-1][1](spark, docs, sf_dir)
