"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of ``documents``.  ``docs`` is what the stage before it
returned, written and read again, so a stage first deletes the tables that
earlier stages made and that ``docs`` does not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from consilium.llm import jaccard_join, mixing, packing, quality_rules, secret_scans
from consilium.llm.common import Tables, collected, load, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_left = Tables()


def tidy(stage: Stage) -> Stage:
    """``stage``, which frees what earlier stages left and notes what it leaves itself."""

    @wraps(stage)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left.clear(spark, docs)
        with collected(_left):
            return stage(spark, docs, sf_dir)

    return run_


@tidy
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language's and source's core go.

    Null and empty texts fail; null ids, languages and sources and repeated rows are judged like any other.
    """
    return quality_rules.judge(docs, *docs.columns).where("kept").select(*docs.columns)


@tidy
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of alike texts stays, the one of the least id.

    Null and blank texts are like no other and stay; so does one row of a group without ids.
    """
    return jaccard_join.one_of_each(docs)


@tidy
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked; every document stays, and clean ones, null texts included, as they were."""
    return secret_scans.redact(docs)


@tidy
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each stretch of a text; null and blank texts hold none and go."""
    return mixing.mixed_documents(docs)


@tidy
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence; a null or empty text is its end token alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The covariance estimate, the permutations and the tokenizer are beyond SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again before the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
