"""The query registry, and the views of the driver's tables that queries share.

A user's day acts as one sample of that user, an event type as an answer, and
the remainder of an event's id by three as the agent or source that gave it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import votes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, event_type, event_id, value): a user's days as samples."""
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id", "value")


def of_largest(item: str, score: str, order: str) -> Column:
    """The item of the largest score, of equal ones the first; rows without an item or a score do not count.

    That is max_by over a table in that order, read by one thread.
    """
    ranked = F.struct(F.col(score).alias("score"), (-F.col(order)).alias("order"), F.col(item).alias("item"))
    return F.max(F.when(F.col(item).isNotNull() & F.col(score).isNotNull(), ranked))["item"]


def user_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.vote_table(answers(spark, sf_dir), ["user_id"], "event_type", "day", "event_id")


VOTES = "once AS (SELECT user_id, event_type AS item, CAST(ts AS DATE) AS sample, min(event_id) AS pos FROM events GROUP BY ALL), votes AS (SELECT user_id, item, count(*) AS votes, min(struct_pack(s := sample, p := pos)) AS first_seen FROM once GROUP BY ALL)"
