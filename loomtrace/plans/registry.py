"""Named queries over a folder of tables, with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Shared beginnings of the SQL: one row per key, the statuses and domains spelled alike.
TRAJ = """traj AS (SELECT * REPLACE (lower(trim(status)) AS status, lower(trim(domain)) AS domain) FROM trajectories WHERE run_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ingested_at DESC NULLS LAST) = 1)"""
STEP = """st AS (SELECT * FROM steps WHERE step_id IS NOT NULL AND run_id IS NOT NULL AND "index" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY step_id ORDER BY ingested_at) = 1)"""
MSG = """ms AS (SELECT * FROM messages WHERE message_id IS NOT NULL AND run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ingested_at) = 1)"""
REPLY = """rp AS (SELECT * FROM model_replies WHERE reply_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reply_id ORDER BY ingested_at) = 1)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def runs(spark: SparkSession, d: str) -> DataFrame:
    from loomtrace.operators.evaluation import latest, spelled

    return latest(table(spark, d, "trajectories"), "run_id").withColumn("status", spelled("status")).withColumn("domain", spelled("domain"))


def steps(spark: SparkSession, d: str, *columns) -> DataFrame:
    """One row per delivered step, with the columns asked for besides its keys."""
    s = table(spark, d, "steps").where("step_id IS NOT NULL AND run_id IS NOT NULL AND index IS NOT NULL")
    return s.select("step_id", "run_id", "index", *columns).dropDuplicates(["step_id"])


def messages(spark: SparkSession, d: str, *columns) -> DataFrame:
    m = table(spark, d, "messages").where("message_id IS NOT NULL AND run_id IS NOT NULL")
    return m.select("message_id", "run_id", "index", *columns).dropDuplicates(["message_id"])


def replies(spark: SparkSession, d: str, *columns) -> DataFrame:
    return table(spark, d, "model_replies").where("reply_id IS NOT NULL").select("reply_id", *columns).dropDuplicates(["reply_id"])


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
