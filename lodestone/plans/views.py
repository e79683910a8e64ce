"""Deterministic traces and episodes derived from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sha256_mod, stable_fraction
from ..operators import traces as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("task_id"), F.col("lang").alias("dataset"), F.col("text").alias("prompt"), F.col("doc_id").alias("ord"), "n_chars", "source")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code traces with mock outcomes; shards {0,2,3} train, {1} calibrate, {4} evaluate."""
    df = T.mock_traces(tasks(spark, sf_dir))
    df = df.withColumn("shard", sha256_mod(F.col("task_id"), 5)).withColumn("router_prob", stable_fraction(F.col("task_id"), "router"))
    df = df.withColumn("response_prob", stable_fraction(F.col("task_id"), "response")).withColumn("policy_route", F.when(F.col("router_prob") >= 0.7, "large").otherwise("small"))
    df = df.withColumn("large_skipped", F.col("small_success") & (F.col("policy_route") != "large") | (F.col("ord") % 17 == 0))
    return T.with_costs(df)



def sql_mod(digest: str, chunks: int, modulus: int) -> str:
    """DuckDB: a hex digest modulo a number."""
    return f"list_reduce([0::BIGINT] || [cast(('0x' || substr({digest}, i*8+1, 8)) AS BIGINT) FOR i IN range({chunks})], lambda a, b: (a * 4294967296 + b) % {modulus})"


def sql_fraction(key: str) -> str:
    return f"(cast(('0x' || substr(sha256({key}), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE)"


def _mock(role: str, sample: int, bar: int) -> str:
    return f"({sql_mod(f'md5(task_id || {chr(39)}|{role}|0|{sample}{chr(39)})', 4, 10)} < {bar})"


TASKS = "tasks AS (SELECT 'doc/' || doc_id AS task_id, lang AS dataset, text AS prompt, doc_id AS ord, n_chars, source FROM documents)"
TRACES = f"""{TASKS},
traces0 AS (
  SELECT *, {_mock('small', 0, 7)} AS small_success, {_mock('large', 0, 9)} AS large_success,
         {_mock('small', 0, 7)}::INT + {_mock('small', 1, 7)}::INT + {_mock('small', 2, 7)}::INT AS small_pass_count, 3 AS small_samples,
         {sql_mod('sha256(task_id)', 8, 5)} AS shard, {sql_fraction("'router:' || task_id")} AS router_prob,
         {sql_fraction("'response:' || task_id")} AS response_prob FROM tasks),
traces1 AS (SELECT *, CASE WHEN router_prob >= 0.7::DOUBLE THEN 'large' ELSE 'small' END AS policy_route FROM traces0),
traces AS (SELECT *, (small_success AND policy_route <> 'large') OR ord % 17 = 0 AS large_skipped, 0.001::DOUBLE AS small_cost, 0.01::DOUBLE AS large_cost FROM traces1)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent messages from events: one episode a user, tool names as event types."""
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("event_type") == "signup", "user").when(F.col("event_type") == "error", "tool").otherwise("assistant")
    return e.select(
        F.col("user_id").alias("episode"), F.col("event_id").alias("ord"), role.alias("role"),
        F.when(role == "assistant", F.col("event_type")).alias("tool_name"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("Error: "), F.col("props"))).otherwise(F.col("props")).alias("content"),
        F.element_at(F.array(F.lit("airline"), F.lit("retail"), F.lit("telecom")), (F.col("user_id") % 3 + 1).cast("int")).alias("domain"),
    )


MESSAGES = """messages AS (
  SELECT user_id AS episode, event_id AS ord,
         CASE event_type WHEN 'signup' THEN 'user' WHEN 'error' THEN 'tool' ELSE 'assistant' END AS role,
         CASE WHEN event_type IN ('signup', 'error') THEN NULL ELSE event_type END AS tool_name,
         CASE WHEN event_type = 'error' THEN 'Error: ' || props ELSE props END AS content,
         ['airline', 'retail', 'telecom'][(user_id % 3 + 1)::INT] AS domain FROM events)"""
