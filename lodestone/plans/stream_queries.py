"""Streaming twins of batch queries, drained over the tables' files."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import episodes as S
from .registry import query, rounded

_names = itertools.count()
#: The tables hold one month: state that is kept for longer sees all of it.
MONTHS = "60 days"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a file source reads folders or patterns, and so either form of a table
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


@query("SELECT user_id AS episode, event_id AS ord, max((value >= 90)::INT) OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS escalated FROM events")
def stream_sticky_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _events(spark, sf_dir).select(F.col("user_id").alias("episode"), F.col("event_id").alias("ord"), F.col("value").alias("prob"), "ts")
    return S.drain(S.escalations(turns, 90.0, idle=MONTHS), f"sticky_{next(_names)}").select("episode", "ord", "escalated")


@query("SELECT DISTINCT user_id AS domain, event_type AS task_id FROM events WHERE event_type <> 'error'")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("domain"), F.col("event_type").alias("task_id"), F.expr("CASE WHEN event_type = 'error' THEN 'failed' END").alias("error"), "ts")
    return S.drain(S.completed_once(rows, ["domain", "task_id"], "ts", MONTHS), f"resume_{next(_names)}").select("domain", "task_id")


@query("SELECT event_type AS signature, CASE WHEN user_id % 2 = 0 THEN 'small' ELSE 'large' END AS model, count(*) FILTER (value >= 50)::BIGINT AS successes, count(*)::BIGINT AS total FROM events GROUP BY ALL")
def stream_skill_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _events(spark, sf_dir).select(F.col("event_type").alias("signature"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'small' ELSE 'large' END").alias("model"), (F.col("value") >= 50).alias("success"))
    return S.drain(S.running_stats(obs), f"stats_{next(_names)}", "complete")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: tumbling event-time windows with a watermark (complete mode drains them all)."""
    out = S.drain(S.windowed_outcomes(_events(spark, sf_dir)), f"windows_{next(_names)}", "complete")
    return rounded(out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total"), 6)


def _states(max_steps: int, idle_days: int) -> str:
    """The state machine's ends over events, as SQL."""
    return f"""WITH e AS (SELECT user_id::VARCHAR AS instance, event_id AS ord, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finalize' WHEN 'error' THEN 'error' ELSE 'step' END AS kind,
    CASE WHEN event_id % 4 <> 0 THEN (value >= 50)::INT::DOUBLE END AS official, (event_id % 3) / 2.0::DOUBLE AS recall FROM events),
s AS (SELECT instance, min(ord) AS begun FROM e WHERE kind = 'start' GROUP BY instance),
a AS (SELECT e.*, count(*) FILTER (kind = 'step') OVER w AS steps, coalesce(last_value(official IGNORE NULLS) OVER w, 0) AS reached FROM e JOIN s USING (instance) WHERE ord > begun AND kind <> 'start' WINDOW w AS (PARTITION BY instance ORDER BY ord)),
t AS (SELECT *, CASE WHEN kind = 'finalize' THEN 'finalized' WHEN kind = 'error' THEN 'error' WHEN steps >= {max_steps} THEN 'max_steps' END AS reason FROM a),
ends AS (SELECT instance, min(ord) AS ord FROM t WHERE reason IS NOT NULL GROUP BY instance),
last AS (SELECT instance, max(epoch_ms(ts)) AS seen FROM e GROUP BY instance),
open AS (SELECT s.instance, max_by(t.steps, t.ord) AS steps, max_by(0.5 * reached + 0.5 * recall, t.ord) AS score FROM s LEFT JOIN t USING (instance) WHERE s.instance NOT IN (SELECT instance FROM ends) GROUP BY s.instance)
SELECT instance, steps::BIGINT AS steps, CASE WHEN reason = 'error' THEN 0.0::DOUBLE ELSE round(0.5::DOUBLE * reached + 0.5::DOUBLE * recall, 9) END AS score, reason FROM t JOIN ends USING (instance, ord)
UNION ALL
SELECT instance, coalesce(steps, 0)::BIGINT, round(coalesce(score, 0)::DOUBLE, 9), 'idle' FROM open JOIN last USING (instance) WHERE seen + {idle_days * 86_400_000} <= (SELECT max(epoch_ms(ts)) FROM events) - 3600000"""


@query(_states(6, 2))
def stream_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with a budget of steps, ended by errors, by themselves, or by a timer when they fall silent."""
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finalize' WHEN 'error' THEN 'error' ELSE 'step' END")
    official = F.when(F.col("event_id") % 4 != 0, (F.col("value") >= 50).cast("int").cast("double"))
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("instance"), F.col("event_id").alias("ord"), kind.alias("kind"), official.alias("official"), (F.col("event_id") % 3 / 2.0).alias("recall"), "ts")
    return rounded(S.drain(S.episode_registry(e, late="1 hour", idle="2 days", max_steps=6), f"interactions_{next(_names)}"))
