"""Run metadata, counters and text helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import runs
from .registry import query, rounded
from .views import TASKS, TRACES, tasks, traces

_RUN = "ord % 7 AS run, ord // 7 AS cycle, CASE WHEN ord % 3 = 0 THEN NULL ELSE 'book-' || ord END AS book"


@query(f"WITH {TASKS}, r AS (SELECT {_RUN} FROM tasks) SELECT run, cycle, book, last_value(book IGNORE NULLS) OVER (PARTITION BY run ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_book FROM r")
def artifact_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tasks(spark, sf_dir).select(F.expr("ord % 7").alias("run"), F.expr("ord DIV 7").alias("cycle"), F.expr("CASE WHEN ord % 3 = 0 THEN NULL ELSE 'book-' || ord END").alias("book"))
    return runs.chained(r, "book")


@query(f"WITH {TASKS}, p AS (SELECT source, 'ckpt/global_step_' || ord AS path, ord FROM tasks) SELECT source, arg_max(path, ord) AS path, max(ord) AS step FROM p GROUP BY source")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest_checkpoint(tasks(spark, sf_dir).select("source", F.concat(F.lit("ckpt/global_step_"), "ord").alias("path")), "path", "source")


@query(f"WITH {TASKS}, f AS (SELECT dataset, arg_min(task_id, ord) AS context_task FROM tasks GROUP BY dataset) SELECT task_id, context_task FROM tasks JOIN f USING (dataset)")
def context_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.first_context(tasks(spark, sf_dir), "dataset").select("task_id", "context_task")


@query(f"WITH {TRACES} SELECT dataset, count(*) FILTER (small_success)::BIGINT AS passed, count(*)::BIGINT AS total FROM traces GROUP BY dataset")
def domain_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.exemplar_counts(traces(spark, sf_dir).withColumn("passed", F.col("small_success")), "dataset")


@query(f"WITH {TRACES} SELECT count(*)::BIGINT AS n, round(avg(((router_prob >= 0.5::DOUBLE) = (NOT small_success))::INT), 9) AS accuracy FROM traces")
def train_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.accuracy(traces(spark, sf_dir), F.col("router_prob"), ~F.col("small_success")))


@query(f"WITH {TRACES} SELECT count(*) FILTER (NOT small_success AND large_success)::BIGINT AS n_corrected, count(*) FILTER (small_success)::BIGINT AS n_continue, count(*) FILTER (NOT small_success)::BIGINT AS n_escalate FROM traces")
def correction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    return runs.correction_counts(t.select((~F.col("small_success") & F.col("large_success")).alias("corrected"), (~F.col("small_success")).cast("int").alias("label")))


@query(f"WITH {TRACES} SELECT dataset, count(*)::BIGINT AS n, count(*) FILTER (NOT small_success)::BIGINT AS n_fallback, count(*) FILTER (NOT small_success AND large_success)::BIGINT AS n_rescued, round(count(*) FILTER (NOT small_success AND large_success) / count(*) FILTER (NOT small_success)::DOUBLE, 9) AS rescue_rate FROM traces GROUP BY dataset")
def fallback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir).withColumn("fallback_used", ~F.col("small_success")).withColumn("main_passed", F.col("small_success")).withColumn("passed", F.col("small_success") | F.col("large_success"))
    return rounded(runs.fallback_counts(t, "dataset"))


@query(f"WITH {TASKS} SELECT 'layer.' || ord || '.q.weight' AS stem, 'layer.' || ord || '.q.lora_A.weight' AS a, 'layer.' || ord || '.q.lora_B.weight' AS b FROM tasks")
def low_rank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.concat(F.lit("layer."), "ord", F.lit(f".q.lora_{x}.weight")) for x in "AB"], F.concat(F.lit("layer."), "ord", F.lit(".q.bias")))
    return runs.low_rank_pairs(tasks(spark, sf_dir).select(F.explode(names).alias("key")))


@query(f"""WITH {TASKS} SELECT task_id, 'E' || ord || ': no' AS last, 'q_proj|k' || ord AS modules, 'import os|from m' || ord || ' import x' AS imports, CASE WHEN ord % 2 = 0 THEN 'm' || ord ELSE 'openai/m' || ord END AS model FROM tasks""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir)
    said = F.concat(F.lit("Traceback\n  line\nE"), "ord", F.lit(": no\n \n"))
    program = F.concat(F.lit("import os\nx = 1\n  # from\nfrom m"), "ord", F.lit(" import x\n"))
    return t.select(
        "task_id", strings.last_line(said).alias("last"), F.array_join(strings.parse_list(F.concat(F.lit(" [q_proj, 'k"), "ord", F.lit("',]"))), "|").alias("modules"),
        F.array_join(strings.import_lines(program), "|").alias("imports"),
        strings.local_model(F.concat(F.lit("openai/m"), "ord"), F.when(F.col("ord") % 2 == 0, "http://127.0.0.1:8000/v1").otherwise("https://example.org/v1")).alias("model"),
    )
