"""Dataset curation over traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation as C
from .registry import query
from .views import TASKS, TRACES, table, tasks, traces


def _turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with repair turns: as many as ord % 4, of which the last one succeeds where small does."""
    t = traces(spark, sf_dir).withColumn("large_completion", F.when(F.expr("ord % 11 = 0"), "").otherwise(F.md5("prompt")))
    turn = lambda i: F.struct((F.col("small_success") & (i == F.expr("int(ord % 4)"))).alias("success"), F.concat(F.lit("t"), i.cast("string")).alias("completion"))
    return t.withColumn("small_turns", F.when(F.expr("ord % 4 = 0"), F.array().cast("array<struct<success:boolean,completion:string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.expr("int(ord % 4)"), F.lit(1))), turn)))


@query(f"WITH {TRACES} SELECT task_id, md5(prompt) AS completion, 'teacher' AS source FROM traces WHERE NOT small_success AND large_success AND ord % 11 <> 0 AND prompt <> ''")
def teacher_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.teacher_pairs(_turned(spark, sf_dir)).select("task_id", "completion", "source")


@query(f"WITH {TRACES} SELECT task_id, 't' || ord % 4 AS completion, 'self_repair' AS source FROM traces WHERE small_success AND ord % 4 >= 2 AND prompt <> ''")
def self_repair_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.self_repair_pairs(_turned(spark, sf_dir)).select("task_id", "completion", "source")


@query(f"""WITH {TRACES}, p AS (SELECT task_id, prompt, md5(prompt) AS completion, 'teacher' AS source FROM traces WHERE NOT small_success AND large_success AND ord % 11 <> 0 AND prompt <> ''
  UNION ALL SELECT task_id, prompt, 't' || ord % 4, 'self_repair' FROM traces WHERE small_success AND ord % 4 >= 2 AND prompt <> '')
SELECT task_id, source, 3::BIGINT AS n_messages, md5(concat($${C.TASK_INTRO}$$, prompt)) AS user_md5, completion FROM p""")
def sft_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.sft_pairs(_turned(spark, sf_dir))
    return p.select("task_id", "source", F.size("messages").cast("long").alias("n_messages"), F.md5(F.expr("messages[1].content")).alias("user_md5"), F.expr("messages[2].content").alias("completion"))


@query(f"WITH {TASKS}, r AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS i FROM tasks) SELECT 'code/code' AS data_source, 'code' AS ability, i::BIGINT AS idx, task_id, 'train' AS split, md5(concat($${C.TASK_INTRO}$$, prompt)) AS user_md5, task_id AS truth_task FROM r")
def rl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.rl_rows(tasks(spark, sf_dir), "train")
    return r.select("data_source", "ability", F.expr("extra_info.index").alias("idx"), "extra_info.task_id", "extra_info.split", F.md5(F.expr("prompt[1].content")).alias("user_md5"), F.get_json_object("reward_model.ground_truth", "$.task_id").alias("truth_task"))


@query(f"WITH {TRACES} SELECT task_id FROM traces WHERE small_success AND small_pass_count = 3")
def verified_demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).where(F.col("small_success") & (F.col("small_pass_count") == 3)).select("task_id")


@query(f"WITH {TASKS} SELECT dataset AS domain, source AS task, min(ord) AS ord FROM tasks GROUP BY dataset, source")
def dedup_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks(spark, sf_dir).select(F.col("dataset").alias("domain"), F.col("source").alias("task"), "ord")
    return C.first_wins(rows, ["domain", "task"], ["ord"])


_BALANCED = f"""WITH {TASKS}, r AS (SELECT dataset AS domain, task_id, row_number() OVER (PARTITION BY dataset ORDER BY ord) - 1 AS rn, count(*) OVER (PARTITION BY dataset) AS n FROM tasks),
t AS (SELECT max(n) AS target FROM r) SELECT domain, task_id, slot::BIGINT AS slot FROM r, t, range(20000) s(slot) WHERE slot < target AND slot % n = rn"""


@query(_BALANCED.replace("range(20000)", "(SELECT unnest(range((SELECT count(*) FROM documents))))"))
def balance_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks(spark, sf_dir).select(F.col("dataset").alias("domain"), "task_id", "ord")
    return C.balanced(rows).select("domain", "task_id", F.col("slot").cast("long").alias("slot"))


@query(f"WITH b AS ({_BALANCED.replace('range(20000)', '(SELECT unnest(range((SELECT count(*) FROM documents))))')}) SELECT row_number() OVER (ORDER BY slot, domain)::BIGINT AS place, domain, task_id FROM b")
def interleave_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = tasks(spark, sf_dir).select(F.col("dataset").alias("domain"), "task_id", "ord")
    domains = rows.select("domain").distinct().withColumn("_d", F.row_number().over(Window.orderBy("domain"))).withColumn("_k", F.max("_d").over(Window.partitionBy()))
    # every slot holds each domain once, so a row's place follows from slot and domain alone
    b = C.balanced(rows).join(domains, "domain")
    return b.select((F.col("slot") * F.col("_k") + F.col("_d")).cast("long").alias("place"), "domain", "task_id")


@query(f"WITH {TRACES} SELECT count(*)::BIGINT AS n_total, count(*) FILTER (small_success AND small_pass_count < 3)::BIGINT AS n_incomplete, count(*) FILTER (small_pass_count = 3 AND ord % 7 = 0)::BIGINT AS n_without_target, count(*) FILTER (small_pass_count = 3 AND ord % 7 <> 0)::BIGINT AS n_kept, count(*) FILTER (small_pass_count = 3 AND ord % 2 = 0)::BIGINT AS n_fallback, count(*) FILTER (small_pass_count = 3 AND ord % 3 = 0)::BIGINT AS n_opd FROM traces")
def curation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir).select(F.col("small_success").alias("passed"), (F.col("small_pass_count") == 3).alias("complete"), F.expr("ord % 7 <> 0").alias("has_target"), F.expr("ord % 2 = 0").alias("fallback_used"), F.expr("ord % 3 = 0").alias("opd_used"))
    return C.curation_counts(t)


@query("SELECT lang AS domain, quality::BIGINT AS label, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("domain", F.col("quality").cast("long").alias("label")).agg(F.count("*").alias("n"))
