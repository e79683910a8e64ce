"""Scans, projections, filters and aggregates over code traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dataset_name as name_of
from ..functions import falsy_default, sha256_mod, signature as signature_of, stable_fraction as fraction_of
from ..operators import curation as C
from ..operators import traces as T
from .registry import query, rounded
from .views import TASKS, TRACES, sql_fraction, sql_mod, table, tasks, traces

Q = F.expr


@query(f"WITH {TRACES} SELECT task_id, dataset, small_success, large_success FROM traces WHERE small_success IS NOT NULL AND large_success IS NOT NULL")
def scan_valid_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.valid_outcomes(traces(spark, sf_dir)).select("task_id", "dataset", "small_success", "large_success")


@query(f"WITH {TRACES} SELECT task_id, small_success, large_success, small_pass_count::BIGINT AS small_pass_count FROM traces")
def mock_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("task_id", "small_success", "large_success", F.col("small_pass_count").cast("long").alias("small_pass_count"))


_IDS = "CASE ord % 4 WHEN 0 THEN 'HumanEval/' || ord WHEN 1 THEN 'mbpp_' || ord ELSE task_id END"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).select("ord", Q("CASE ord % 4 WHEN 0 THEN 'HumanEval/' || ord WHEN 1 THEN 'mbpp_' || ord ELSE task_id END").alias("id"), Q("CASE WHEN ord % 4 = 2 THEN upper(source) END").alias("src"), "dataset")


@query(f"WITH {TASKS} SELECT {_IDS} AS id, CASE WHEN ord % 4 = 0 THEN 'humaneval' WHEN ord % 4 = 1 THEN 'mbpp' WHEN ord % 4 = 2 THEN lower(source) ELSE 'code' END AS name FROM tasks")
def dataset_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("id", name_of(F.col("id"), F.col("src")).alias("name"))


@query(f"WITH {TASKS} SELECT {_IDS} AS id, CASE ord % 4 WHEN 0 THEN 'humaneval' WHEN 1 THEN 'mbpp' ELSE 'coding' END AS signature FROM tasks")
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("id", signature_of(F.concat(F.lit(" "), name_of(F.col("id"), F.col("src")), F.lit("\t"))).alias("signature"))


@query(f"WITH {TASKS} SELECT task_id, 'system' AS first_role, length(concat($${C.TASK_INTRO}$$, CASE WHEN ord % 2 = 0 THEN 'Do it.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END, prompt))::BIGINT AS user_chars, md5(concat($${C.TASK_INTRO}$$, CASE WHEN ord % 2 = 0 THEN 'Do it.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END, prompt)) AS user_md5 FROM tasks")
def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = C.chat_prompt(F.col("prompt"), Q("CASE WHEN ord % 2 = 0 THEN 'Do it.' ELSE '' END"))
    df = tasks(spark, sf_dir).withColumn("m", chat)
    return df.select("task_id", Q("m[0].role").alias("first_role"), Q("CAST(length(m[1].content) AS BIGINT)").alias("user_chars"), Q("md5(m[1].content)").alias("user_md5"))


_KEY = """'{"large_use_skills": false, "max_tokens": 1024, "model": "large", "prompt": ' || to_json(dataset || ' ' || source)::VARCHAR || ', "repair_turns": 2, "task_id": ' || to_json(task_id)::VARCHAR || ', "temperature": 0.0}'"""


@query(f"WITH {TASKS} SELECT task_id, sha256({_KEY}) AS cache_key FROM tasks")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).select("task_id", C.cache_key(F.col("task_id"), F.concat_ws(" ", "dataset", "source"), "large", 0.0, 1024, 2).alias("cache_key"))


@query(f"WITH {TASKS} SELECT task_id, round((n_chars * 0.15::DOUBLE + length(dataset) * 0.6::DOUBLE) / 1000000, 9) AS cost FROM tasks")
def priced_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tasks(spark, sf_dir).select("task_id", T.priced_cost(F.col("n_chars"), F.length("dataset"), 0.15, 0.6).alias("cost")))


_POLICY = """SELECT task_id,
  CASE WHEN policy_route = 'large' OR NOT small_success THEN 'large' ELSE 'small' END AS final_model,
  CASE WHEN policy_route <> 'large' AND small_success THEN true WHEN large_skipped THEN NULL ELSE large_success END AS final_success,
  round(CASE WHEN policy_route <> 'large' AND small_success THEN small_cost WHEN large_skipped THEN NULL WHEN policy_route = 'large' THEN large_cost ELSE small_cost + large_cost END, 9) AS total_cost,
  CASE WHEN policy_route = 'large' THEN 'policy:route_large' || CASE WHEN large_skipped THEN '(unknown:large_skipped)' ELSE '' END
       WHEN small_success THEN 'policy:small_ok' ELSE 'policy:small_fail->large' || CASE WHEN large_skipped THEN '(unknown:large_skipped)' ELSE '' END END AS decision,
  policy_route <> 'large' AND NOT small_success AS used_fallback FROM traces"""


@query(f"WITH {TRACES} {_POLICY}")
def apply_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.deployment(*(F.col(c) for c in ("small_success", "large_success", "large_skipped", "policy_route", "small_cost", "large_cost")), F.lit(1.0), F.lit(2.0))
    df = traces(spark, sf_dir).withColumn("p", p)
    return rounded(df.select("task_id", "p.final_model", "p.final_success", "p.total_cost", "p.decision", "p.used_fallback"))


@query(f"""WITH {TRACES}, c AS (SELECT *, ord % 3 = 0 AS cached, NOT small_success OR policy_route = 'large' AS ran FROM traces)
SELECT task_id, small_success, small_pass_count::BIGINT AS small_pass_count, round(small_pass_count / 3.0::DOUBLE, 9) AS small_pass_rate, cached AS large_cache_hit,
  NOT ran AND NOT cached AS large_skipped, (ran OR cached) AND large_success AS large_success,
  CASE WHEN small_success AND ran THEN 'oracle:small_OK+large_run' WHEN small_success THEN 'probe:small->small_OK' WHEN large_success THEN 'probe:small_fail->large_OK' ELSE 'probe:small_fail->large_fail' END AS decision,
  CASE WHEN small_success THEN 'small' ELSE 'large' END AS final_model FROM c""")
def collect_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir).drop("large_skipped")
    cache = t.where("ord % 3 = 0").select("task_id", F.col("large_success").alias("cached_success"))
    out = C.collected(t.join(cache, "task_id", "left"))
    return rounded(out.select("task_id", "small_success", F.col("small_pass_count").cast("long").alias("small_pass_count"), "small_pass_rate", "large_cache_hit", "large_skipped", "large_success", "decision", "final_model"))


@query(f"WITH {TRACES} SELECT task_id, (NOT small_success AND large_success)::INT AS need_large FROM traces")
def need_large_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("task_id", T.need_large(F.col("small_success"), F.col("large_success")).cast("int").alias("need_large"))


@query(f"WITH {TRACES} SELECT task_id, (NOT small_success AND large_success)::INT AS rescue FROM traces")
def rescue_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("task_id", T.rescue(F.col("small_success"), F.col("large_success")).cast("int").alias("rescue"))


@query(f"WITH {TRACES} SELECT task_id, CASE WHEN small_success AND shard < 2 THEN 'oracle:small_OK+large_run' WHEN small_success THEN 'probe:small->small_OK' WHEN large_success THEN 'probe:small_fail->large_OK' ELSE 'probe:small_fail->large_fail' END AS decision FROM traces")
def oracle_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("task_id", T.oracle_decision(F.col("small_success"), F.col("large_success"), F.col("shard") < 2).alias("decision"))


@query(f"WITH {TASKS} SELECT task_id, CASE WHEN least(4096 - n_chars, 2000 - n_chars // 2) > 0 THEN least(1024, 4096 - n_chars, 2000 - n_chars // 2) END::BIGINT AS max_tokens FROM tasks")
def bounded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).select("task_id", T.bounded_tokens(F.lit(1024).cast("long"), 4096 - F.col("n_chars"), Q("2000 - n_chars DIV 2")).alias("max_tokens"))


@query(f"WITH {TRACES} SELECT task_id, round(0.5::DOUBLE * small_success::INT + 0.5::DOUBLE * (small_pass_count / 3.0::DOUBLE), 9) AS reward FROM traces")
def shaped_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(traces(spark, sf_dir).select("task_id", T.shaped_reward(F.col("small_success").cast("double"), F.col("small_pass_count") / F.lit(3.0)).alias("reward")))


@query(f"WITH {TASKS} SELECT task_id FROM tasks WHERE source = 'src1' ")
def split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_rows(tasks(spark, sf_dir).withColumnRenamed("source", "split"), "src1", has_split=True).select("task_id")


@query(f"WITH {TASKS} SELECT task_id FROM (SELECT task_id, row_number() OVER (ORDER BY ord) - 1 AS i FROM tasks) WHERE i % 2 = 1")
def split_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_rows(tasks(spark, sf_dir), "eval", has_split=False).select("task_id")


@query(f"WITH {TASKS} SELECT task_id, {sql_mod('sha256(task_id)', 8, 5)} AS shard FROM tasks")
def hash_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).select("task_id", sha256_mod(F.col("task_id"), 5).alias("shard"))


@query(f"WITH {TASKS} SELECT task_id FROM tasks WHERE {sql_mod('sha256(task_id)', 8, 5)} IN (0, 2, 3)")
def hash_shard_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sharded(tasks(spark, sf_dir), 5, [0, 2, 3]).select("task_id")


@query(f"WITH {TASKS}, s AS (SELECT task_id, ord FROM tasks WHERE {sql_mod('sha256(task_id)', 8, 3)} = 1) SELECT task_id FROM s ORDER BY ord LIMIT 40 OFFSET 10")
def shard_offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.window_of(C.sharded(tasks(spark, sf_dir), 3, [1]), "ord", 10, 40).select("task_id")


@query(f"WITH {TASKS} SELECT task_id, {sql_fraction(chr(39) + '7:' + chr(39) + ' || task_id')} AS fraction FROM tasks")
def stable_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).select("task_id", fraction_of(F.col("task_id"), 7).alias("fraction"))


@query(f"WITH {TRACES} SELECT count(*)::BIGINT AS n_tasks, round(avg((small_pass_count = 3)::INT), 9) AS all_small_pass_rate, round(avg((small_pass_count = 0)::INT), 9) AS all_small_fail_rate, round(avg((small_pass_count IN (1, 2))::INT), 9) AS mixed_small_reward_rate, round(avg(small_pass_count / 3.0::DOUBLE), 9) AS mean_small_pass_rate FROM traces")
def trace_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.diagnostics(traces(spark, sf_dir)))


@query(f"WITH {TRACES} SELECT dataset, count(*)::BIGINT AS n, count(*) FILTER (small_success)::BIGINT AS passes, round(avg(small_success::INT), 9) AS pass_rate, grouping(dataset)::INT AS is_total FROM traces GROUP BY ROLLUP(dataset)")
def pass_at_1_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.pass_rates(traces(spark, sf_dir)))


@query(f"WITH {TRACES} SELECT task_id, small_pass_count::BIGINT AS small_pass_count, round(small_pass_count / 3.0::DOUBLE, 9) AS small_pass_rate, small_success FROM traces")
def pass_at_k_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.pass_at_samples(tasks(spark, sf_dir), 3))


@query(f"WITH {TRACES} SELECT count(*)::BIGINT AS n_eval, round(avg(small_success::INT), 9) AS small_direct_pass, round(avg(large_success::INT), 9) AS large_only_pass, round(avg((small_success OR large_success)::INT), 9) AS verifier_cascade_pass FROM traces")
def pretrain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.pretrain_summary(traces(spark, sf_dir)))


@query(f"WITH {TRACES} SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY l)::INT - 1 AS sample, l AS label FROM (SELECT task_id, unnest(list_concat(list_resize([]::INT[], 3 - r, 0), list_resize([]::INT[], r, 1))) AS l FROM (SELECT *, CASE WHEN large_success THEN 3 - small_pass_count ELSE 0 END AS r FROM traces))")
def binomial_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.binomial_examples(traces(spark, sf_dir)).select("task_id", "sample", "label")


@query("""WITH e AS (SELECT user_id AS k, event_id AS ord, event_type, value FROM events)
SELECT k, min(ord) AS first_seen, arg_max(event_type, ord) AS event_type, round(arg_max(value, ord), 9) AS value FROM e GROUP BY k""")
def cache_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("ord"), "event_type", "value")
    return rounded(T.last_wins(e, "k", "ord").select("k", "first_seen", "event_type", "value"))


@query(f"WITH {TASKS} SELECT prompt_md5, min(ord) AS first_seen, max(ord) AS ord FROM (SELECT md5(prompt) AS prompt_md5, ord FROM tasks) GROUP BY prompt_md5")
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks(spark, sf_dir).select(F.md5("prompt").alias("prompt_md5"), "ord")
    return T.last_wins(rows, "prompt_md5", "ord").select("prompt_md5", "first_seen", "ord")


_CACHE = "cache AS (SELECT task_id, prompt AS cached FROM tasks WHERE ord % 3 = 0)"


@query(f"WITH {TRACES}, {_CACHE} SELECT t.task_id, c.task_id IS NOT NULL AS large_cache_hit, small_success AND c.task_id IS NULL AS large_skipped FROM traces t LEFT JOIN cache c USING (task_id)")
def cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    cache = tasks(spark, sf_dir).where("ord % 3 = 0").select("task_id", F.lit(True).alias("hit"))
    return t.join(cache, "task_id", "left").select("task_id", F.coalesce("hit", F.lit(False)).alias("large_cache_hit"), (F.col("small_success") & F.col("hit").isNull()).alias("large_skipped"))


@query(f"WITH {TASKS}, {_CACHE} SELECT task_id FROM tasks ANTI JOIN cache USING (task_id)")
def cache_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir)
    return C.pending(t, t.where("ord % 3 = 0"), ["task_id"]).select("task_id")


@query(f"WITH {TRACES} SELECT dataset, task_id FROM traces ANTI JOIN (SELECT dataset, task_id FROM traces WHERE small_success AND shard <> 4) d USING (dataset, task_id)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    logged = t.where("shard <> 4").withColumn("error", Q("CASE WHEN NOT small_success THEN 'timeout' END"))
    return C.resume(t, logged, ["dataset", "task_id"]).select("dataset", "task_id")


@query(f"WITH {TASKS} SELECT i::INT AS cycle, (['1e-6','5e-6','2e-6'])[least(i, 2) + 1] AS rate FROM range(6) t(i)")
def schedule_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(6).select(F.col("id").cast("int").alias("cycle"), C.schedule_value("1e-6,5e-6,2e-6", F.col("id")).alias("rate"))


@query(f"WITH {TASKS} SELECT source, count(*)::BIGINT AS n, (count(*) // 16 * 16)::BIGINT AS kept FROM tasks GROUP BY source")
def chunk_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return tasks(spark, sf_dir).groupBy("source").agg(n.alias("n"), C.chunk_aligned(n, 16).alias("kept"))


@query(f"WITH {TRACES} SELECT task_id, CASE WHEN router_prob >= 0.5::DOUBLE THEN 'large' ELSE 'small' END AS route, round(router_prob, 9) AS prob FROM traces")
def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(traces(spark, sf_dir).select("task_id", F.when(F.col("router_prob") >= 0.5, "large").otherwise("small").alias("route"), F.col("router_prob").alias("prob")))


@query(f"""WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN dataset = 'de' THEN 1 ELSE 0 END, dataset ORDER BY ord) AS rn FROM tasks)
SELECT dataset AS domain, task_id, CASE WHEN dataset <> 'de' THEN CASE WHEN ord % 2 = 0 THEN 'TRAIN' ELSE 'EVAL' END WHEN rn <= 8 THEN 'EVAL' ELSE 'TRAIN' END AS bucket FROM r""")
def task_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).select(F.col("dataset").alias("domain"), "task_id", "ord", Q("CASE WHEN ord % 2 = 0 THEN 'TRAIN' ELSE 'EVAL' END").alias("bucket"))
    return C.substituted_partition(t, "de", 8).select("domain", "task_id", "bucket")


@query(f"WITH {TRACES} SELECT task_id, CASE WHEN small_success AND large_success THEN 'a' ELSE 'b' END AS side FROM traces WHERE (small_success AND shard < 2) <> (large_success AND shard < 3)")
def paired_key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    a, b = t.where("small_success AND shard < 2").select("task_id"), t.where("large_success AND shard < 3").select("task_id")
    diff = a.exceptAll(b).unionByName(b.exceptAll(a))
    return diff.join(t, "task_id").select("task_id", Q("CASE WHEN small_success AND large_success THEN 'a' ELSE 'b' END").alias("side"))


@query(f"WITH {TRACES} SELECT task_id, attempt, reward FROM (SELECT task_id, s AS attempt, CASE s WHEN 0 THEN small_pass_count // 2 WHEN 1 THEN large_success::INT ELSE small_success::INT END AS reward, small_success AND s = 2 AS ok FROM traces, range(3) t(s)) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ok DESC, reward DESC, attempt) = 1")
def best_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir).select("task_id", "small_success", "large_success", "small_pass_count", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("attempt"))
    t = t.select("task_id", "attempt", Q("CAST(CASE attempt WHEN 0 THEN small_pass_count DIV 2 WHEN 1 THEN int(large_success) ELSE int(small_success) END AS INT)").alias("reward"), Q("small_success AND attempt = 2").alias("ok"))
    return T.best_attempt(t, ["task_id"], ["ok", "reward"]).select("task_id", "attempt", "reward")


@query(f"WITH {TRACES} SELECT dataset, count(*)::BIGINT AS n_rows, count(DISTINCT task_id)::BIGINT AS n_keys, count(*) FILTER (NOT large_success)::BIGINT AS n_errors, count(*) = count(DISTINCT task_id) AND count(*) FILTER (NOT large_success) = 0 AND count(*) = 97 AS complete FROM traces GROUP BY dataset")
def trace_complete_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir).withColumn("error", Q("CASE WHEN NOT large_success THEN 'failed' END"))
    return C.complete_gate(t, ["task_id"], 97, "dataset")


@query(f"WITH {TASKS} SELECT task_id, CASE WHEN ord % 5 = 0 THEN 0.25::DOUBLE ELSE ord::DOUBLE END AS cost FROM tasks")
def falsy_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).select("task_id", falsy_default(Q("CASE WHEN ord % 5 <> 0 THEN ord WHEN ord % 10 = 0 THEN 0 END"), 0.25).alias("cost"))
