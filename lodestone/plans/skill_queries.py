"""Skill books over traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import skills as S
from .registry import query
from .views import TASKS, TRACES, tasks, traces

_SIG = "CASE ord % 3 WHEN 0 THEN 'humaneval' WHEN 1 THEN 'mbpp' ELSE 'coding' END"


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces under the three signatures, with completions taken from the prompts."""
    t = traces(spark, sf_dir).withColumn("dataset", F.expr("CASE ord % 3 WHEN 0 THEN 'HumanEval' WHEN 1 THEN 'mbpp' ELSE dataset END"))
    return t.withColumn("small_completion", F.md5("prompt")).withColumn("large_completion", F.concat(F.md5("prompt"), F.lit("."), F.expr("repeat('x', int(ord % 5))")))


_OBS = f"""{TRACES}, obs AS (SELECT {_SIG} AS signature, task_id, prompt, ord, 'small' AS model, small_success AS success, md5(prompt) AS completion FROM traces
  UNION ALL SELECT {_SIG}, task_id, prompt, ord, 'large', large_success, md5(prompt) || '.' || repeat('x', (ord % 5)::INT) FROM traces WHERE NOT large_skipped)"""


@query(f"WITH {_OBS} SELECT signature, model, count(*) FILTER (success)::BIGINT AS successes, count(*)::BIGINT AS total FROM obs GROUP BY signature, model")
def skill_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stats(S.observations(_coded(spark, sf_dir)))


@query(f"WITH {_OBS} SELECT signature, model, 2 * count(*) FILTER (success)::BIGINT AS successes, 2 * count(*)::BIGINT AS total FROM obs GROUP BY signature, model")
def skill_stats_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = S.stats(S.observations(_coded(spark, sf_dir)))
    return S.merge_stats(one, one)


@query(f"WITH {_OBS} SELECT signature, task_id, model FROM obs WHERE success AND prompt <> '' QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ord DESC, model) <= 10000")
def skill_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exemplars(S.observations(_coded(spark, sf_dir))).select("signature", "task_id", "model")


@query(f"WITH {_OBS} SELECT count(DISTINCT signature)::BIGINT AS n_skills, count(*)::BIGINT AS n_observations, string_agg(DISTINCT signature, ',' ORDER BY signature) AS signatures FROM obs")
def skill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(S.stats(S.observations(_coded(spark, sf_dir))))


@query(f"WITH {_OBS}, s AS (SELECT signature, model, count(*) FILTER (success) AS k, count(*) AS n FROM obs GROUP BY signature, model) SELECT signature, model, CASE WHEN n >= 20 THEN k / n::DOUBLE >= 0.8::DOUBLE END AS can_downgrade FROM s")
def can_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stats(S.observations(_coded(spark, sf_dir))).select("signature", "model", S.can_downgrade(F.col("successes"), F.col("total"), 0.8, 20).alias("can_downgrade"))


@query(f"WITH {_OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY length(completion), ord, model) AS rank FROM obs WHERE success AND prompt <> '') SELECT signature, rank::INT AS rank, task_id, left(trim(completion), 700) AS completion FROM r WHERE rank <= 5")
def topk_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shortest(S.exemplars(S.observations(_coded(spark, sf_dir)), most=None), 5).select("signature", "rank", "task_id", "completion")


_WHEN = " ".join(f"WHEN '{k}' THEN $${w}$$" for k, (w, _) in S.SECTIONS.items())
_STEPS = " ".join(f"WHEN '{k}' THEN $$" + "\n".join(f"{i}. {s}" for i, s in enumerate(p, 1)) + "$$" for k, (_, p) in S.SECTIONS.items())
_SKILL = f"""SELECT s AS signature, '# Skill: ' || s || CASE WHEN CASE s {_WHEN} END <> '' THEN chr(10) || chr(10) || '## When to use' || chr(10) || CASE s {_WHEN} END ELSE '' END || chr(10) || chr(10) || '## Procedure' || chr(10) || CASE s {_STEPS} END AS procedure FROM (SELECT unnest(['humaneval', 'mbpp', 'coding']) AS s)"""


@query(_SKILL)
def render_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.book(spark)


@query(f"WITH {TASKS}, k AS ({_SKILL}) SELECT task_id, CASE ord % 3 WHEN 0 THEN 'humaneval' WHEN 1 THEN 'mbpp' ELSE 'coding' END AS signature, md5(procedure) AS procedure_md5 FROM tasks JOIN k ON k.signature = CASE ord % 3 WHEN 0 THEN 'humaneval' WHEN 1 THEN 'mbpp' ELSE 'coding' END")
def skill_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).withColumn("dataset", F.expr("CASE ord % 3 WHEN 0 THEN 'HumanEval' WHEN 1 THEN 'mbpp' ELSE dataset END"))
    return S.with_skill(t, S.book(spark)).select("task_id", "signature", F.md5("procedure").alias("procedure_md5"))


_TEXT = """'Intro' || chr(10) || 'PITFALLS:' || chr(10) || '- a' || ord || chr(10) || '* b ' || chr(10) || 'none' || chr(10) || '-- c' || chr(10) || '- d' || chr(10) || '- e' || chr(10) || 'Patterns seen' || chr(10) || '- ' || dataset || chr(10) || '-'"""


@query(f"WITH {TASKS} SELECT task_id, 'a' || ord || '|b|c|d' AS pitfalls, dataset AS patterns FROM tasks")
def parse_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).select("task_id", F.expr(_TEXT).alias("text"))
    return S.lessons(t, "task_id").select("task_id", F.array_join("pitfalls", "|").alias("pitfalls"), F.array_join("patterns", "|").alias("patterns"))


_DIALOGUE = """'- x' || chr(10) || '## Common pitfalls' || chr(10) || '- a' || ord || chr(10) || '* b' || chr(10) || '- c' || chr(10) || '## Recurring patterns' || chr(10) || '- ' || dataset"""


@query(f"WITH {TASKS} SELECT task_id, 'a' || ord || '|c' AS pitfalls, dataset AS patterns FROM tasks")
def parse_dialogue_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).select("task_id", F.expr(_DIALOGUE).alias("text"))
    return S.lessons(t, "task_id", "dialogue").select("task_id", F.array_join("pitfalls", "|").alias("pitfalls"), F.array_join("patterns", "|").alias("patterns"))
