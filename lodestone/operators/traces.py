"""Row-wise operators over code traces: outcomes, costs, labels, deployment policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import falsy_default, md5_mod, ratio

SMALL_COST, LARGE_COST = 0.001, 0.01
#: Of ten digests, those for which a made-up call of each role passes.
MOCK_BARS = {"small": 7, "large": 9}


def mock_success(task_id: Column, role: str, cycle: int = 0, sample: Column | int = 0) -> Column:
    """A deterministic outcome: small passes for 7 of 10 digests, large for 9 of 10."""
    sample = sample if isinstance(sample, Column) else F.lit(sample)
    key = F.concat_ws("|", task_id, F.lit(role), F.lit(str(cycle)), sample.cast("string"))
    return md5_mod(key, 10) < MOCK_BARS[role]


def mock_traces(tasks: DataFrame, samples: int = 3, cycle: int = 0) -> DataFrame:
    """Adds small and large outcomes; the served small result is sample 0."""
    passes = [mock_success(F.col("task_id"), "small", cycle, k) for k in range(samples)]
    return (
        tasks.withColumn("small_success", passes[0])
        .withColumn("large_success", mock_success(F.col("task_id"), "large", cycle))
        .withColumn("small_pass_count", sum((p.cast("int") for p in passes[1:]), passes[0].cast("int")))
        .withColumn("small_samples", F.lit(samples))
    )


def priced_cost(prompt_tokens: Column, completion_tokens: Column, per_million_in: float, per_million_out: float) -> Column:
    return (F.coalesce(prompt_tokens, F.lit(0)).cast("double") * per_million_in + F.coalesce(completion_tokens, F.lit(0)).cast("double") * per_million_out) / 1_000_000


def large_needed(small_success: Column, route: Column, probe_only: bool = True) -> Column:
    """Whether the large model runs: always unless probing, else after a small failure or by route."""
    return F.lit(not probe_only) | ~small_success | (route == "large")


def deployment(small_success: Column, large_success: Column, skipped: Column, route: Column, small_cost: Column, large_cost: Column, small_latency: Column, large_latency: Column) -> Column:
    """What deployment would serve: a struct of model, success, cost, latency, decision, fallback.

    Where the large model would serve but was skipped, its outcome is unknown (null).
    """
    to_large, unknown = route == "large", F.coalesce(skipped, F.lit(False))
    case = lambda large_unknown, large, small, fall_unknown, fall: (
        F.when(to_large & unknown, large_unknown).when(to_large, large).when(small_success, small).when(unknown, fall_unknown).otherwise(fall)
    )
    null_b, null_d = F.lit(None).cast("boolean"), F.lit(None).cast("double")
    return F.struct(
        case(F.lit("large"), F.lit("large"), F.lit("small"), F.lit("large"), F.lit("large")).alias("final_model"),
        case(null_b, large_success, F.lit(True), null_b, large_success).alias("final_success"),
        case(null_d, large_cost, small_cost, null_d, small_cost + large_cost).alias("total_cost"),
        case(null_d, large_latency, small_latency, null_d, small_latency + large_latency).alias("total_latency"),
        case(F.lit("policy:route_large(unknown:large_skipped)"), F.lit("policy:route_large"), F.lit("policy:small_ok"), F.lit("policy:small_fail->large(unknown:large_skipped)"), F.lit("policy:small_fail->large")).alias("decision"),
        (~to_large & ~small_success).alias("used_fallback"),
    )


def oracle_decision(small_success: Column, large_success: Column, ran_large: Column) -> Column:
    return (
        F.when(small_success & ran_large, "oracle:small_OK+large_run")
        .when(small_success, "probe:small->small_OK")
        .when(large_success, "probe:small_fail->large_OK")
        .otherwise("probe:small_fail->large_fail")
    )


def need_large(small_success: Column, large_success: Column) -> Column:
    """Small fails and large (if known) succeeds."""
    return ~small_success & F.coalesce(large_success, F.lit(True))


def rescue(small_success: Column, large_success: Column) -> Column:
    return ~small_success & large_success


def bounded_tokens(configured: Column, context_left: Column, response_left: Column) -> Column:
    """The token limit of a call, null when nothing is left."""
    room = F.least(context_left, response_left)
    return F.when(room > 0, F.least(configured, room))


def shaped_reward(official: Column, recall: Column, weight: float = 0.5) -> Column:
    return F.lit(weight) * official + F.lit(1.0 - weight) * recall


def binomial_examples(traces: DataFrame) -> DataFrame:
    """Each row as ``small_samples`` labelled rows: zeros for passes, ones for failures that large rescues."""
    n = F.greatest(F.coalesce(F.nullif(F.col("small_samples").cast("int"), F.lit(0)), F.lit(1)), F.lit(0))
    passed = F.coalesce(F.col("small_pass_count").cast("int"), F.col("small_success").cast("int"))
    known = traces.withColumn("_n", n).withColumn("_p", F.least(F.greatest(passed, F.lit(0)), F.col("_n"))).where(F.col("_p").isNotNull())
    ones = F.when(F.coalesce(F.col("large_success"), F.lit(True)), F.col("_n") - F.col("_p")).otherwise(0)
    labels = F.concat(F.array_repeat(F.lit(0), F.col("_n") - ones), F.array_repeat(F.lit(1), ones))
    return known.select("*", F.posexplode(labels).alias("sample", "label")).drop("_n", "_p")


def diagnostics(traces: DataFrame) -> DataFrame:
    """How small rewards are spread: all pass, all fail, mixed, mean rate."""
    k = F.greatest(F.lit(1), F.coalesce(F.nullif(F.col("small_samples"), F.lit(0)), F.lit(1)))
    passed = F.coalesce(F.col("small_pass_count"), F.col("small_success").cast("int"), F.lit(0))
    rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), passed.cast("double") / k))
    n, all_pass, all_fail = F.count("*"), F.count_if(F.col("_r") == 1.0), F.count_if(F.col("_r") == 0.0)
    return traces.select(rate.alias("_r")).agg(
        n.alias("n_tasks"),
        ratio(all_pass, n).alias("all_small_pass_rate"),
        ratio(all_fail, n).alias("all_small_fail_rate"),
        ratio(n - all_pass - all_fail, n).alias("mixed_small_reward_rate"),
        F.coalesce(F.avg("_r"), F.lit(0.0)).alias("mean_small_pass_rate"),
    )


def pass_rates(rows: DataFrame, success: str = "small_success", group: str = "dataset") -> DataFrame:
    """Overall (null group) and by group, in one pass over the rows."""
    return rows.rollup(group).agg(F.count("*").alias("n"), F.count_if(F.col(success)).alias("passes"), F.avg(F.col(success).cast("double")).alias("pass_rate"), F.grouping(group).cast("int").alias("is_total"))


def pass_at_samples(tasks: DataFrame, samples: int) -> DataFrame:
    """Per task, over explicit samples: passes, rate, and the outcome of sample 0."""
    rows = tasks.select("task_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    rows = rows.withColumn("ok", mock_success(F.col("task_id"), "small", 0, F.col("sample")))
    return rows.groupBy("task_id").agg(F.count_if("ok").alias("small_pass_count"), F.avg(F.col("ok").cast("double")).alias("small_pass_rate"), F.min_by("ok", "sample").alias("small_success"))


def pretrain_summary(traces: DataFrame) -> DataFrame:
    final = F.col("small_success") | F.col("large_success")
    mean = lambda c: ratio(F.count_if(c), F.count("*"), None)
    return traces.agg(F.count("*").alias("n_eval"), mean(F.col("small_success")).alias("small_direct_pass"), mean(F.col("large_success")).alias("large_only_pass"), mean(final).alias("verifier_cascade_pass"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the latest; its place is that of the first."""
    value = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(value, order).alias("_v"), F.min(order).alias("first_seen")).select("first_seen", "_v.*")


def best_attempt(attempts: DataFrame, key: list[str], keys: list[str], attempt: str = "attempt") -> DataFrame:
    """Per key the attempt of lexicographically greatest ``keys``, the earliest of equals."""
    w = Window.partitionBy(*key).orderBy(*[F.col(k).desc_nulls_last() for k in keys], F.col(attempt))
    return attempts.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def with_costs(traces: DataFrame, small: float = SMALL_COST, large: float = LARGE_COST) -> DataFrame:
    """Costs with the defaults where they are missing or zero."""
    get = lambda c: F.col(c) if c in traces.columns else F.lit(None)
    return traces.withColumn("small_cost", falsy_default(get("small_cost"), small)).withColumn("large_cost", falsy_default(get("large_cost"), large))
