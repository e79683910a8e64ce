"""Task selection, prompts, caches and dataset curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dataset_name, row_index, sha256_mod
from .traces import oracle_decision

# The texts of the prompts.
SYSTEM_PROMPT = "You are a Python coding assistant. Return only valid Python code. Do not include Markdown fences, explanations, examples, or tests."
TASK_INTRO = "Complete the following Python function. Return only the complete code needed to solve the task.\n\n"


def valid_outcomes(traces: DataFrame) -> DataFrame:
    return traces.where(F.col("small_success").isNotNull() & F.col("large_success").isNotNull())


def split_rows(rows: DataFrame, split: str, has_split: bool | None = None, order: str = "ord", strict: bool = True) -> DataFrame:
    """By the split column where the data have one, else even rows train and odd rows the rest."""
    if has_split is None:
        has_split = "split" in rows.columns
    if has_split:
        return rows.where(F.col("split") == split)
    if split != "train" and strict and split not in ("val", "eval", "test"):
        raise ValueError(f"unknown split: {split}")
    return row_index(rows, order, "_i").where(F.col("_i") % 2 == (0 if split == "train" else 1)).drop("_i")


def sharded(rows: DataFrame, modulus: int, remainders: list[int], key: str = "task_id") -> DataFrame:
    if any(not 0 <= r < max(modulus, 1) for r in remainders):
        raise ValueError(f"remainders {remainders} of {modulus}")
    return rows if modulus <= 1 else rows.where(sha256_mod(F.col(key), modulus).isin(remainders))


def window_of(rows: DataFrame, order: str, offset: int = 0, limit: int = -1) -> DataFrame:
    out = rows.orderBy(order)
    out = out.offset(offset) if offset else out
    return out if limit < 0 else out.limit(limit)


def chat_prompt(prompt: Column, procedure: Column | None = None) -> Column:
    """System and user message; a procedure stands before the problem."""
    problem = prompt if procedure is None else F.when(F.coalesce(procedure, F.lit("")) != "", F.concat(procedure, F.lit("\n\n---\n\n"), prompt)).otherwise(prompt)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", F.concat(F.lit(TASK_INTRO), problem)))


def json_string(text: Column) -> Column:
    """The text as a JSON string literal."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def cache_key(task_id: Column, prompt: Column, model: str, temperature: float, max_tokens: int, repair_turns: int) -> Column:
    """SHA-256 of the request in canonical JSON (sorted keys)."""
    text = F.concat(
        F.lit(f'{{"large_use_skills": false, "max_tokens": {max_tokens}, "model": "{model}", "prompt": '), json_string(prompt),
        F.lit(f', "repair_turns": {repair_turns}, "task_id": '), json_string(task_id), F.lit(f', "temperature": {temperature}}}'),
    )
    return F.sha2(text, 256)


def collected(rows: DataFrame, probe_only: bool = True) -> DataFrame:
    """Outcomes as a collector stores them; ``cached_success`` is null where the cache has no entry."""
    s, l = F.col("small_success"), F.col("large_success")  # noqa: E741
    ran = F.lit(not probe_only) | ~s | (F.col("policy_route") == "large")
    hit = F.col("cached_success").isNotNull()
    have = ran | hit
    return (
        rows.withColumn("_ran", ran)
        .withColumn("large_cache_hit", hit)
        .withColumn("large_skipped", ~have)
        .withColumn("decision", oracle_decision(s, F.coalesce(F.col("cached_success"), l), F.col("_ran")))
        .withColumn("large_success", have & F.coalesce(F.col("cached_success"), l))
        .withColumn("small_pass_rate", F.col("small_pass_count") / F.col("small_samples").cast("double"))
        .withColumn("final_model", F.when(s, "small").otherwise("large"))
        .drop("_ran")
    )


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return tasks.join(done.select(*keys), keys, "left_anti")


def require_cached(tasks: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The tasks, if the cache has them all; an error otherwise."""
    missing = pending(tasks, cache, keys).count()
    if missing:
        raise ValueError(f"{missing} tasks are not in the cache")
    return tasks


def resume(tasks: DataFrame, logged: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that the log has not, or has only with an error."""
    return pending(tasks, without_errors(logged), keys)


def without_errors(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("error", F.lit("")) == "")


def schedule_value(values: str, cycle: Column) -> Column:
    """The cycle's entry of a comma-separated list; the last one serves all later cycles."""
    parts = F.split(F.lit(values), ",")
    return F.element_at(parts, (F.least(cycle, F.size(parts) - 1) + 1).cast("int"))


def chunk_aligned(n: Column, chunk: int) -> Column:
    return (F.floor(n / chunk) * chunk).cast("long")


def substituted_partition(rows: DataFrame, domain: str, first: int, order: str = "ord") -> DataFrame:
    """One domain's buckets are replaced: its first rows evaluate, the rest train."""
    rest = rows.where(F.col("domain") != domain)
    own = rows.where(F.col("domain") == domain).withColumn("_r", F.row_number().over(Window.partitionBy("domain").orderBy(order)))
    return rest.unionByName(own.withColumn("bucket", F.when(F.col("_r") <= first, "EVAL").otherwise("TRAIN")).drop("_r"))


def complete_gate(rows: DataFrame, keys: list[str], expected: int, *by: str) -> DataFrame:
    n, k = F.count("*"), F.count_distinct(*keys)
    errors = F.count_if(F.coalesce("error", F.lit("")) != "")
    return rows.groupBy(*by).agg(n.alias("n_rows"), k.alias("n_keys"), errors.alias("n_errors"), ((n == k) & (n == expected) & (errors == 0)).alias("complete"))


def teacher_pairs(traces: DataFrame) -> DataFrame:
    """Prompts that small fails and large solves, with the large completion."""
    keep = ~F.col("small_success") & F.col("large_success") & (F.coalesce("large_completion", F.lit("")) != "") & (F.coalesce("prompt", F.lit("")) != "")
    return traces.where(keep).select("task_id", "prompt", F.col("large_completion").alias("completion"), F.lit("teacher").alias("source"))


def self_repair_pairs(traces: DataFrame) -> DataFrame:
    """Prompts whose first turn fails and whose last one succeeds, with the last completion."""
    first, last = F.try_element_at("small_turns", F.lit(1)), F.try_element_at("small_turns", F.lit(-1))
    keep = (F.size("small_turns") >= 2) & ~F.coalesce(first["success"], F.lit(False)) & F.coalesce(last["success"], F.lit(False)) & (F.coalesce(last["completion"], F.lit("")) != "")
    return traces.where(keep & (F.coalesce("prompt", F.lit("")) != "")).select("task_id", "prompt", last["completion"].alias("completion"), F.lit("self_repair").alias("source"))


def sft_pairs(traces: DataFrame, procedure: Column | None = None) -> DataFrame:
    both = teacher_pairs(traces).unionByName(self_repair_pairs(traces))
    chat = chat_prompt(F.col("prompt"), procedure)
    reply = F.array(F.struct(F.lit("assistant").alias("role"), F.col("completion").alias("content")))
    return both.select(F.concat(chat, reply).alias("messages"), "source", "task_id", F.lit(procedure is not None).alias("has_procedure"))


def rl_rows(tasks: DataFrame, split: str, procedure: Column | None = None, limit: int = -1, order: str = "ord", source: str | None = None) -> DataFrame:
    """Nested rows for reinforcement learning: chat prompt, JSON ground truth, and where each came from."""
    rows = window_of(tasks, order, 0, limit)
    name = dataset_name(F.col("task_id"), F.col(source) if source else F.lit(None).cast("string"))
    truth = F.to_json(F.struct("task_id", "prompt", *[F.col(c) for c in ("entry_point", "test") if c in tasks.columns]))
    rows = row_index(rows, order, "_i").withColumn("_d", name)
    return rows.select(
        F.concat(F.lit("code/"), "_d").alias("data_source"),
        chat_prompt(F.col("prompt"), procedure).alias("prompt"),
        F.lit("code").alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col("_i").cast("long").alias("index"), "task_id", F.col("_d").alias("dataset"), F.lit(procedure is not None).alias("has_procedure")).alias("extra_info"),
    )


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (compared as strings) in the given order."""
    w = Window.partitionBy(*[F.col(k).cast("string") for k in keys]).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def balanced(rows: DataFrame, domain: str = "domain", order: str = "ord") -> DataFrame:
    """Every domain repeated to the size of the largest; ``slot`` numbers its rows."""
    sizes = rows.groupBy(domain).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_target", F.max("_n").over(Window.partitionBy()))
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(domain).orderBy(order)) - 1).join(sizes, domain)
    copies = F.expr("sequence(_rn, _target - 1, _n)")
    return numbered.where("_rn < _target").withColumn("slot", F.explode(copies)).drop("_rn", "_n", "_target")


def interleaved(rows: DataFrame, domain: str = "domain", order: str = "ord") -> DataFrame:
    """Balanced, and emitted round-robin by slot and domain."""
    return balanced(rows, domain, order).orderBy("slot", domain)


def shuffled(rows: DataFrame, seed: int, *key: str) -> DataFrame:
    """A deterministic order by hash of seed and key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), *key)


def curation_counts(rows: DataFrame) -> DataFrame:
    """Counters of demonstration curation over flags passed, complete, has_target, fallback_used, opd_used.

    With domain and task_id also how many tasks remain, and how many rows once
    every domain is repeated to the size of the largest.
    """
    kept = F.col("passed") & F.col("complete")
    if {"domain", "task_id"} <= set(rows.columns):
        by = rows.where(kept & F.col("has_target")).groupBy("domain").agg(F.count_distinct(F.col("task_id").cast("string")).alias("_u"))
        by = by.agg(F.coalesce(F.sum("_u"), F.lit(0)).alias("n_unique"), F.coalesce(F.max("_u") * F.count("*"), F.lit(0)).alias("n_balanced"))
        return curation_counts(rows.drop("domain")).crossJoin(by)
    return rows.agg(
        F.count("*").alias("n_total"), F.count_if(F.col("passed") & ~F.col("complete")).alias("n_incomplete"), F.count_if(kept & ~F.col("has_target")).alias("n_without_target"),
        F.count_if(kept & F.col("has_target")).alias("n_kept"), F.count_if(kept & F.col("fallback_used")).alias("n_fallback"), F.count_if(kept & F.col("opd_used")).alias("n_opd"),
    )
