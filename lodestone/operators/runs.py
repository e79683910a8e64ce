"""Runs and their artifacts: chains, checkpoints, counters, keys of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio


def chained(runs: DataFrame, *artifacts: str, run: str = "run", cycle: str = "cycle") -> DataFrame:
    """What each cycle starts from: the last earlier artifact of its run that exists (null in the first)."""
    w = Window.partitionBy(run).orderBy(cycle).rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("*", *[F.last(a, ignorenulls=True).over(w).alias(f"previous_{a}") for a in artifacts])


def latest_checkpoint(paths: DataFrame, path: str = "path", *by: str) -> DataFrame:
    """The path of highest step, by number and not by text."""
    step = F.regexp_extract(path, r"(\d+)/?$", 1)
    numbered = paths.where(step != "").withColumn("step", step.cast("long"))
    return numbered.groupBy(*by).agg(F.max_by(path, "step").alias(path), F.max("step").alias("step"))


def first_context(traces: DataFrame, domain: str = "domain", order: str = "ord") -> DataFrame:
    """Each row with the context (task) that its domain saw first."""
    first = traces.groupBy(domain).agg(F.min_by("task_id", order).alias("context_task"))
    return traces.join(first, domain)


def lookup(tasks: DataFrame, domain: str, task_id: str) -> dict:
    """The first task of that domain and id (compared as text); an error if there is none."""
    found = tasks.where((F.col("domain") == domain) & (F.col("task_id").cast("string") == task_id)).orderBy("ord").limit(1).collect()
    if not found:
        raise KeyError(f"{domain}/{task_id}")
    return found[0].asDict(recursive=True)


def exemplar_counts(traces: DataFrame, domain: str = "domain") -> DataFrame:
    return traces.groupBy(domain).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))


def accuracy(rows: DataFrame, prob: Column, label: Column, threshold: float = 0.5) -> DataFrame:
    hit = ((prob >= threshold).cast("int") == label.cast("int")).cast("double")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"))


def correction_counts(rows: DataFrame) -> DataFrame:
    """How many corrections were found, and how many router examples say go on or hand over."""
    return rows.agg(F.count_if("corrected").alias("n_corrected"), F.count_if(F.col("label") == 0).alias("n_continue"), F.count_if(F.col("label") == 1).alias("n_escalate"))


def fallback_counts(rows: DataFrame, *by: str) -> DataFrame:
    """How often the fallback ran, and rescued what the main attempt failed."""
    rescued = F.col("fallback_used") & ~F.col("main_passed") & F.col("passed")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("fallback_used").alias("n_fallback"), F.count_if(rescued).alias("n_rescued"), ratio(F.count_if(rescued), F.count_if("fallback_used")).alias("rescue_rate"))


def low_rank_pairs(keys: DataFrame, key: str = "key") -> DataFrame:
    """stem, a, b: the two factors of each adapted weight; a factor without its other is an error."""
    part = F.regexp_extract(key, r"\.lora_([AB])\.", 1)
    rows = keys.where(part != "").select(F.regexp_replace(key, r"\.lora_[AB]\.", ".").alias("stem"), part.alias("part"), F.col(key).alias("key"))
    pairs = rows.groupBy("stem").agg(F.max(F.when(F.col("part") == "A", F.col("key"))).alias("a"), F.max(F.when(F.col("part") == "B", F.col("key"))).alias("b"))
    alone = F.raise_error(F.concat(F.lit("factor without its other: "), F.col("stem"))).cast("string")
    return pairs.select("stem", *[F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col(c)).otherwise(alone).alias(c) for c in ("a", "b")])
