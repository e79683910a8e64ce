"""Routing policies over traces: simulation, thresholds, stress tests, paired comparison.

A policy is a boolean column (route to the large model); simulating one adds
four columns to each row, so that any number of policies, thresholds or seeds
is one scan and one grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio, stable_fraction

REFERENCE_COST = 0.01


def outcome(large: Column, mode: str) -> Column:
    """ok, cost, direct, fallback of a row under a policy.

    mode: "direct" (no verifier), "verified" (a small failure falls back to
    large and pays both), "cascade" (small is always paid; escalating pays both
    and its outcome replaces the small one), or "cached" (where the column says
    so the answer is known and costs nothing; small serves the rest).
    """
    s, l, cs, cl = (F.col(c) for c in ("small_success", "large_success", "small_cost", "large_cost"))  # noqa: E741
    none = F.lit(False)
    if mode == "cascade":
        parts = (F.when(large, l).otherwise(s), F.when(large, cs + cl).otherwise(cs), none, large)
    elif mode == "cached":
        parts = (large | s, F.when(large, 0.0).otherwise(cs), none, none)
    else:
        fall = ~large & ~s if mode == "verified" else none
        parts = (F.when(large | fall, l).otherwise(s), F.when(large, cl).when(fall, cs + cl).otherwise(cs), large, fall)
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("ok", "cost", "direct", "fallback"))])


def summary(rows: DataFrame, *by: str, o: str = "o") -> DataFrame:
    """passes, pass_rate, avg_cost, cost_vs_large and the two rates, by group."""
    n = F.count("*")
    cost = F.sum(F.col(f"{o}.cost"))
    return rows.groupBy(*by).agg(
        n.alias("n"),
        F.count_if(F.col(f"{o}.ok")).alias("passes"),
        ratio(F.count_if(F.col(f"{o}.ok")), n).alias("pass_rate"),
        ratio(cost, n).alias("avg_cost"),
        ratio(cost, n * F.lit(REFERENCE_COST)).alias("cost_vs_large"),
        ratio(F.count_if(F.col(f"{o}.direct")), n).alias("direct_large_rate"),
        ratio(F.count_if(F.col(f"{o}.fallback")), n).alias("fallback_rate"),
    )


def simulate(rows: DataFrame, large: Column, mode: str, *by: str) -> DataFrame:
    return summary(rows.withColumn("o", outcome(large, mode)), *by)


def compare(rows: DataFrame, policies: dict[str, tuple[Column, str]], *by: str) -> DataFrame:
    """All named (policy, mode) at once: each row is expanded in place and aggregated map-side."""
    cases = F.array(*[F.struct(F.lit(name).alias("method"), outcome(large, mode).alias("o")) for name, (large, mode) in policies.items()])
    return summary(rows.select(*by, F.explode(cases).alias("c")).select(*by, "c.method", "c.o"), "method", *by)


def standard_policies(prob: Column, response_prob: Column, threshold: float, response_threshold: float, random_large: Column) -> dict[str, tuple[Column, str]]:
    """The methods that are compared with a deployed router (column ``policy_route``) and the exact cache (column ``hit``)."""
    yes, no = F.lit(True), F.lit(False)
    router, pref = F.col("policy_route") == "large", prob >= threshold
    return {
        "always_small": (no, "direct"), "always_large": (yes, "direct"), "verifier_cascade": (no, "verified"),
        "random_budget_matched": (random_large, "direct"), "random_budget_matched_plus_fallback": (random_large, "verified"),
        "preference_router": (pref, "direct"), "preference_router_plus_fallback": (pref, "verified"),
        "response_cascade": (response_prob >= response_threshold, "cascade"),
        "deployed_router": (router, "direct"), "deployed_router_plus_fallback": (router, "verified"),
        "oracle_router": (~F.col("small_success") & F.col("large_success"), "direct"), "exact_cache_plus_small": (F.col("hit"), "cached"),
    }


def with_random_budget(rows: DataFrame, seed: int = 42) -> DataFrame:
    """random_large: as many rows at random as the deployed router sends to large."""
    rate = rows.agg(ratio(F.count_if(F.col("policy_route") == "large"), F.count("*")).alias("_rate"))
    return rows.crossJoin(F.broadcast(rate)).withColumn("random_large", stable_fraction(F.col("task_id"), seed) < F.col("_rate")).drop("_rate")


def with_cache_hits(train: DataFrame, rows: DataFrame) -> DataFrame:
    """hit: whether a training row of the same prompt has an answer that passed."""
    key = F.sha2("prompt", 256)  # prompts themselves are not moved
    known = train.where(F.col("small_success") | F.col("large_success")).select(key.alias("_key")).distinct().withColumn("_hit", F.lit(True))
    return rows.withColumn("_key", key).join(known, "_key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit", "_key")


def exact_cache(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose prompt a successful training row has pass at no cost; others are served by small."""
    n = F.count("*")
    served = with_cache_hits(train, rows).withColumn("o", outcome(F.col("hit"), "cached"))
    return served.agg(n.alias("n"), F.count_if("hit").alias("cache_hits"), ratio(F.count_if("hit"), n).alias("cache_coverage"), F.count_if("o.ok").alias("passes"), ratio(F.count_if("o.ok"), n).alias("pass_rate"), ratio(F.sum("o.cost"), n).alias("avg_cost"), ratio(F.sum("o.cost"), n * F.lit(REFERENCE_COST)).alias("cost_vs_large"))


def grid_place(prob: Column, steps: int = 100) -> Column:
    """The largest k with k/steps <= prob, exact also where the product rounds."""
    f = F.floor(prob * steps).cast("int")
    at = lambda k: k.cast("double") / F.lit(float(steps))
    return F.when(at(f + 1) <= prob, f + 1).when(at(f) > prob, f - 1).otherwise(f)


def sweep(rows: DataFrame, prob: Column, mode: str, low: int = 0, high: int = 100, *by: str) -> DataFrame:
    """The policy ``prob >= k/100`` for every k from low to high, in one pass.

    Each row falls between two grid points and is counted once there, under
    both outcomes; running sums over the (at most high - low + 2) places give
    every threshold, so no row is multiplied by the grid.
    """
    yes, no = outcome(F.lit(True), mode), outcome(F.lit(False), mode)
    names = ("ok", "cost", "direct", "fallback")
    at = F.least(F.greatest(grid_place(prob), F.lit(low - 1)), F.lit(high))
    sums = [F.sum(o[n].cast("double" if n == "cost" else "long")).alias(f"{t}_{n}") for t, o in (("y", F.col("y")), ("n", F.col("n"))) for n in names]
    cells = rows.select(*by, at.alias("k"), yes.alias("y"), no.alias("n")).groupBy(*by, "k").agg(F.count("*").alias("rows"), *sums)
    grid = rows.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("k"))
    if by:
        grid = cells.select(*by).distinct().crossJoin(F.broadcast(grid))
    cells = grid.join(cells, [*by, "k"], "left")
    # thresholds at or below a row's place send it to large
    w = Window.partitionBy(*by).orderBy("k")
    after, before = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, frame: F.coalesce(F.sum(c).over(frame), F.lit(0))
    out = cells.select(*by, "k", total("rows", Window.partitionBy(*by)).alias("n"), *[(total(f"y_{c}", after) + total(f"n_{c}", before)).alias(c) for c in names])
    n = F.col("n")
    return out.where(F.col("k") >= low).select(*by, (F.col("k").cast("double") / F.lit(100.0)).alias("threshold"), n, F.col("ok").cast("long").alias("passes"), ratio(F.col("ok"), n).alias("pass_rate"), ratio(F.col("cost"), n).alias("avg_cost"), ratio(F.col("direct"), n).alias("direct_large_rate"), ratio(F.col("fallback"), n).alias("fallback_rate"))


def choose_threshold(curve: DataFrame, target: Column | None = None) -> DataFrame:
    """The cheapest feasible point (then most passes); if none is feasible, the most passes (then cheapest).

    Costs are compared to 12 places, so that the order of summing decides nothing;
    the lowest of equal thresholds wins.
    """
    feasible = F.lit(True) if target is None else F.col("pass_rate") >= target
    cost = F.round("avg_cost", 12)
    key = F.struct(
        F.when(feasible, 0).otherwise(1).alias("a"), F.when(feasible, cost).otherwise(-F.col("pass_rate")).alias("b"),
        F.when(feasible, -F.col("pass_rate")).otherwise(cost).alias("c"), F.col("threshold").alias("d"),
    )
    return curve.agg(F.min_by(F.struct("*"), key).alias("_p"), F.count_if(feasible).alias("n_feasible")).select("_p.*", "n_feasible")


def _mean_of_seeds(rows: DataFrame, point: str) -> DataFrame:
    """Means over seeds of per-seed rates (not of the pooled rate)."""
    each = summary(rows, point, "seed")
    mean = [F.avg(c).alias(f"{c}_mean") for c in ("pass_rate", "cost_vs_large", "fallback_rate")]
    return each.groupBy(point).agg(*mean)


def _grid(rows: DataFrame, name: str, values: list[float], seeds: int) -> DataFrame:
    grid = F.array(*[F.lit(v) for v in values])
    seeded = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("_f", stable_fraction(F.col("task_id"), F.col("seed")))
    return seeded.withColumn(name, F.explode(grid))


def coverage_curve(rows: DataFrame, large: Column, seeds: int = 20) -> DataFrame:
    """Verifier coverage: where it is missing, the row bypasses small."""
    df = _grid(rows.withColumn("_l", large), "coverage", [1.0, 0.75, 0.5, 0.25, 0.0], seeds)
    return _mean_of_seeds(df.select("coverage", "seed", outcome(F.col("_l") | (F.col("_f") >= F.col("coverage")), "verified").alias("o")), "coverage")


def drift_curve(rows: DataFrame, large: Column, seeds: int = 20) -> DataFrame:
    """Small-model drift: a share of its successes turn into failures."""
    df = _grid(rows.withColumn("_l", large), "regressed", [0.0, 0.1, 0.25, 0.5], seeds)
    df = df.withColumn("small_success", F.col("small_success") & ~(F.col("_f") < F.col("regressed")))
    return _mean_of_seeds(df.select("regressed", "seed", outcome(F.col("_l"), "verified").alias("o")), "regressed")


def support_curve(train: DataFrame, rows: DataFrame, large: Column, minima: tuple[int, ...] = (0, 10, 25, 50, 100, 200)) -> DataFrame:
    """Signatures with too little training support go to large."""
    name = F.coalesce(F.nullif(F.col("dataset"), F.lit("")), F.lit("unknown"))
    support = train.groupBy(name.alias("_d")).agg(F.count("*").alias("_n"))
    df = rows.withColumn("_l", large).withColumn("_d", name).join(support, "_d", "left").withColumn("minimum", F.explode(F.array(*[F.lit(m) for m in minima])))
    few = F.coalesce(F.col("_n"), F.lit(0)) < F.col("minimum")
    curve = summary(df.select("minimum", outcome(F.col("_l") | few, "verified").alias("o")), "minimum")
    grid = F.explode(F.array(*[F.lit(m) for m in minima])).alias("minimum")
    names = support.select("_d", "_n", grid).groupBy("minimum").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("_n") < F.col("minimum"), F.col("_d")))), ",").alias("abstained"))
    return curve.join(names, "minimum")


def domain_mix(rows: DataFrame, large: Column, shares: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Blends of exactly two domains; no rows otherwise."""
    each = simulate(rows.withColumn("domain", F.coalesce(F.nullif(F.col("dataset"), F.lit("")), F.lit("unknown"))), large, "verified", "domain")
    two = each.agg(F.min_by(F.struct("pass_rate", "cost_vs_large"), "domain").alias("a"), F.max_by(F.struct("pass_rate", "cost_vs_large"), "domain").alias("b"), F.count("*").alias("_n"), F.min("domain").alias("first_domain"), F.max("domain").alias("second_domain")).where("_n = 2")
    two = two.withColumn("first_share", F.explode(F.array(*[F.lit(s) for s in shares])))
    s, t = F.col("first_share"), F.lit(1.0) - F.col("first_share")
    return two.select("first_domain", "second_domain", "first_share", *[(s * F.col(f"a.{c}") + t * F.col(f"b.{c}")).alias(c) for c in ("pass_rate", "cost_vs_large")])


def policy_metrics(traces: DataFrame, large: Column, *by: str) -> DataFrame:
    """The deployed policy where large outcomes may be unknown (``large_skipped``).

    Unknown rows leave the pass and cost means but not the other denominators.
    """
    s, cs, cl = F.col("small_success"), F.col("small_cost"), F.col("large_cost")
    unknown = (large | ~s) & F.coalesce(F.col("large_skipped"), F.lit(False))
    fall = ~large & ~s & ~unknown
    ok = F.when(unknown, False).when(large | fall, F.coalesce(F.col("large_success"), F.lit(False))).otherwise(s)
    cost = F.when(unknown, 0.0).when(large, cl).when(fall, cs + cl).otherwise(cs)
    df = traces.select(*by, ok.alias("ok"), cost.alias("cost"), unknown.alias("unknown"), fall.alias("fall"), large.alias("direct"), cl.alias("cl"))
    n = F.count("*")
    known = n - F.count_if("unknown")
    return df.groupBy(*by).agg(ratio(F.count_if("ok"), known).alias("task_pass"), ratio(F.sum("cost"), known).alias("avg_cost"), ratio(F.sum("cost"), F.sum("cl")).alias("cost_vs_large"), ratio(F.count_if("fall"), n).alias("fallback_rate"), ratio(F.count_if("direct"), n).alias("direct_large_rate"), ratio(F.count_if("unknown"), n).alias("unknown_rate"))


def router_score(rows: DataFrame, label: Column, pred: Column, *by: str) -> DataFrame:
    """Precision, recall and F1 of predicting large; accuracy; missed large as a share of all."""
    tp, fp, fn = F.count_if(label & pred), F.count_if(~label & pred), F.count_if(label & ~pred)
    n, p, r = F.count("*"), ratio(tp, tp + fp), ratio(tp, tp + fn)
    return rows.groupBy(*by).agg(n.alias("n"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.count_if(label == pred), n).alias("routing_acc"), ratio(fn, n).alias("missed_large"))


def binomial_tail(wins: Column, n: Column) -> Column:
    """P(X >= wins) for X ~ B(n, 1/2); 1 for n = 0.  Terms follow by recurrence, in logarithms."""
    first = F.log(F.lit(0.5)) * n.cast("double")
    acc = F.aggregate(
        F.sequence(F.lit(0), n.cast("int")),
        F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda a, k: F.struct(
            (a["term"] + F.log(F.greatest(n - k, F.lit(1)).cast("double")) - F.log((k + 1).cast("double"))).alias("term"),
            (a["sum"] + F.when(k >= wins, F.exp(a["term"])).otherwise(0.0)).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(acc, F.lit(1.0)))


def paired(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer pairing of results (reward > 0 passes), with a flag for keys on one side only."""
    a = baseline.select(*keys, (F.col("reward") > 0).alias("base"))
    b = candidate.select(*keys, (F.col("reward") > 0).alias("cand"))
    return a.join(b, keys, "full_outer").withColumn("unpaired", F.col("base").isNull() | F.col("cand").isNull())


def mcnemar(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Exact one-sided paired test; pairs missing a side are an error."""
    ok = F.assert_true(~F.col("unpaired"), F.lit("results of different tasks"))
    rows = pairs.where(F.coalesce(ok.cast("string"), F.lit("ok")) == "ok")
    out = rows.agg(F.count("*").alias("n"), F.count_if("base").alias("base_passes"), F.count_if("cand").alias("cand_passes"), F.count_if(F.expr("cand AND NOT base")).alias("wins"), F.count_if(F.expr("base AND NOT cand")).alias("losses"))
    out = out.withColumn("ties", F.col("n") - F.col("wins") - F.col("losses")).withColumn("p_value", binomial_tail(F.col("wins"), F.col("wins") + F.col("losses")))
    return out.withColumn("significant", (F.col("cand_passes") > F.col("base_passes")) & (F.col("p_value") < alpha))
