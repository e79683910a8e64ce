"""Policy simulation, thresholds, stress tests and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing as R
from ..operators import traces as T
from .registry import query, rounded
from .views import TRACES, sql_fraction, table, traces

EVAL, TRAIN, CALIBRATE = "shard = 4", "shard IN (0, 2, 3)", "shard = 1"


def sql_outcome(large: str, mode: str) -> str:
    """DuckDB: ok, cost, direct and fallback of one row under a policy."""
    if mode == "cascade":
        return f"CASE WHEN {large} THEN large_success ELSE small_success END AS ok, CASE WHEN {large} THEN small_cost + large_cost ELSE small_cost END AS cost, false AS direct, {large} AS fallback"
    if mode == "cached":
        return f"{large} OR small_success AS ok, CASE WHEN {large} THEN 0 ELSE small_cost END AS cost, false AS direct, false AS fallback"
    fall = f"(NOT ({large}) AND NOT small_success)" if mode == "verified" else "false"
    return f"CASE WHEN ({large}) OR {fall} THEN large_success ELSE small_success END AS ok, CASE WHEN {large} THEN large_cost WHEN {fall} THEN small_cost + large_cost ELSE small_cost END AS cost, ({large}) AS direct, {fall} AS fallback"


def sql_summary(source: str, *by: str) -> str:
    group = ", ".join(by)
    head = f"{group}, " if by else ""
    return f"""SELECT {head}count(*)::BIGINT AS n, count(*) FILTER (ok)::BIGINT AS passes, round(avg(ok::INT), 9) AS pass_rate, round(avg(cost), 9) AS avg_cost,
  round(sum(cost) / (count(*) * 0.01::DOUBLE), 9) AS cost_vs_large, round(avg(direct::INT), 9) AS direct_large_rate, round(avg(fallback::INT), 9) AS fallback_rate
  FROM ({source}){' GROUP BY ' + group if by else ''}"""


_WANTS = "policy_route = 'large'"


def _eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).where(EVAL)


@query(f"WITH {TRACES} {sql_summary('SELECT dataset, ' + sql_outcome(_WANTS, 'verified') + ' FROM traces', 'dataset')}")
def pre_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.simulate(traces(spark, sf_dir), F.expr(_WANTS), "verified", "dataset"))


@query(f"WITH {TRACES} {sql_summary('SELECT dataset, ' + sql_outcome('response_prob >= 0.6::DOUBLE', 'cascade') + ' FROM traces', 'dataset')}")
def response_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.simulate(traces(spark, sf_dir), F.col("response_prob") >= 0.6, "cascade", "dataset"))


@query(f"WITH {TRACES} {sql_summary(f'SELECT dataset, ' + sql_outcome(_WANTS, 'verified') + f' FROM traces WHERE {EVAL}', 'dataset')}")
def domain_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.simulate(_eval(spark, sf_dir), F.expr(_WANTS), "verified", "dataset"))


_RANDOM = f"({sql_fraction(chr(39) + '42:' + chr(39) + ' || task_id')} < (SELECT avg((policy_route = 'large')::INT) FROM traces WHERE {EVAL}))"


@query(f"WITH {TRACES} {sql_summary('SELECT ' + sql_outcome(_RANDOM, 'verified') + f' FROM traces WHERE {EVAL}')}")
def random_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.simulate(R.with_random_budget(_eval(spark, sf_dir)), F.col("random_large"), "verified"))


_METHODS = {
    "always_small": ("false", "direct"), "always_large": ("true", "direct"), "verifier_cascade": ("false", "verified"),
    "random_budget_matched": ("random_large", "direct"), "random_budget_matched_plus_fallback": ("random_large", "verified"),
    "preference_router": ("router_prob >= 0.5::DOUBLE", "direct"), "preference_router_plus_fallback": ("router_prob >= 0.5::DOUBLE", "verified"),
    "response_cascade": ("response_prob >= 0.6::DOUBLE", "cascade"), "deployed_router": (_WANTS, "direct"), "deployed_router_plus_fallback": (_WANTS, "verified"),
    "oracle_router": ("NOT small_success AND large_success", "direct"), "exact_cache_plus_small": ("hit", "cached"),
}
_COMPARED = " UNION ALL ".join(f"SELECT '{m}' AS method, {sql_outcome(large, mode)} FROM e" for m, (large, mode) in _METHODS.items())


@query(f"""WITH {TRACES}, k AS (SELECT DISTINCT prompt FROM traces WHERE {TRAIN} AND (small_success OR large_success)),
e AS (SELECT traces.*, {_RANDOM} AS random_large, k.prompt IS NOT NULL AS hit FROM traces LEFT JOIN k ON traces.prompt = k.prompt WHERE {EVAL}) {sql_summary(_COMPARED, 'method')}""")
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve methods in one scan of the held-out rows."""
    rows = R.with_cache_hits(traces(spark, sf_dir).where(TRAIN), R.with_random_budget(_eval(spark, sf_dir)))
    return rounded(R.compare(rows, R.standard_policies(F.col("router_prob"), F.col("response_prob"), 0.5, 0.6, F.col("random_large"))))


@query(f"""WITH {TRACES}, k AS (SELECT DISTINCT prompt FROM traces WHERE {TRAIN} AND (small_success OR large_success)),
s AS (SELECT k.prompt IS NOT NULL AS hit, k.prompt IS NOT NULL OR small_success AS ok, CASE WHEN k.prompt IS NOT NULL THEN 0 ELSE small_cost END AS cost FROM traces t LEFT JOIN k USING (prompt) WHERE {EVAL})
SELECT count(*)::BIGINT AS n, count(*) FILTER (hit)::BIGINT AS cache_hits, round(avg(hit::INT), 9) AS cache_coverage, count(*) FILTER (ok)::BIGINT AS passes, round(avg(ok::INT), 9) AS pass_rate, round(avg(cost), 9) AS avg_cost, round(sum(cost) / (count(*) * 0.01::DOUBLE), 9) AS cost_vs_large FROM s""")
def exact_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    return rounded(R.exact_cache(t.where(TRAIN), t.where(EVAL)))


def sql_sweep(low: int, high: int, mode: str, where: str = CALIBRATE, prob: str = "router_prob") -> str:
    points = f"SELECT i / 100.0::DOUBLE AS threshold FROM range({low}, {high} + 1) t(i)"
    rows = f"SELECT threshold, {sql_outcome(f'{prob} >= threshold', mode)} FROM traces, ({points}) WHERE {where}"
    return f"SELECT threshold, count(*)::BIGINT AS n, count(*) FILTER (ok)::BIGINT AS passes, avg(ok::INT) AS pass_rate, sum(cost) / count(*) AS avg_cost, avg(direct::INT) AS direct_large_rate, avg(fallback::INT) AS fallback_rate FROM ({rows}) GROUP BY threshold"


_ROUNDED = "threshold, n, passes, round(pass_rate, 9) AS pass_rate, round(avg_cost, 9) AS avg_cost, round(direct_large_rate, 9) AS direct_large_rate, round(fallback_rate, 9) AS fallback_rate"


def sql_choice(low: int, high: int, mode: str, target: str, prob: str = "router_prob") -> str:
    return f"""WITH {TRACES}, curve AS ({sql_sweep(low, high, mode, CALIBRATE, prob)}), f AS (SELECT *, pass_rate >= {target} AS feasible FROM curve)
SELECT {_ROUNDED}, (SELECT count(*) FROM f WHERE feasible)::BIGINT AS n_feasible FROM f
ORDER BY feasible DESC, CASE WHEN feasible THEN round(avg_cost, 12) ELSE -pass_rate END, CASE WHEN feasible THEN -pass_rate ELSE round(avg_cost, 12) END, threshold LIMIT 1"""


_LARGE_RATE = f"(SELECT avg(large_success::INT) FROM traces WHERE {CALIBRATE})"


@query(f"WITH {TRACES} SELECT {_ROUNDED} FROM ({sql_sweep(0, 100, 'verified', 'true')})")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.sweep(traces(spark, sf_dir), F.col("router_prob"), "verified"))


@query(sql_choice(1, 99, "verified", "0.95::DOUBLE"))
def calibrate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir).where(CALIBRATE)
    return rounded(R.choose_threshold(R.sweep(rows, F.col("router_prob"), "verified", 1, 99), F.lit(0.95)))


def _selected(spark: SparkSession, sf_dir: str, prob: str, mode: str) -> DataFrame:
    rows = traces(spark, sf_dir).where(CALIBRATE)
    goal = rows.agg(F.avg(F.col("large_success").cast("double")).alias("_goal"))
    curve = R.sweep(rows, F.col(prob), mode).crossJoin(F.broadcast(goal))
    return rounded(R.choose_threshold(curve, F.col("_goal")).drop("_goal"))


@query(sql_choice(0, 100, "direct", _LARGE_RATE))
def select_threshold_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "router_prob", "direct")


@query(sql_choice(0, 100, "cascade", _LARGE_RATE, "response_prob"))
def select_threshold_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "response_prob", "cascade")


def _sql_seeds(point: str, values: str, large: str, rows: str) -> str:
    f = sql_fraction("seed::VARCHAR || ':' || task_id")
    return f"""WITH {TRACES}, g AS (SELECT *, {f} AS f FROM traces, range(20) s(seed), (SELECT unnest({values}) AS {point}) WHERE {EVAL}), h AS ({rows}),
each AS (SELECT {point}, seed, avg(ok::INT) AS p, sum(cost) / (count(*) * 0.01::DOUBLE) AS c, avg(fallback::INT) AS fb FROM (SELECT {point}, seed, {sql_outcome(large, 'verified')} FROM h) GROUP BY {point}, seed)
SELECT {point}, round(avg(p), 9) AS pass_rate_mean, round(avg(c), 9) AS cost_vs_large_mean, round(avg(fb), 9) AS fallback_rate_mean FROM each GROUP BY {point}"""


@query(_sql_seeds("coverage", "[1.0, 0.75, 0.5, 0.25, 0.0]::DOUBLE[]", f"({_WANTS} OR f >= coverage)", "SELECT * FROM g"))
def verifier_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.coverage_curve(_eval(spark, sf_dir), F.expr(_WANTS)))


@query(_sql_seeds("regressed", "[0.0, 0.1, 0.25, 0.5]::DOUBLE[]", f"({_WANTS})", "SELECT * REPLACE (small_success AND NOT (f < regressed) AS small_success) FROM g"))
def small_model_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.drift_curve(_eval(spark, sf_dir), F.expr(_WANTS)))


_SUPPORT = "SELECT minimum, " + sql_outcome(f"({_WANTS} OR coalesce(c, 0) < minimum)", "verified") + f" FROM traces LEFT JOIN sup USING (dataset), m WHERE {EVAL}"


@query(f"""WITH {TRACES}, sup AS (SELECT dataset, count(*) AS c FROM traces WHERE {TRAIN} GROUP BY dataset), m AS (SELECT unnest([0, 10, 25, 50, 100, 200]) AS minimum),
s AS ({sql_summary(_SUPPORT, 'minimum')})
SELECT s.*, coalesce((SELECT string_agg(dataset, ',' ORDER BY dataset) FROM sup WHERE c < s.minimum), '') AS abstained FROM s""")
def signature_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    return rounded(R.support_curve(t.where(TRAIN), t.where(EVAL), F.expr(_WANTS)))


_MIX = "SELECT CASE WHEN dataset = 'en' THEN 'en' ELSE 'other' END AS dataset, " + sql_outcome(_WANTS, "verified") + " FROM traces"


@query(f"""WITH {TRACES}, d AS (SELECT dataset, avg(ok::INT) AS p, sum(cost) / (count(*) * 0.01::DOUBLE) AS c FROM ({_MIX}) GROUP BY dataset)
SELECT a.dataset AS first_domain, b.dataset AS second_domain, s AS first_share, round(s * a.p + (1 - s) * b.p, 9) AS pass_rate, round(s * a.c + (1 - s) * b.c, 9) AS cost_vs_large
FROM d a JOIN d b ON a.dataset < b.dataset, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS s)""")
def domain_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.domain_mix(traces(spark, sf_dir).withColumn("dataset", F.when(F.col("dataset") == "en", "en").otherwise("other")), F.expr(_WANTS)))


_UNKNOWN = f"(({_WANTS} OR NOT small_success) AND large_skipped)"


@query(f"""WITH {TRACES}, p AS (SELECT dataset, {_UNKNOWN} AS unknown, {_WANTS} AS direct, NOT ({_WANTS}) AND NOT small_success AND NOT large_skipped AS fall, large_cost,
  CASE WHEN {_UNKNOWN} THEN false WHEN {_WANTS} OR NOT small_success THEN large_success ELSE true END AS ok,
  CASE WHEN {_UNKNOWN} THEN 0 WHEN {_WANTS} THEN large_cost WHEN small_success THEN small_cost ELSE small_cost + large_cost END AS cost FROM traces)
SELECT dataset, round(count(*) FILTER (ok) / count(*) FILTER (NOT unknown)::DOUBLE, 9) AS task_pass, round(sum(cost) / count(*) FILTER (NOT unknown), 9) AS avg_cost, round(sum(cost) / sum(large_cost), 9) AS cost_vs_large,
  round(avg(fall::INT), 9) AS fallback_rate, round(avg(direct::INT), 9) AS direct_large_rate, round(avg(unknown::INT), 9) AS unknown_rate FROM p GROUP BY dataset""")
def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.policy_metrics(traces(spark, sf_dir), F.expr(_WANTS), "dataset"))


@query(f"""WITH {TRACES}, q AS (SELECT dataset, NOT small_success AND large_success AS y, {_WANTS} AS p FROM traces),
k AS (SELECT dataset, count(*) AS n, count(*) FILTER (y AND p)::DOUBLE AS tp, count(*) FILTER (NOT y AND p)::DOUBLE AS fp, count(*) FILTER (y AND NOT p)::DOUBLE AS fn, avg((y = p)::INT) AS acc FROM q GROUP BY dataset),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM k)
SELECT dataset, n::BIGINT AS n, round(pr, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 9) AS f1, round(acc, 9) AS routing_acc, round(fn / n, 9) AS missed_large FROM r""")
def router_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.router_score(traces(spark, sf_dir), T.need_large(F.col("small_success"), F.col("large_success")), F.expr(_WANTS), "dataset"))


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = traces(spark, sf_dir)
    keys = ("dataset", "task_id")
    return t.select(*keys, F.col("small_success").cast("double").alias("reward")), t.select(*keys, (F.col("small_pass_count") >= 2).cast("double").alias("reward"))


_PAIRS = "pairs AS (SELECT dataset, task_id, small_success AS base, small_pass_count >= 2 AS cand FROM traces)"


@query(f"WITH {TRACES}, {_PAIRS} SELECT dataset, task_id, base, cand, false AS unpaired FROM pairs")
def paired_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paired(*_results(spark, sf_dir), ["dataset", "task_id"]).select("dataset", "task_id", "base", "cand", "unpaired")


@query(f"""WITH {TRACES}, {_PAIRS},
c AS (SELECT count(*)::BIGINT AS n, count(*) FILTER (base)::BIGINT AS base_passes, count(*) FILTER (cand)::BIGINT AS cand_passes, count(*) FILTER (cand AND NOT base)::BIGINT AS wins, count(*) FILTER (base AND NOT cand)::BIGINT AS losses FROM pairs),
t AS (SELECT sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) - m * ln(2))) AS p FROM (SELECT wins + losses AS m, wins, unnest(range(wins, wins + losses + 1)) AS k FROM c))
SELECT c.*, n - wins - losses AS ties, round(p, 9) AS p_value, cand_passes > base_passes AND p < 0.05 AS significant FROM c, t""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.mcnemar(R.paired(*_results(spark, sf_dir), ["dataset", "task_id"])))


@query("""WITH h AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
SELECT o_orderpriority AS priority, count(*)::BIGINT AS n FROM orders JOIN h ON o_orderkey = k WHERE q > 150 GROUP BY o_orderpriority""")
def orders_by_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain star-schema aggregate, as a check of the tables themselves."""
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q")).where("q > 150")
    return table(spark, sf_dir, "orders").join(h, "o_orderkey").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
