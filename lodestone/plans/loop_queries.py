"""Closed loops over the tables as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import messages as M
from ..operators import routing as R
from ..operators import skills as S
from ..sources.folders import temporary_path
from . import loops
from .message_queries import _FEATURES, episodes
from .registry import query, rounded
from .routing_queries import EVAL, TRAIN, sql_sweep
from .views import MESSAGES, TRACES, tasks, traces

_RATIO = "coalesce(({0})::DOUBLE / nullif(({1})::DOUBLE, 0), 0)"


def _ratio(a: str, b: str) -> str:
    return f"round({_RATIO.format(a, b)}, 9)"


_NEED = "(NOT small_success AND large_success)"
_TP = f"count(*) FILTER ({_NEED} AND big)"
_LOOP = f"""WITH {TRACES},
b AS (SELECT coalesce(dataset, '') AS d, sum(CASE WHEN large_success THEN 3 - small_pass_count ELSE 0 END) AS ones, sum(3) AS n FROM traces WHERE {TRAIN} GROUP BY 1),
p AS (SELECT traces.*, coalesce((ones + 1.0::DOUBLE) / (n + 2.0::DOUBLE), 0.5::DOUBLE) AS prob FROM traces LEFT JOIN b ON coalesce(dataset, '') = d),
curve AS ({sql_sweep(1, 99, 'verified', 'shard = 1', 'prob').replace('FROM traces,', 'FROM p,')}),
chosen AS (SELECT threshold AS bar FROM curve ORDER BY round(avg_cost, 12), -pass_rate, threshold LIMIT 1),
h AS (SELECT p.*, prob >= bar AS wants, small_success AND NOT (prob >= bar) AS skipped FROM p, chosen WHERE {EVAL}),
v AS (SELECT *, unnest(['large', 'skills', 'router', 'full']) AS variant FROM h),
w AS (SELECT *, CASE variant WHEN 'large' THEN true WHEN 'skills' THEN false ELSE wants END AS big FROM v),
u AS (SELECT *, (big OR NOT small_success) AND skipped AS unknown FROM w),
o AS (SELECT *, NOT big AND NOT small_success AND NOT unknown AS fall FROM u),
x AS (SELECT *, CASE WHEN unknown THEN false WHEN big OR fall THEN large_success ELSE small_success END AS ok,
  CASE WHEN unknown THEN 0 WHEN big THEN large_cost WHEN fall THEN small_cost + large_cost ELSE small_cost END AS cost FROM o)
SELECT variant, count(*)::BIGINT AS n, {_ratio(_TP, 'count(*) FILTER (big)')} AS precision, {_ratio(_TP, f'count(*) FILTER ({_NEED})')} AS recall,
  round(coalesce(2 * count(*) FILTER ({_NEED} AND big) / nullif((count(*) FILTER (big) + count(*) FILTER ({_NEED}))::DOUBLE, 0), 0), 9) AS f1,
  {_ratio(f'count(*) FILTER ({_NEED} = big)', 'count(*)')} AS routing_acc, {_ratio(f'count(*) FILTER ({_NEED} AND NOT big)', 'count(*)')} AS missed_large,
  {_ratio('count(*) FILTER (ok)', 'count(*) FILTER (NOT unknown)')} AS task_pass, {_ratio('sum(cost)', 'count(*) FILTER (NOT unknown)')} AS avg_cost, {_ratio('sum(cost)', 'sum(large_cost)')} AS cost_vs_large,
  {_ratio('count(*) FILTER (fall)', 'count(*)')} AS fallback_rate, {_ratio('count(*) FILTER (big)', 'count(*)')} AS direct_large_rate, {_ratio('count(*) FILTER (unknown)', 'count(*)')} AS unknown_rate
FROM x GROUP BY variant"""


@query(_LOOP)
def closed_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collect, learn a router by dataset, calibrate it on its own predictions, collect the held-out shard with it, compare the variants."""
    done = loops.Cycle(spark, temporary_path(spark, "closed-loop"), fit=loops.signature_router).run(tasks(spark, sf_dir))
    return rounded(done["ablation"])


@query()
def vector_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with logistic regression on embedded prompts."""
    done = loops.Cycle(spark, temporary_path(spark, "vector-loop")).run(tasks(spark, sf_dir), mechanisms=("router",))
    return rounded(done["ablation"], 6)


@query()
def response_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text router on prompts and small's answers drives the response cascade."""
    t = traces(spark, sf_dir).withColumn("small_completion", F.concat(F.lit("answer of "), F.col("source")))
    scored = loops.text_router(t.where(TRAIN), response=True)(t.where(EVAL))
    return rounded(R.simulate(scored, F.col("prob") >= 0.5, "cascade", "dataset"), 6)


def agent_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """episodes, contexts, attempts, held-out and the teacher's results, from the events table.

    An episode passes if few of its messages are errors.
    """
    e = episodes(spark, sf_dir).where(F.exists("m", lambda m: (m["role"] == "user") & (F.coalesce(m["content"], F.lit("")) != "")))
    errors = F.size(F.filter("m", lambda m: m["role"] == "tool"))
    e = e.select("domain", F.col("episode").cast("string").alias("task_id"), "m", (errors * _BAR <= F.size("m")).alias("passed"), F.lit(True).alias("complete"), F.col("episode").alias("ord"))
    held = F.col("ord") % 5 == 4
    contexts = e.select("domain").distinct().select("domain", F.concat(F.lit("Policy of "), "domain").alias("system"), F.lit("").alias("tools"))
    points = e.select("domain", "task_id", "m", "ord", F.explode(M.decision_points(F.col("m"), 3)).alias("prefix"))
    attempts = points.where(~held).select("domain", "task_id", "prefix", ((F.col("ord") * 7 + F.col("prefix")) % 4 == 0).alias("verified"), F.col("m").alias("rescued"))
    teacher = points.where(held).select("domain", "task_id", "prefix", F.when((F.col("ord") * 5 + F.col("prefix")) % 3 != 0, 1.0).otherwise(0.0).alias("reward"))
    return e.where(~held), contexts, attempts, e.where(held).select("domain", "task_id", "m", F.when(F.col("passed"), 1.0).otherwise(0.0).alias("reward")), teacher


def agent_cycle(spark: SparkSession, sf_dir: str, root: str) -> dict[str, DataFrame]:
    return loops.AgentCycle(spark, root).run(*agent_tables(spark, sf_dir))


#: Messages for each error that an episode may have and still pass.
_BAR = 5
_FEATURES_AT = _FEATURES.removeprefix(f"WITH {MESSAGES}, ")
_N = len(M.FEATURES)
_DOT = " + ".join(f"w{k} * {n}" for k, n in enumerate(M.FEATURES))
_SIGMOID = f"(1 / (1 + exp(-greatest(-30, least(30, bias + {_DOT})))))"
# the router's descent, a recursion over its weights
_AGENT_LOOP = f"""WITH RECURSIVE {MESSAGES.replace('messages AS', 'said AS', 1)},
i AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY ord) AS i FROM said),
e AS (SELECT episode, count(*) FILTER (role = 'tool') * {_BAR} <= count(*) AS passed, episode % 5 = 4 AS held FROM said GROUP BY episode HAVING bool_or(role = 'user' AND content <> '')),
ps AS (SELECT episode, list(i ORDER BY i) AS ps FROM i JOIN e USING (episode) WHERE role = 'tool' OR role = 'user' AND NOT contains(content, '{M.STOP}') GROUP BY episode),
pt AS (SELECT episode, unnest(CASE WHEN len(ps) <= 3 THEN ps ELSE list_distinct([ps[round_even(j * (len(ps) - 1) / 2.0, 0)::INT + 1] FOR j IN range(3)]) END) AS prefix FROM ps),
messages AS (SELECT (i.episode::BIGINT * 1000000 + prefix)::BIGINT AS episode, ord, role, tool_name, content, domain FROM i JOIN pt ON i.episode = pt.episode AND i.i <= prefix),
f AS MATERIALIZED (SELECT episode // 1000000 AS ep, (episode % 1000000) AS prefix, * EXCLUDE (episode) FROM (WITH {_FEATURES_AT})),
saved AS (SELECT ep, max(prefix) AS prefix FROM f JOIN e ON ep = e.episode WHERE NOT held AND NOT passed AND (ep * 7 + prefix) % 4 = 0 GROUP BY ep),
x AS MATERIALIZED (SELECT f.*, 0 AS label FROM f JOIN e ON ep = e.episode WHERE NOT held AND passed UNION ALL SELECT f.*, 1 FROM f JOIN saved USING (ep, prefix)),
d AS (
  SELECT 0 AS step, {', '.join(f'0.0::DOUBLE AS w{k}' for k in range(_N))}, ln((sum(label) + 1.0::DOUBLE) / (count(*) - sum(label) + 1.0::DOUBLE)) AS bias FROM x
  UNION ALL
  SELECT max(step) + 1, {', '.join(f'max(w{k}) - 0.1::DOUBLE * (sum(err * {n}) / count(*) + 0.01::DOUBLE * max(w{k}))' for k, n in enumerate(M.FEATURES))}, max(bias) - 0.1::DOUBLE * avg(err)
  FROM (SELECT d.*, x.*, {_SIGMOID} - label AS err FROM d, x WHERE step < 500) HAVING count(*) > 0),
w AS MATERIALIZED (SELECT * FROM d WHERE step = 500),
bar AS (SELECT avg({_SIGMOID}) AS bar FROM x, w),
s AS (SELECT ep, min(prefix) AS prefix FROM f JOIN e ON ep = e.episode, w, bar WHERE held AND {_SIGMOID} >= bar GROUP BY ep),
h AS (SELECT e.passed AS base, s.ep IS NOT NULL AS switched, CASE WHEN s.ep IS NULL THEN e.passed ELSE (e.episode * 5 + prefix) % 3 <> 0 END AS cand FROM e LEFT JOIN s ON e.episode = s.ep WHERE held)
SELECT count(*)::BIGINT AS n, count(*) FILTER (base)::BIGINT AS base_passes, count(*) FILTER (cand)::BIGINT AS cand_passes, count(*) FILTER (cand AND NOT base)::BIGINT AS wins, count(*) FILTER (base AND NOT cand)::BIGINT AS losses,
  count(*) FILTER (cand = base)::BIGINT AS ties, count(*) FILTER (switched)::BIGINT AS n_escalated, (SELECT count(*) FROM x WHERE label = 0)::BIGINT AS n_continue, (SELECT count(*) FROM x WHERE label = 1)::BIGINT AS n_escalate,
  (SELECT count(*) FROM e WHERE NOT held AND NOT passed)::BIGINT AS n_failed FROM h"""


@query(_AGENT_LOOP)
def agent_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rescue, curate, distil, learn the online router, let it hand over held-out episodes, compare in pairs with the student alone."""
    done = agent_cycle(spark, sf_dir, temporary_path(spark, "agent-loop"))
    paired = done["paired"].select("n", "base_passes", "cand_passes", "wins", "losses", "ties")
    return paired.crossJoin(done["held_out"].agg(F.count_if("escalated").alias("n_escalated"))).crossJoin(done["counts"].select("n_continue", "n_escalate", "n_failed"))


@query(f"""WITH {MESSAGES}, e AS (SELECT episode, domain, count(*) FILTER (role = 'tool') * {_BAR} <= count(*) AS passed FROM messages GROUP BY episode, domain HAVING bool_or(role = 'user' AND content <> '') AND episode % 5 <> 4),
c AS (SELECT e.episode, domain, tool_name, ord FROM messages JOIN e USING (episode, domain) WHERE passed AND tool_name IS NOT NULL),
r AS (SELECT DISTINCT episode, domain, dense_rank() OVER (PARTITION BY domain ORDER BY episode DESC) AS r FROM e WHERE passed),
o AS (SELECT domain, episode, arg_min(tool_name, ord) AS name FROM c JOIN r USING (domain, episode) WHERE r <= 64 GROUP BY domain, episode),
n AS (SELECT domain, name, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, name) AS k FROM o GROUP BY domain, name)
SELECT domain, 'Most successful episodes call ' || name || ' first.' AS lesson FROM n WHERE k = 1""")
def agent_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first cycle distils from its successful episodes, by domain."""
    e = agent_tables(spark, sf_dir)[0]
    told = e.select(F.col("domain").alias("signature"), "task_id", F.lit("student").alias("model"), F.col("passed").alias("success"), M.first_user(F.col("m")).alias("prompt"), S.transcript(F.col("m")).alias("completion"), "ord")
    return S.distill(told, loops.common_calls).select(F.col("signature").alias("domain"), F.explode("patterns").alias("lesson"))


@query("""WITH e AS (SELECT user_id AS instance, event_id AS ord, CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'purchase' THEN 'finalize' ELSE 'step' END AS kind, value FROM events),
s AS (SELECT instance, min(ord) AS begun FROM e WHERE kind = 'start' GROUP BY instance), f AS (SELECT e.instance, min(ord) AS done, arg_min(value, ord) AS value FROM e JOIN s USING (instance) WHERE kind = 'finalize' AND ord > begun GROUP BY e.instance)
SELECT f.instance::VARCHAR AS instance, (SELECT count(*) FROM e JOIN s USING (instance) WHERE e.instance = f.instance AND kind = 'step' AND ord > begun AND ord < done)::BIGINT AS steps,
  round(0.5::DOUBLE * (value >= 50)::INT + 0.5::DOUBLE * 1, 9) AS score, 'finalized' AS reason FROM f""")
def stream_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes as a stream of start, step and finalize events; a second end changes nothing."""
    from ..streaming import episodes as stream
    from .stream_queries import MONTHS, _events

    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "finalize").otherwise("step")
    e = e.select(F.col("user_id").cast("string").alias("instance"), F.col("event_id").alias("ord"), kind.alias("kind"), F.when(F.col("value") >= 50, 1.0).otherwise(0.0).alias("official"), F.lit(1.0).alias("recall"), "ts")
    return rounded(stream.drain(stream.episode_registry(e, idle=MONTHS), "episodes"))


@query(f"WITH {TRACES}, n AS (SELECT source AS domain, count(DISTINCT task_id) FILTER (small_success) AS u FROM traces WHERE source IS NOT NULL GROUP BY source) SELECT sum(u)::BIGINT AS n_unique, (max(u) * count(*) FILTER (u > 0))::BIGINT AS n_balanced FROM n")
def curated_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tasks curation keeps, and how many rows once the domains are balanced."""
    from ..operators import curation as C

    t = traces(spark, sf_dir).where("source IS NOT NULL")
    yes = {n: F.lit(True).alias(n) for n in ("complete", "has_target", "fallback_used", "opd_used")}
    return C.curation_counts(t.select(F.col("source").alias("domain"), "task_id", F.col("small_success").alias("passed"), *yes.values())).select("n_unique", "n_balanced")
