"""Named pipelines over trace files, each stage a lazy DataFrame with a file at its end."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import row_index
from ..operators import curation as C
from ..operators import messages as M
from ..operators import models
from ..operators import routing as R
from ..operators import skills as S
from ..operators import traces as T
from ..sources import clients
from ..sources import jsonl as J
from ..sources import versions
from ..sources.folders import delete, exists, scratch_path, temporary_path


Router = Callable[[DataFrame], DataFrame]


def collect(tasks: DataFrame, cycle: int = 0, samples: int = 3, router: Router | None = None, threshold: float = 0.5) -> DataFrame:
    """Traces of tasks from recorded (here: made-up) outcomes, routed by a router if there is one.

    Samples stand for the turns of a repair loop, too: up to the first that passes.
    """
    rows = T.mock_traces(tasks, samples, cycle)
    turn = lambda k: F.struct(T.mock_success(F.col("task_id"), "small", cycle, k).alias("success"), F.concat(F.lit(f"# small {k}\n"), F.col("task_id")).alias("completion"))
    turns = F.array(*[turn(k) for k in range(samples)])
    done = F.array_position(F.transform(turns, lambda t: t["success"]), True).cast("int")
    rows = rows.withColumn("small_turns", F.when(done > 0, F.slice(turns, F.lit(1), F.greatest(done, F.lit(1)))).otherwise(turns))
    rows = rows.withColumn("small_completion", F.try_element_at("small_turns", F.lit(1))["completion"]).withColumn("large_completion", F.concat(F.lit("# large\n"), F.col("task_id")))
    rows = router(rows).withColumn("policy_route", models.route(F.col("prob"), threshold)) if router else rows.withColumn("policy_route", F.lit("small"))
    needed = T.large_needed(F.col("small_success"), F.col("policy_route"))
    return T.with_costs(rows.withColumn("large_skipped", ~needed).withColumn("round", F.lit(cycle)))


def signature_router(traces: DataFrame) -> Router:
    """The smoothed share of samples, by dataset, that need the large model."""
    name = F.coalesce("dataset", F.lit(""))
    rates = T.binomial_examples(traces).groupBy(name.alias("_d")).agg(((F.sum("label") + F.lit(1.0)) / (F.count("*") + F.lit(2.0))).alias("prob"))
    return lambda rows: rows.withColumn("_d", name).join(rates, "_d", "left").withColumn("prob", F.coalesce("prob", F.lit(0.5))).drop("_d")


def vector_router(traces: DataFrame, encoder: Callable | None = None) -> Router:
    """Class-balanced logistic regression on embedded prompts, from all samples of the traces."""
    encoder = encoder or models.hashed_encoder()
    embedded = lambda df: models.embed(df, "prompt", encoder).withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))).drop("embedding")
    model = models.fit_logistic(models.complemented(embedded(T.binomial_examples(traces)).select("features", "label")))
    return lambda rows: models.probability(model, embedded(rows)).drop("features")


def text_router(traces: DataFrame, response: bool = False) -> Router:
    """The text router on prompts, or on prompts and small's answers: whom does large rescue?"""
    text = S.router_text(F.col("prompt"), F.col("small_completion") if response else None)
    label = T.rescue(F.col("small_success"), F.col("large_success")).cast("int")
    fitted = models.TextRouter().fit(traces.withColumn("_text", text).withColumn("_label", label), "_text", "_label")
    return lambda rows: fitted.transform(rows.withColumn("_text", text)).drop("_text", "words", "pairs")


def build_cache(tasks: DataFrame, path: str, client: clients.ModelClient, failures: str | None = None) -> tuple[DataFrame, int]:
    """The cache at ``path`` with what it lacked, and how many calls failed.

    The last of repeated tasks, less those cached, are called once; answers are
    appended by one committed job, so a rerun after a crash calls only what is
    still missing; failures go aside, and their folder goes when there are none.
    """
    spark = tasks.sparkSession
    keyed = T.last_wins(tasks, "task_id", "ord").drop("first_seen").withColumn("cache_key", C.cache_key(F.col("task_id"), F.col("prompt"), "large", 0.0, 1024, 2))
    known = exists(spark, path)
    todo = C.pending(keyed, J.read_keyed(spark, path), ["cache_key"]) if known else keyed
    held = scratch_path(spark, "calls")
    answers = F.struct("success", "error", "completion", "code", "latency", "prompt_tokens", "completion_tokens").alias("result")
    # written first, so that no call is made twice
    clients.collect(todo, client, "large").select("cache_key", "task_id", F.lit("large").alias("model"), "error", answers).write.parquet(held)
    called = spark.read.parquet(held)
    if failures:
        failed = J.write_split(called, path, failures, append=known)
    else:
        failed = called.where(F.coalesce("error", F.lit("")) != "").count()
        J.write_jsonl(C.without_errors(called), path, append=known)
    delete(spark, held)
    return J.read_keyed(spark, path), failed


def collect_chunks(tasks: DataFrame, path: str, chunk: int, run: Callable[[DataFrame], DataFrame], order: str = "ord", retries: int = 3, reload: Callable[[], None] = lambda: None) -> int:
    """Collect in chunks of the ordered tasks, one folder each, and go on where an earlier run ended; how many rows there are.

    A chunk that was not committed whole is collected anew, up to ``retries``
    times with ``reload`` between; collection stops after a short chunk.
    """
    spark, numbered, number, total = tasks.sparkSession, row_index(tasks, order, "_i"), 0, 0
    while True:
        target, rows = f"{path}/chunk={number}", None
        part = numbered.where((F.col("_i") >= number * chunk) & (F.col("_i") < (number + 1) * chunk)).drop("_i")
        for attempt in range(retries):
            if exists(spark, f"{target}/_SUCCESS"):
                break
            try:
                rows = J.written(run(part), lambda df: df.write.mode("overwrite").json(target), n=F.count("*"))["n"]
                break
            except Exception:
                if attempt == retries - 1:
                    raise
                reload()
        if rows is None:  # of an earlier run
            rows = spark.read.text(target).count()
        total += rows
        if rows < chunk:
            return total
        number += 1


def ablation(traces: DataFrame, router_large) -> DataFrame:
    """Scores and costs of the four variants: always large, always small, router, and the full policy."""
    label = T.need_large(F.col("small_success"), F.col("large_success"))
    cases = {"large": F.lit(True), "skills": F.lit(False), "router": router_large, "full": router_large}
    rows = traces.withColumn("v", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("large")) for n, c in cases.items()]))).select("*", "v.variant", "v.large")
    return R.router_score(rows, label, F.col("large"), "variant").join(R.policy_metrics(rows, F.col("large"), "variant"), "variant")


def curate(episodes: list[DataFrame]) -> DataFrame:
    """Demonstrations from episodes in order of priority: verified, cleaned, with a target, first of each task, balanced.

    episodes: domain, task_id, m (messages), passed, complete, branch, opd_used, ord.
    """
    rows = None
    for i, e in enumerate(episodes):
        e = e.withColumn("file_ord", F.lit(i))
        rows = e if rows is None else rows.unionByName(e)
    kept = rows.where(F.col("passed") & F.col("complete"))
    mask = lambda m: M.opd_mask(m, F.col("branch"), F.col("opd_used"))
    for step in (mask, M.clean, M.drop_pre_user, M.merge_tool_runs):
        # an exploded row of one: as columns the steps would be merged into one another, and into the filter, and worked out anew for each message
        kept = kept.withColumn("m", F.explode(F.array(step(F.col("m")))))
    kept = kept.where(M.has_target(F.col("m")))
    return C.balanced(C.first_wins(kept, ["domain", "task_id"], ["file_ord", "ord"]).drop("file_ord"))


def agent_rows(traces: DataFrame, contexts: DataFrame, skills: DataFrame, seed: int = 0, max_steps: int = 100, name: str = "agent", counts: Observation | None = None) -> DataFrame:
    """Rows for reinforcement learning of agents: system prompt with tools, first user message, and how to start the episode.

    traces: domain, task_id, m, ord; contexts: domain, system, tools (of the
    domain's first task); skills: domain, procedure.  Traces without messages
    are left out; ``counts`` tells how many of how many.
    """
    empty = F.coalesce(F.size("m"), F.lit(0)) <= 0
    kept = traces.where(~empty)
    if counts is not None:  # written first: dealing rows to ranges reads them twice, and would count them twice
        held = temporary_path(traces.sparkSession, "agents")
        traces.observe(counts, F.count_if(empty).alias("skipped"), F.count("*").alias("n")).where(~empty).write.parquet(held)
        kept = traces.sparkSession.read.schema(kept.schema).parquet(held)
    rows = row_index(kept, "ord", "index").join(contexts, "domain").join(skills, "domain", "left")
    first = M.first_user(F.col("m"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    start = F.struct(
        F.lit(name).alias("name"), "domain", F.col("task_id").cast("string").alias("task_id"), F.lit(seed).alias("seed"), F.lit(max_steps).alias("max_steps"),
        F.coalesce("procedure", F.lit("")).alias("skill_text"), first.alias("expected_initial_user"),
    )
    return rows.select(
        F.lit(name).alias("data_source"), F.array(message("system", F.concat("system", F.coalesce("tools", F.lit("")))), message("user", first)).alias("prompt"), F.col("domain").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.lit("environment").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit("train").alias("split"), "index", start.alias("interaction_kwargs")).alias("extra_info"),
    )


def skipped_agents(traces: DataFrame) -> DataFrame:
    return traces.agg(F.count_if(F.coalesce(F.size("m"), F.lit(0)) == 0).alias("skipped"), F.count("*").alias("n"))


def call_arguments(base: str, temperature: float = 0.0, max_tokens: int | None = None, thinking: bool | None = None, key: str = "EMPTY") -> dict:
    """The arguments of a model endpoint; what is None is left to the endpoint."""
    more = {"max_tokens": max_tokens, "extra_body": None if thinking is None else {"chat_template_kwargs": {"enable_thinking": thinking}}}
    return {"api_base": base, "api_key": key, "temperature": temperature} | {k: v for k, v in more.items() if v is not None}


def gates(pairs: DataFrame, examples: DataFrame, least: int = 12) -> DataFrame:
    """Whether there are enough tuning rows, and router examples of both labels."""
    counted = examples.agg(F.count_if(F.col("label") == 0).alias("n_small"), F.count_if(F.col("label") == 1).alias("n_large"))
    both = (F.col("n_small") > 0) & (F.col("n_large") > 0)
    return pairs.agg(F.count("*").alias("n_pairs")).crossJoin(counted).withColumn("enough_pairs", F.col("n_pairs") >= least).withColumn("both_labels", both)


@dataclass
class Cycle:
    """One closed loop over task traces, written below ``root``/cycle=N."""

    spark: SparkSession
    root: str
    number: int = 0
    stages: list[str] = field(default_factory=list)
    fit: Callable[[DataFrame], Router] = vector_router

    def path(self, name: str) -> str:
        return f"{self.root}/cycle={self.number}/{name}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        self.stages.append(name)
        return self.spark.read.parquet(self.path(name))

    def run(self, tasks: DataFrame, previous: DataFrame | None = None, mechanisms: tuple[str, ...] = ("skills", "sft", "rl", "router")) -> dict[str, DataFrame]:
        """collect, skill statistics, diagnostics, tuning pairs, rows for learning, router, threshold, evaluation, ablation.

        The router learns from the training shards' samples, its threshold from
        its own predictions on the calibration shard, and the held-out shard is
        collected with both.  mechanisms: what a single-mechanism recipe wants.
        """
        out: dict[str, DataFrame] = {}
        train = C.sharded(tasks, 5, [0, 2, 3])
        out["traces"] = self.keep("traces", collect(train, self.number))
        out["diagnostics"] = self.keep("diagnostics", T.diagnostics(out["traces"]))
        if "skills" in mechanisms:
            stats = S.stats(S.observations(out["traces"]))
            out["skill_stats"] = self.keep("skill_stats", S.merge_stats(previous, stats) if previous is not None else stats)
        if "sft" in mechanisms:
            out["sft_pairs"] = self.keep("sft_pairs", C.sft_pairs(out["traces"]))
        if "rl" in mechanisms:
            out["rl_rows"] = self.keep("rl_rows", C.rl_rows(train, "train"))
        held = C.sharded(tasks, 5, [4])
        if "router" in mechanisms:
            if "sft" in mechanisms:
                out["gates"] = self.keep("gates", gates(out["sft_pairs"], T.binomial_examples(out["traces"])))
            router = self.fit(out["traces"])
            out["calibration"] = self.keep("calibration", router(collect(C.sharded(tasks, 5, [1]), self.number)))
            out["threshold"] = self.keep("threshold", R.choose_threshold(R.sweep(out["calibration"], F.col("prob"), "verified", 1, 99)))
            chosen = out["threshold"].first()
            out["held_out"] = self.keep("held_out", collect(held, self.number, router=router, threshold=chosen["threshold"] if chosen else 0.5))
        else:
            out["held_out"] = self.keep("held_out", collect(held, self.number))
        out["ablation"] = self.keep("ablation", ablation(out["held_out"], F.col("policy_route") == "large"))
        return out


def common_calls(signature: str, exemplars: list[dict], pitfalls: list[str], patterns: list[str]) -> tuple[list[str], list[str]]:
    """A distiller without a model: the calls that most successes make first, after what was known."""
    first = Counter(next((line for line in e["completion"].splitlines() if "[tool_call " in line), "").partition("]:")[0].rpartition(" ")[2] for e in exemplars)
    first.pop("", None)
    said = [f"Most successful episodes call {name} first." for name, _ in sorted(first.items(), key=lambda x: (-x[1], x[0]))[:1]]
    return pitfalls, [*(p for p in patterns if p not in said), *said]


def escalated_at(points: DataFrame, router: dict[str, float]) -> DataFrame:
    """domain, task_id, prefix: the first decision point at which the router hands over, of episodes that have one.

    points: domain, task_id, prefix and the router's features; router: a weight
    of each, bias and threshold (empty: it never hands over).
    """
    w = {n: router[n] for n in M.FEATURES if n in router}
    hit = M.linear_score({n: F.col(n) for n in w}, w, router["bias"]) >= router["threshold"] if router else F.lit(False)
    return points.where(hit).groupBy("domain", "task_id").agg(F.min("prefix").alias("prefix"))


def features_at(points: DataFrame) -> DataFrame:
    """points: domain, task_id, m, prefix and more -> the router's features of the messages up to the prefix in place of m."""
    rest = [c for c in points.columns if c != "m"]
    return points.select(*rest, M.router_features(F.slice("m", F.lit(1), F.col("prefix"))).alias("f")).select(*rest, "f.*")


@dataclass
class AgentCycle(Cycle):
    """One closed loop over agent episodes: rescues, demonstrations, lessons, rows for learning, an online router, paired evaluation."""

    #: At this probability the teacher takes over; None: at the mean of the router's own examples.
    threshold: float | None = None
    distiller: Callable = common_calls

    def run(self, episodes: DataFrame, contexts: DataFrame, attempts: DataFrame, held_out: DataFrame, teacher: DataFrame, lessons: DataFrame | None = None, router: DataFrame | None = None) -> dict[str, DataFrame]:
        """All stages, each written.

        episodes: domain, task_id, m, passed, complete, ord; attempts: domain,
        task_id, prefix, verified, rescued (the messages with the teacher's end)
        at decision points; held_out: domain, task_id, m, reward; teacher:
        domain, task_id, prefix, reward, what the teacher reaches from a decision
        point of a held-out episode; lessons (signature,
        pitfalls, patterns) and router (name, weight) of the cycle before.
        """
        keys = ["domain", "task_id"]
        out = {"episodes": self.keep("episodes", episodes)}
        mine = out["episodes"]
        failed = mine.where(~F.col("passed")).select(*keys, "ord")
        # of a failed episode the latest prefix from which the teacher made it
        out["rescues"] = self.keep("rescues", M.first_rescue(attempts.join(failed, keys), keys, F.col("prefix").desc()))
        saved = out["rescues"].select(*keys, F.col("rescued").alias("m"), F.lit(True).alias("passed"), F.lit(True).alias("complete"), F.col("prefix").alias("branch"), F.lit(True).alias("opd_used"), "ord")
        alone = mine.select(*keys, "m", "passed", "complete", F.lit(0).alias("branch"), F.lit(False).alias("opd_used"), "ord")
        out["demonstrations"] = self.keep("demonstrations", curate([alone, saved]))
        out["curation"] = self.keep("curation", C.curation_counts(alone.unionByName(saved).withColumn("has_target", M.has_target(F.col("m"))).withColumn("fallback_used", F.lit(False))))
        # every decision point of a passed episode goes on; that of a rescue hands over
        points = mine.select(*keys, "passed", "m", F.explode(M.decision_points(F.col("m"), 3)).alias("prefix"))
        labels = points.where("passed").select(*keys, "m", "prefix", F.lit(0).alias("label"))
        labels = labels.unionByName(points.where("NOT passed").join(out["rescues"].select(*keys, "prefix"), [*keys, "prefix"]).select(*keys, "m", "prefix", F.lit(1).alias("label")))
        out["examples"] = self.keep("examples", features_at(labels))
        out["counts"] = self.keep("counts", loop_counts(mine.join(out["rescues"].select(*keys, F.lit(True).alias("corrected")), keys, "left"), out["examples"]))
        counted = out["counts"].first()
        if counted["n_continue"] and counted["n_escalate"]:
            fitted = models.fit_descent_on(out["examples"].withColumn("key", F.concat_ws("|", *keys, "prefix")), list(M.FEATURES), key="key")
            weights = {r["name"]: r["weight"] for r in fitted.collect()}  # one row a feature
            names = {n: F.col(n) for n in M.FEATURES}
            mean = F.avg(M.linear_score(names, {n: weights[n] for n in names}, weights["bias"]))
            weights["threshold"] = out["examples"].agg(mean).first()[0] if self.threshold is None else self.threshold
        else:  # one label says nothing: the router that is deployed stays, and without one the student keeps all
            weights = {r["name"]: r["weight"] for r in router.collect()} if router is not None else {}
        out["router"] = self.keep("router", self.spark.createDataFrame(sorted(weights.items()), "name string, weight double"))
        # lessons of this cycle on top of those carried over
        told = mine.select(F.col("domain").alias("signature"), "task_id", F.lit("student").alias("model"), F.col("passed").alias("success"), M.first_user(F.col("m")).alias("prompt"), S.transcript(F.col("m")).alias("completion"), "ord")
        out["lessons"] = self.keep("lessons", S.distill(told, self.distiller, lessons))
        none = F.array().cast("array<string>")
        said = out["lessons"].select(F.col("signature").alias("domain"), S.render(F.col("signature"), F.lit(""), none, F.col("pitfalls"), F.col("patterns")).alias("procedure"))
        out["rl_rows"] = self.keep("rl_rows", agent_rows(mine, contexts, said, seed=self.number))
        # the held-out episodes with the router: from where it hands over, the teacher's reward counts
        decisions = features_at(held_out.select(*keys, "m", F.explode(M.decision_points(F.col("m"), 3)).alias("prefix")))
        switched = self.keep("switched", escalated_at(decisions, weights))
        other = switched.join(teacher.select(*keys, "prefix", F.col("reward").alias("_reward")), [*keys, "prefix"], "left")
        unknown = F.raise_error(F.concat(F.lit("no teacher's result: "), "domain", F.lit("/"), "task_id")).cast("double")
        result = held_out.select(*keys, "reward").join(other, keys, "left").select(*keys, F.col("prefix").isNotNull().alias("escalated"), F.when(F.col("prefix").isNull(), F.col("reward")).otherwise(F.coalesce("_reward", unknown)).alias("reward"))
        out["held_out"] = self.keep("held_out", result)
        out["paired"] = self.keep("paired", R.mcnemar(R.paired(held_out, out["held_out"], keys)))
        # the training episodes with the same router, for the next cycle: where it hands over, what the teacher did there counts
        again = escalated_at(features_at(mine.select(*keys, "m", F.explode(M.decision_points(F.col("m"), 3)).alias("prefix"))), weights)
        done = again.join(attempts.select(*keys, "prefix", "verified", "rescued"), [*keys, "prefix"]).select(*keys, "verified", "rescued")
        took = F.coalesce("verified", F.lit(False))
        rollout = mine.join(done, keys, "left").select(*keys, F.when(took, F.col("rescued")).otherwise(F.col("m")).alias("m"), (F.col("passed") & F.col("verified").isNull() | took).alias("passed"), "complete", "ord")
        out["rollout"] = self.keep("rollout", rollout)
        return out


def agent_cycles(spark: SparkSession, root: str, cycles: int, episodes: DataFrame, contexts: DataFrame, attempts: DataFrame, held_out: DataFrame, teacher: DataFrame, **options) -> list[dict[str, DataFrame]]:
    """Closed loops one after another: lessons and router are carried on, and what router and teacher did is the next cycle's input.

    These are versioned tables below ``root``; a run that was cut off goes on
    after the last cycle that published all of them.
    """
    paths, done = {k: f"{root}/versions/{k}" for k in ("rollout", "lessons", "router")}, []
    newest = [versions.latest(spark, p) for p in paths.values()]
    for number in range(0 if None in newest else min(newest) + 1, cycles):
        carried = {}
        if number:
            carried = {k: versions.read(spark, p, number - 1) for k, p in paths.items()}
            episodes = carried.pop("rollout")
        done.append(AgentCycle(spark, root, number, **options).run(episodes, contexts, attempts, held_out, teacher, **carried))
        for k, p in paths.items():
            if versions.latest(spark, p) != number:  # else published before the run was cut off
                versions.publish(done[-1][k], p, f"cycle {number}")
    return done


def loop_counts(episodes: DataFrame, examples: DataFrame) -> DataFrame:
    """How many failed episodes were rescued, and how many examples say go on or hand over."""
    found = episodes.agg(F.count_if(~F.col("passed")).alias("n_failed"), F.count_if("corrected").alias("n_corrected"))
    return found.crossJoin(examples.agg(F.count_if(F.col("label") == 0).alias("n_continue"), F.count_if(F.col("label") == 1).alias("n_escalate")))


def report(rows: list[dict], folder: str, name: str) -> None:
    """A report as JSON and Markdown."""
    os.makedirs(folder, exist_ok=True)
    J.write_report(os.path.join(folder, f"{name}.json"), {"rows": rows})
    with open(os.path.join(folder, f"{name}.md"), "w", encoding="utf-8") as f:
        f.write(J.markdown(name, rows))


#: (benchmark, recipe) -> what runs, for the command line.
RECIPES = {
    ("code", "cycle"): "one closed loop over code tasks",
    ("code", "4cycle"): "four closed loops, skill statistics carried over",
    ("code", "baselines"): "routing methods compared on the held-out shard",
    ("code", "ablation"): "variants of the deployed policy",
    ("code", "skills"): "one mechanism alone: skill statistics",
    ("code", "sft"): "one mechanism alone: tuning pairs",
    ("code", "rl"): "one mechanism alone: rows for reinforcement learning",
    ("agent", "cycle"): "one closed loop over agent episodes",
    ("agent", "4cycle"): "four closed loops, lessons and rollouts carried over",
    ("agent", "skills"): "one mechanism alone: lessons of the episodes",
    ("agent", "sft"): "one mechanism alone: curated demonstrations",
    ("agent", "router"): "one mechanism alone: the online router, paired with the student",
    ("agent", "features"): "router features of agent episodes",
    ("agent", "paired"): "paired test of two result sets",
}
