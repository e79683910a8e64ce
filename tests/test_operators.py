"""Cases of the operators on literal rows."""

import hashlib
import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lodestone.functions import md5_mod, row_index, sha256_mod, stable_fraction
from lodestone.operators import curation as C
from lodestone.operators import messages as M
from lodestone.operators import models, verify
from lodestone.operators import routing as R
from lodestone.operators import skills as S
from lodestone.operators import traces as T

ROUTES = "task_id string, dataset string, prompt string, small_success boolean, large_success boolean, small_cost double, large_cost double"


def routes(spark, *outcomes):
    return spark.createDataFrame([(f"t{i}", "humaneval", f"p{i}", s, l, 0.001, 0.01) for i, (s, l) in enumerate(outcomes)], ROUTES)


def test_row_index(spark):
    df = spark.createDataFrame([(x,) for x in [5, None, -3, 10**12, 7, 5, 0]], "ord long")
    for frame in (df, df.withColumn("ord", F.col("ord").cast("string"))):
        got = row_index(frame, "ord", "i", 3).orderBy("i").collect()
        assert [r["i"] for r in got] == list(range(7)) and [r["ord"] for r in got] == [r["ord"] for r in frame.orderBy(F.col("ord").asc_nulls_first()).collect()]
    assert row_index(df.limit(0), "ord", "i").count() == 0


def one(df):
    return df.collect()[0].asDict()


def test_hashes_equal_big_integers(spark):
    keys = [f"doc/{i}" for i in range(50)] + ["", "é", "x" * 300]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", sha256_mod(F.col("k"), 7).alias("s"), md5_mod(F.col("k"), 10).alias("m"), stable_fraction(F.col("k"), 3).alias("f"))
    for r in df.collect():
        assert r["s"] == int(hashlib.sha256(r["k"].encode()).hexdigest(), 16) % 7
        assert r["m"] == int(hashlib.md5(r["k"].encode()).hexdigest(), 16) % 10
        assert r["f"] == int.from_bytes(hashlib.sha256(f"3:{r['k']}".encode()).digest()[:8], "big") / 2**64


def test_shards_partition_the_tasks(spark):
    df = spark.createDataFrame([(f"t{i}",) for i in range(50)], "task_id string")
    parts = [{r[0] for r in C.sharded(df, 5, [k]).collect()} for k in range(5)]
    assert sum(map(len, parts)) == 50 and len(set().union(*parts)) == 50
    assert {r[0] for r in C.sharded(df, 5, [0, 2]).collect()} == parts[0] | parts[2]
    with pytest.raises(ValueError):
        C.sharded(df, 5, [5])


def test_direct_and_cascade_policies(spark):
    rows = routes(spark, (True, False), (False, True))
    direct = one(R.simulate(rows, F.lit(False), "direct"))
    verified = one(R.simulate(rows, F.lit(False), "verified"))
    assert (direct["passes"], verified["passes"]) == (1, 2)
    assert verified["fallback_rate"] == 0.5 and verified["cost_vs_large"] == pytest.approx(0.6)
    cascade = one(R.simulate(routes(spark, (False, True)), F.lit(True), "cascade"))
    assert cascade["passes"] == 1 and cascade["cost_vs_large"] == pytest.approx(1.1) and cascade["fallback_rate"] == 1.0


def test_exact_cache_and_support(spark):
    train = spark.createDataFrame([("a", "humaneval", "same", True, True, 0.001, 0.01)], ROUTES)
    rows = spark.createDataFrame([("b", "humaneval", "same", False, True, 0.001, 0.01), ("c", "humaneval", "new", True, True, 0.001, 0.01)], ROUTES)
    hit = one(R.exact_cache(train, rows))
    assert (hit["cache_hits"], hit["cache_coverage"], hit["passes"]) == (1, 0.5, 2)
    curve = {r["minimum"]: r for r in R.support_curve(train, rows, F.lit(False), (0, 10)).collect()}
    assert curve[10]["abstained"] == "humaneval" and curve[10]["direct_large_rate"] == 1.0 and curve[0]["abstained"] == ""


def test_coverage_ends(spark):
    rows = routes(spark, (True, False), (False, True))
    curve = {r["coverage"]: r for r in R.coverage_curve(rows, F.lit(False), 3).collect()}
    assert curve[0.0]["pass_rate_mean"] == 0.5 and curve[0.0]["cost_vs_large_mean"] == pytest.approx(1.0)
    assert curve[1.0]["pass_rate_mean"] == 1.0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(probs=st.lists(st.one_of(st.floats(0, 1), st.integers(0, 100).map(lambda i: i / 100)), min_size=1, max_size=30))
def test_sweep_equals_every_policy(spark, probs):
    df = spark.createDataFrame([(f"t{i}", "d", "p", i % 3 > 0, i % 4 > 0, 0.001, 0.01, float(p)) for i, p in enumerate(probs)], ROUTES + ", prob double")
    got = {round(r["threshold"], 2): r["passes"] for r in R.sweep(df, F.col("prob"), "verified").collect()}
    for k in (0, 1, 50, 99, 100):
        want = sum((i % 4 > 0) if p >= k / 100 else (i % 3 > 0) or (i % 4 > 0) for i, p in enumerate(probs))
        assert got[k / 100] == want


def test_threshold_choice_prefers_cheap_then_low(spark):
    curve = spark.createDataFrame([(0.1, 0.9, 5.0), (0.2, 0.95, 3.0), (0.3, 0.95, 3.0), (0.4, 0.5, 1.0)], "threshold double, pass_rate double, avg_cost double")
    assert one(R.choose_threshold(curve, F.lit(0.9)))["threshold"] == 0.2
    assert one(R.choose_threshold(curve, F.lit(0.99)))["threshold"] == 0.2
    assert one(R.choose_threshold(curve))["threshold"] == 0.4


def test_mcnemar_tail_and_key_mismatch(spark):
    keys = [("d", str(i)) for i in range(35)]
    base = spark.createDataFrame([(*k, 1.0 if 7 <= i < 20 else 0.0) for i, k in enumerate(keys)], "domain string, task_id string, reward double")
    cand = spark.createDataFrame([(*k, 1.0 if i < 7 or 10 <= i < 20 else 0.0) for i, k in enumerate(keys)], "domain string, task_id string, reward double")
    got = one(R.mcnemar(R.paired(base, cand, ["domain", "task_id"])))
    assert (got["wins"], got["losses"], got["ties"]) == (7, 3, 25) and got["p_value"] == pytest.approx(0.171875) and not got["significant"]
    with pytest.raises(Exception, match="different tasks"):
        R.mcnemar(R.paired(base, cand.limit(3), ["domain", "task_id"])).collect()


def test_labels_and_binomial_examples(spark):
    df = routes(spark, (True, True), (False, True), (True, True), (False, True), (False, False))
    assert [r[0] for r in df.select(T.need_large(F.col("small_success"), F.col("large_success")).cast("int")).collect()] == [0, 1, 0, 1, 0]
    rows = spark.createDataFrame([("a", 3, 2, True, True), ("b", 2, 0, False, True)], "task_id string, small_samples int, small_pass_count int, small_success boolean, large_success boolean")
    got = T.binomial_examples(rows).collect()
    assert sorted(r["label"] for r in got) == [0, 0, 1, 1, 1] and len({r["task_id"] for r in got}) == 2


def test_unknown_large_outcomes(spark):
    df = routes(spark, (True, False), (False, True)).withColumn("large_skipped", F.col("task_id") == "t1")
    got = one(R.policy_metrics(df, F.lit(False)))
    assert got["task_pass"] == 1.0 and got["unknown_rate"] == 0.5 and got["fallback_rate"] == 0.0


def test_pairs(spark):
    kind = "task_id string, prompt string, small_success boolean, large_success boolean, large_completion string, small_turns array<struct<success:boolean,completion:string>>"
    df = spark.createDataFrame([("a", "p", False, True, "L", []), ("b", "p", True, True, "L", [(False, "x"), (True, "y")]), ("c", "p", True, True, "L", [(True, "x")]), ("d", "", False, True, "L", [])], kind)
    got = {(r["task_id"], r["source"], r["messages"][2]["content"]) for r in C.sft_pairs(df).collect()}
    assert got == {("a", "teacher", "L"), ("b", "self_repair", "y")}


def test_cache_key_is_canonical_json(spark):
    df = spark.createDataFrame([("t/1", 'say "hi"\n')], "task_id string, prompt string")
    got = one(df.select(C.cache_key(F.col("task_id"), F.col("prompt"), "m", 0.0, 64, 1).alias("k"), C.cache_key(F.col("task_id"), F.col("prompt"), "m", 0.2, 64, 1).alias("j")))
    payload = {"model": "m", "task_id": "t/1", "prompt": 'say "hi"\n', "temperature": 0.0, "max_tokens": 64, "repair_turns": 1, "large_use_skills": False}
    assert got["k"] == hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest() and got["k"] != got["j"]


def test_balance_and_interleave(spark):
    df = spark.createDataFrame([("airline", "a0", 0), ("airline", "a1", 1), ("retail", "r0", 2), ("telecom", "t0", 3)], "domain string, task string, ord int")
    assert [r["task"] for r in C.interleaved(df).collect()] == ["a0", "r0", "t0", "a1", "r0", "t0"]


def test_first_wins_compares_ids_as_text(spark):
    df = spark.createDataFrame([("d", "1", 0), ("d", "1", 1), ("d", "2", 2)], "domain string, task_id string, ord int")
    assert sorted(r["ord"] for r in C.first_wins(df, ["domain", "task_id"], ["ord"]).collect()) == [0, 2]


def conversation(spark, *messages):
    rows = [(m.get("role"), m.get("content"), m.get("tool_calls"), m.get("error"), m.get("requestor"), m.get("_trainable")) for m in messages]
    return spark.createDataFrame([(rows,)], StructType().add("m", ArrayType(M.MESSAGE)))


def test_message_cleaning(spark):
    call = [("lookup", None, '{"user_id":"123"}')]
    df = conversation(spark, {"role": "assistant", "content": "hello"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "gone", "tool_calls": call}, {"role": "tool", "content": "a"}, {"role": "tool", "content": "b"})
    got = one(df.select(M.merge_tool_runs(M.drop_pre_user(M.clean(F.col("m")))).alias("m")))["m"]
    assert [(x["role"], x["content"]) for x in got] == [("user", "hi"), ("assistant", '<tool_call>\n{"name":"lookup","arguments":{"user_id":"123"}}\n</tool_call>'), ("tool", "a\nb")]


def test_targets_and_prefixes(spark):
    df = conversation(spark, {"role": "user", "content": "q"}, {"role": "assistant", "content": " ", "_trainable": True}, {"role": "assistant", "content": "x", "_trainable": False})
    assert not one(df.select(M.has_target(F.col("m")).alias("t")))["t"]
    turns = [{"role": r, "content": "x"} for r in ("system", "user", "assistant", "user", "assistant", "user", "assistant")]
    df = conversation(spark, *turns)
    assert one(df.select(M.decision_points(F.col("m"), 2).alias("p")))["p"] == [6, 2]
    assert one(df.select(M.decision_points(F.col("m"), 1).alias("p")))["p"] == [6]
    assert one(df.select(M.decision_points(F.col("m"), 9).alias("p")))["p"] == [6, 4, 2]


def test_features(spark):
    df = conversation(spark, {"role": "user", "content": "q"}, {"role": "assistant", "tool_calls": [("f", None, "{}")]}, {"role": "tool", "content": "Error: no"})
    got = one(df.select(M.router_features(F.col("m")).alias("f")).select("f.*"))
    assert list(got) == list(M.FEATURES) and got["tool_error_fraction"] == 1.0 and got["last_input_is_tool_error"] == 1.0 and got["step_fraction"] == 3 / 40
    empty = one(conversation(spark).select(M.router_features(F.col("m")).alias("f")).select("f.*"))
    assert set(empty.values()) == {0.0}


def test_action_recall(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "a"], True), ([], ["x"], True), (["a"], ["a", "b"], True)], "w array<string>, o array<string>, d boolean")
    got = df.select(M.action_recall(F.col("w"), F.col("o")).alias("r"), M.action_complete(F.col("w"), F.col("o"), F.col("d")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(0.5, False), (1.0, True), (1.0, True)]


def test_skills(spark):
    df = routes(spark, (True, True), (False, True)).withColumn("ord", F.monotonically_increasing_id()).withColumn("small_completion", F.lit("s")).withColumn("large_completion", F.lit("l"))
    obs = S.observations(df)
    got = {(r["signature"], r["model"]): (r["successes"], r["total"]) for r in S.stats(obs).collect()}
    assert got == {("humaneval", "small"): (1, 2), ("humaneval", "large"): (2, 2)}
    assert S.exemplars(obs).count() == 3
    text = one(spark.range(1).select(S.render(F.lit("x"), F.lit("w"), F.array(F.lit("one")), F.array(F.lit("p")), F.array().cast("array<string>"), 40).alias("t")))["t"]
    assert text == "# Skill: x\n\n## When to use\nw"
    lesson = one(S.lessons(spark.createDataFrame([("k", "PITFALLS\n- a\n* b\nPATTERNS:\n-- c")], "k string, text string"), "k"))
    assert (lesson["pitfalls"], lesson["patterns"]) == (["a", "b"], ["c"])
    failing = S.distill(obs, lambda *_: 1 / 0).collect()
    assert failing[0]["pitfalls"] == []


def test_code_extraction_and_verification(spark):
    cases = [
        ("```python\ndef f(x):\n    return x\n```", "f", "", "def f(x):\n    return x"),
        ("Here:\n```\nimport os\ndef f(): pass\n```", "f", "", "import os\ndef f(): pass"),
        ("return x + 1", "f", "def f(x):\n", "def f(x):\n    return x + 1"),
        ("def f(x):\n    return 1\nExplanation: because", "f", "", "def f(x):\n    return 1"),
        ("", "f", "", ""),
        (None, None, None, ""),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, response string, entry_point string, prompt string")
    got = [r["c"] for r in df.select("i", verify.extract_code(F.col("response"), F.col("entry_point"), F.col("prompt")).alias("c")).orderBy("i").collect()]
    assert got == [c[3] for c in cases]
    task = spark.createDataFrame([("```python\ndef f(x):\n    return x + 1\n```", "f", "", "def check(g):\n    assert g(1) == 2"), ("def f(x): return 0", "f", "", "def check(g):\n    assert g(1) == 2")], "response string, entry_point string, prompt string, test string")
    assert [(r["success"], r["reward"]) for r in verify.verify(task).collect()] == [(True, 1.0), (False, 0.0)]
    assert verify.run_tests("while True: pass", "", "f", timeout=0.5) == (False, "Timeout")
    assert verify.reward(False, "x = 1", 0.5) == 0.1 and verify.reward(False, "x =", 0.5) == 0.0


def test_models(spark):
    w, b = models.fit_descent(np.vstack([np.zeros((4, 3)), np.ones((4, 3))]), np.array([0.0] * 4 + [1.0] * 4))
    score = lambda x: 1 / (1 + np.exp(-(x @ w + b)))
    assert score(np.zeros(3)) < 0.5 < score(np.ones(3))
    with pytest.raises(ValueError):
        models.fit_descent(np.zeros((2, 1)), np.zeros(2))
    scored = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1)], "prob double, label int")
    assert one(models.auc(scored))["auc"] == pytest.approx(0.875)
    ids = spark.createDataFrame([([1, 2, 9, 5, 3, 1, 2, 8, 3], [True, False]), ([1, 2, 9], [True]), ([1, 2, 9, 3], [])], "t array<int>, a array<boolean>")
    got = [r["m"] for r in ids.select(models.loss_mask(F.col("t"), [1, 2], 3, F.col("a")).alias("m")).collect()]
    assert got == [[0, 0, 1, 1, 1, 0, 0, 0, 0], None, None]


def test_bounds_and_rewards(spark):
    df = spark.createDataFrame([(2048, 240, 500), (100, 0, 5)], "c int, x int, r int")
    assert [r[0] for r in df.select(T.bounded_tokens(F.col("c"), F.col("x"), F.col("r"))).collect()] == [240, None]


def test_shortest_of_all_successes(spark, monkeypatch):
    """topk_examples takes the shortest of all successes, not of the latest MAX_EXEMPLARS."""
    from lodestone.plans import QUERIES

    want = sorted(tuple(r) for r in QUERIES["topk_examples"](spark, "/root/testdata/sf0.001").collect())
    kept = S.exemplars.__defaults__
    monkeypatch.setattr(S.exemplars, "__defaults__", (7,))
    assert sorted(tuple(r) for r in QUERIES["topk_examples"](spark, "/root/testdata/sf0.001").collect()) == want
    assert kept == (S.MAX_EXEMPLARS,)


def test_loss_masks_of_long_and_odd_rows(spark):
    rows = [([], []), ([], [True]), (None, [True]), ([1, 2, 3], None), ([1, 2, 1, 2, 3], [True]), ([1, 2, None, 3], [True]), ([None, 1, 2, 3], [None]), ([1, 2, 3, 1], [True]), ([1, 2, 4, 3] * 40_000, [True, False] * 20_000)]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, r struct<t: array<int>, a: array<boolean>>")
    got = [r["m"] for r in df.select("k", models.loss_mask(F.col("r.t"), [1, 2], 3, F.col("r.a")).alias("m")).orderBy("k").collect()]
    assert got[:-1] == [[], None, None, None, [0, 0, 1, 1, 1], None, [0, 0, 0, 0], [0, 0, 1, 0]]
    assert got[-1] == [0, 0, 1, 1, 0, 0, 0, 0] * 20_000


def test_descent_on_all_rows(spark, monkeypatch):
    """The router is fitted on every example, be they in one task or in parts."""
    rows = spark.range(0, 1000, 1, 3).select("id", (F.col("id") % 13 / 13).alias("a"), F.when(F.col("id") % 7 == 0, 1.0).otherwise(-0.5).alias("b"), (F.col("id") * 31 % 97 < 20 + F.col("id") % 13).cast("int").alias("label"))
    pdf, fit = rows.toPandas(), lambda: {r["name"]: r["weight"] for r in models.fit_descent_on(rows, ["a", "b"], key="id", epochs=20).collect()}
    w, b = models.fit_descent(pdf[["a", "b"]].to_numpy(), pdf["label"].to_numpy().astype(float), epochs=20)
    want = pytest.approx({"a": w[0], "b": w[1], "bias": b}, abs=1e-12)
    assert fit() == want
    for bound in (999, 100):
        monkeypatch.setattr(models, "DESCENT_ROWS", bound)
        assert fit() == want
    monkeypatch.undo()
    assert models.fit_descent_on(rows.limit(0), ["a", "b"], key="id").collect() == []
    # one more than a task holds, and that one alone says to hand over: the row of the largest hash
    many = spark.range(models.DESCENT_ROWS + 1).select("id", F.lit(1.0).alias("a"))
    last = many.agg(F.max_by("id", F.xxhash64("id"))).first()[0]
    found = models.fit_descent_on(many.withColumn("label", (F.col("id") == last).cast("int")), ["a"], key="id", epochs=1)
    p = 1 / (1 + np.exp(-np.log(2 / (models.DESCENT_ROWS + 1))))
    slope = (p * (models.DESCENT_ROWS + 1) - 1) / (models.DESCENT_ROWS + 1)
    assert {r["name"]: r["weight"] for r in found.collect()} == pytest.approx({"a": -0.1 * slope, "bias": np.log(2 / (models.DESCENT_ROWS + 1)) - 0.1 * slope})
