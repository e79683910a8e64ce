"""Closed loops over agent episodes, and the versioned tables between them."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lodestone.operators import messages as M
from lodestone.plans import loops
from lodestone.sources import versions


def message(role, content, call=None):
    return (role, content, [(call, None, "{}")] if call else None, None, None, None)


@pytest.fixture(scope="module")
def tables(spark):
    """Episodes that fail exactly when the tools fail; the teacher makes it from every second decision point on."""
    keys = StructType().add("domain", "string").add("task_id", "string")
    with_m = lambda: StructType(list(keys.fields)).add("m", ArrayType(M.MESSAGE))
    train, held, attempts, teacher = [], [], [], []
    for k in range(60):
        bad = k % 3 == 0
        m = [message("user", f"task {k}"), message("assistant", "", "find"), message("tool", "Error: no" if bad else "ok"), message("assistant", "again" if bad else "done"), message("tool", "Error: no" if bad else "ok"), message("assistant", "end")]
        (held if k % 5 == 4 else train).append(("ab"[k % 2], str(k), m, not bad, k))
        for prefix in (1, 3, 5):
            saved = [*m[:prefix], message("assistant", "by the teacher")]
            attempts.append(("ab"[k % 2], str(k), prefix, prefix != 5, saved)) if k % 5 != 4 else teacher.append(("ab"[k % 2], str(k), prefix, 1.0 if prefix == 3 else 0.0))
    make = spark.createDataFrame
    episodes = make(train, with_m().add("passed", "boolean").add("ord", "long")).withColumn("complete", F.lit(True)).select("domain", "task_id", "m", "passed", "complete", "ord")
    contexts = make([("a", "be good", ""), ("b", "be good", "")], "domain string, system string, tools string")
    tried = make(attempts, StructType(list(keys.fields)).add("prefix", "integer").add("verified", "boolean").add("rescued", ArrayType(M.MESSAGE)))
    results = make(held, with_m().add("passed", "boolean").add("ord", "long")).select("domain", "task_id", "m", F.when(F.col("passed"), 1.0).otherwise(0.0).alias("reward"))
    return episodes, contexts, tried, results, make(teacher, "domain string, task_id string, prefix int, reward double")


def test_the_router_changes_the_outcome(spark, tables, tmp_path):
    done = loops.AgentCycle(spark, str(tmp_path)).run(*tables)
    rescued = {r["task_id"]: r["prefix"] for r in done["rescues"].collect()}
    assert rescued and set(rescued.values()) == {3} and all(int(k) % 3 == 0 for k in rescued)
    held = {int(r["task_id"]): r for r in done["held_out"].collect()}
    # the router hands over where the tools fail, and the teacher's reward from there on counts
    assert all(r["escalated"] == (k % 3 == 0) and r["reward"] == 1.0 for k, r in held.items())
    paired = done["paired"].first()
    assert paired["wins"] == sum(k % 3 == 0 for k in held) > 0 and paired["losses"] == 0
    never = loops.AgentCycle(spark, str(tmp_path / "never"), threshold=1.1).run(*tables)["paired"].first()
    assert never["wins"] == 0 and never["cand_passes"] == paired["base_passes"]
    # rescued episodes are demonstrations whose teacher's messages alone may be trained on
    shown = {r["task_id"]: r["m"] for r in done["demonstrations"].collect()}
    corrected = [m for k, m in shown.items() if int(k) % 3 == 0]
    assert corrected and all([x["content"] for x in m if x["role"] == "assistant" and x["_trainable"]] == ["by the teacher"] for m in corrected)
    assert done["counts"].first()["n_failed"] == done["counts"].first()["n_corrected"] == len(rescued)


def test_lessons_and_rollouts_are_carried_on(spark, tables, tmp_path):
    def teller(signature, exemplars, pitfalls, patterns):
        return pitfalls, [*patterns, f"{len(exemplars)} passed"]

    two = loops.agent_cycles(spark, str(tmp_path), 2, *tables, distiller=teller)
    lessons = {r["signature"]: r["patterns"] for r in two[1]["lessons"].collect()}
    counts = [{r["domain"]: r["n"] for r in c["episodes"].where("passed").groupBy("domain").agg(F.count("*").alias("n")).collect()} for c in two]
    assert all(lessons[d] == [f"{counts[0][d]} passed", f"{counts[1][d]} passed"] for d in "ab")
    # what the deployed teacher mended is the second cycle's input
    assert all(counts[1][d] > counts[0][d] for d in "ab")
    assert f"{counts[0]['a']} passed" in two[0]["rl_rows"].where("ability = 'a'").first()["extra_info"]["interaction_kwargs"]["skill_text"]
    assert [m["note"] for m in versions.history(spark, str(tmp_path / "versions" / "rollout"))] == ["cycle 0", "cycle 1"]
    # nothing is done twice; a third cycle begins where the second ended
    three = loops.agent_cycles(spark, str(tmp_path), 3, *tables, distiller=teller)
    assert len(three) == 1 and len(three[0]["lessons"].where("signature = 'a'").first()["patterns"]) == 3
    # all failures are mended, so no example hands over: the first router stays deployed
    assert two[1]["counts"].first()["n_escalate"] == 0 and two[1]["router"].collect() == two[0]["router"].collect() != []
    assert two[1]["paired"].first() == two[0]["paired"].first()


def test_a_missing_teachers_result_is_an_error(spark, tables, tmp_path):
    *most, teacher = tables
    with pytest.raises(Exception, match="no teacher's result"):
        loops.AgentCycle(spark, str(tmp_path)).run(*most, teacher.where("prefix <> 3"))


def test_a_version_stays_while_the_next_is_written(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert versions.latest(spark, path) is None and versions.history(spark, path) == []
    assert versions.publish(spark.range(3), path, "first") == 0
    held = versions.read(spark, path)  # planned before, read after
    assert versions.publish(held.selectExpr("id + 10 AS id"), path) == 1
    assert sorted(r[0] for r in held.collect()) == [0, 1, 2]
    assert sorted(r[0] for r in versions.read(spark, path).collect()) == [10, 11, 12]
    assert sorted(r[0] for r in versions.read(spark, path, 0).collect()) == [0, 1, 2]
    assert [(m["version"], m["parent"], m["note"]) for m in versions.history(spark, path)] == [(0, None, "first"), (1, 0, "")]
    versions.publish(spark.range(1), path)
    versions.prune(spark, path, 1)
    assert len(versions.history(spark, path)) == 3 and versions.read(spark, path).count() == 1
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("data-")]) == 1


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    versions.publish(spark.range(1), path)
    monkeypatch.setattr(versions, "latest", lambda *_: None)  # a writer that has not seen the first version
    with pytest.raises(versions.Conflict):
        versions.publish(spark.range(2), path)
    monkeypatch.undo()
    assert versions.read(spark, path).count() == 1 and len(list((tmp_path / "table").glob("data-*"))) == 1


def test_long_episodes_cost_no_more_than_their_messages(spark):
    """The steps of curation are worked out once an episode, not anew for each of its messages."""
    import time

    def seconds(size):
        m = [message("user", "task"), *[message("assistant", "", "find"), message("tool", "ok")] * (size // 2)]
        rows = [("a", str(k), m, True, True, 0, False, k) for k in range(4800 // size)]
        kind = StructType().add("domain", "string").add("task_id", "string").add("m", ArrayType(M.MESSAGE)).add("passed", "boolean").add("complete", "boolean").add("branch", "integer").add("opd_used", "boolean").add("ord", "long")
        df, begun = spark.createDataFrame(rows, kind), time.time()
        shown = loops.curate([df]).collect()
        assert len(shown) == len(rows) and all(len(r["m"]) == len(m) for r in shown)
        return time.time() - begun

    seconds(30)  # code is compiled
    assert seconds(1200) < 2 * seconds(30) + 3
