"""Files in and out, model clients, streams, pipelines, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.plans import loops
from lodestone.sources import clients
from lodestone.sources import jsonl as J
from lodestone.streaming import episodes as E


def write(path, *lines):
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines), encoding="utf-8")
    return str(path)


def test_lenient_and_strict_scans(spark, tmp_path):
    path = write(tmp_path / "t.jsonl", {"task_id": "a", "prompt": "p", "small_success": True}, "", "{broken", {"task_id": "b", "prompt": "p", "small_success": "true"})
    rows = {r["task_id"]: r["small_success"] for r in J.read_lenient(spark, path, J.TRACE).collect()}
    assert rows == {"a": True, "b": None}
    kept, skipped = J.read_examples(spark, path)
    assert kept.count() == 1 and skipped == 1
    with pytest.raises(Exception):
        J.read_strict(spark, path, J.TRACE).collect()


def test_presence_of_keys(spark, tmp_path):
    path = write(tmp_path / "p.jsonl", {"task_id": "a", "split": None}, {"task_id": "b"})
    assert {r["task_id"]: r["has_split"] for r in J.with_presence(spark, path, J.TASK, "split").collect()} == {"a": True, "b": False}


def test_keyed_and_results_and_partition(spark, tmp_path):
    path = write(tmp_path / "c.jsonl", {"cache_key": "k", "result": {"success": False}}, {"cache_key": "k", "result": {"success": True}})
    assert J.read_keyed(spark, path).collect()[0]["result"]["success"] is True
    twice = write(tmp_path / "r.jsonl", {"domain": "d", "task_id": "1", "reward": 1.0}, {"domain": "d", "task_id": "1", "reward": 0.0})
    with pytest.raises(ValueError, match="repeated"):
        J.read_results(spark, twice)
    doc = write(tmp_path / "s.json", {"TRAIN": [{"domain": "a", "task_id": "1"}], "EVAL": []})
    assert [tuple(r) for r in J.read_partition(spark, doc).collect()] == [("TRAIN", "a", "1")]
    ordered = J.read_ordered(spark, [path, path], J.CACHE).select("file_ord").distinct().count()
    assert ordered == 2


def test_failures_go_aside(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x")], "task_id string, error string")
    J.write_split(df, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "bad")).count() == 1 and spark.read.json(str(tmp_path / "good")).count() == 1
    assert "| a |" in J.markdown("t", [{"a": 1.5}]) and "no rows" in J.markdown("t", [])


def test_clients():
    calls = []

    def failing(task, role):
        calls.append(role)
        raise OSError("down")

    got = clients.with_retries(failing, 3, 1.0, lambda s: calls.append(s))({"task_id": "a"}, "large")
    assert not got["success"] and calls == ["large", 1.0, "large", 2.0, "large"]
    turns = iter([False, True])
    fixed = clients.with_repairs(lambda t, r: {"success": next(turns), "error": "", "latency": 1.0, "prompt_tokens": 2, "completion_tokens": 3}, 2)({}, "small")
    assert fixed["success"] and fixed["latency"] == 2.0 and fixed["prompt_tokens"] == 4


def test_cache_is_built_once(spark, tmp_path):
    tasks = spark.createDataFrame([("t1", "p1", 0), ("t2", "p2", 1), ("t1", "p1", 2)], "task_id string, prompt string, ord int")
    path, aside = str(tmp_path / "cache"), str(tmp_path / "failures")

    def down(task, role):
        return clients.result(error="down") if task["task_id"] == "t2" else clients.mock_client({"task_id": "t1"}, "large")

    first, failed = loops.build_cache(tasks, path, lambda t, r: {**down(t, r), "error": "down" if t["task_id"] == "t2" else ""}, aside)
    assert failed == 1 and first.count() == 1 and spark.read.json(aside).count() == 1
    second, failed = loops.build_cache(tasks, path, lambda t, r: {**clients.mock_client(t, r), "error": ""} if t["task_id"] == "t2" else 1 / 0, aside)
    assert failed == 0 and second.count() == 2 and not (tmp_path / "failures").exists()
    assert loops.build_cache(tasks, path, lambda *_: 1 / 0)[0].count() == 2


def test_the_last_appended_line_of_a_key_counts(spark, tmp_path):
    """A later job's line counts, whatever the sizes and names of its files."""
    path = str(tmp_path / "log")
    rows = lambda v, n: spark.createDataFrame([("k" if i == 0 else f"x{v}{i}", v * 50 if i else v) for i in range(n)], "cache_key string, model string")
    J.write_jsonl(rows("old", 1).coalesce(1), path, append=True)
    __import__("time").sleep(0.05)
    J.write_jsonl(rows("new", 400).coalesce(1), path, append=True)
    got = {r["cache_key"]: r["model"] for r in J.read_keyed(spark, path, "cache_key string, model string").collect()}
    assert got["k"] == "new" and len(got) == 400
    lines = J.read_ordered(spark, [path], "cache_key string, model string").orderBy("file_ord", "line_no").select("model").collect()
    assert lines[0]["model"] == "old" and len(lines) == 401


def test_chunks_go_on_and_are_retried(spark, tmp_path):
    tasks = spark.range(25).select(F.col("id").alias("ord"))
    calls = []

    def run(part):
        calls.append(part.count())
        if len(calls) == 2:
            raise OSError("lost")
        return part

    assert loops.collect_chunks(tasks, str(tmp_path / "c"), 10, run) == 25 and calls == [10, 10, 10, 5]
    assert loops.collect_chunks(tasks, str(tmp_path / "c"), 10, run) == 25 and len(calls) == 4


def test_distiller_falls_back_to_previous_lessons(spark):
    from lodestone.operators import skills as S

    obs = spark.createDataFrame([("a", "small", True, "c", "p", "1", 0), ("b", "small", True, "c", "p", "2", 1)], "signature string, model string, success boolean, completion string, prompt string, task_id string, ord int")
    before = spark.createDataFrame([("a", ["old"], ["was"]), ("gone", ["kept"], None)], "signature string, pitfalls array<string>, patterns array<string>")

    def distiller(name, rows, pitfalls, patterns):
        if name == "a":
            raise OSError("down")
        return ["new"], []

    got = {r["signature"]: (r["pitfalls"], r["patterns"]) for r in S.distill(obs, distiller, before).collect()}
    assert got == {"a": (["old"], ["was"]), "b": (["new"], []), "gone": (["kept"], [])}


def test_loops_train_their_router(spark, tmp_path):
    tasks = spark.range(400).select(F.concat(F.lit("t"), "id").alias("task_id"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("dataset"), F.concat(F.lit("p "), F.col("id") % 7).alias("prompt"), F.col("id").alias("ord"))
    done = loops.Cycle(spark, str(tmp_path)).run(tasks)
    assert done["calibration"].where("prob > 0 AND prob < 1").count() == done["calibration"].count() > 0
    assert done["sft_pairs"].where("source = 'self_repair'").count() > 0 and done["gates"].first()["both_labels"]
    probs = done["held_out"].select("prob", "policy_route").distinct().collect()
    assert len(probs) > 1 and all((r["policy_route"] == "large") == (r["prob"] >= done["threshold"].first()["threshold"]) for r in probs)


def test_agent_rows(spark):
    from pyspark.sql.types import StructType

    from lodestone.operators import messages as M

    kind = StructType().add("domain", "string").add("task_id", "string").add("ord", "long").add("m", __import__("pyspark.sql.types", fromlist=["ArrayType"]).ArrayType(M.MESSAGE))
    df = spark.createDataFrame([("a", "1", 0, [("user", "q", None, None, None, None)]), ("a", "2", 1, None)], kind)
    contexts, skills = spark.createDataFrame([("a", "policy", "[t]")], "domain string, system string, tools string"), spark.createDataFrame([], "domain string, procedure string")
    row = loops.agent_rows(df, contexts, skills, seed=3).collect()
    assert len(row) == 1 and [(m["role"], m["content"]) for m in row[0]["prompt"]] == [("system", "policy[t]"), ("user", "q")]
    assert row[0]["extra_info"]["interaction_kwargs"]["expected_initial_user"] == "q" and row[0]["extra_info"]["interaction_kwargs"]["seed"] == 3
    assert tuple(loops.skipped_agents(df).first()) == (1, 2)
    assert loops.call_arguments("u", max_tokens=5) == {"api_base": "u", "api_key": "EMPTY", "temperature": 0.0, "max_tokens": 5}


def test_retry_gets_through_after_an_error(spark, tmp_path):
    log, out, mark = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "mark")
    log.mkdir()
    schema = J.RESULT
    stream = lambda: E.completed_once(spark.readStream.schema(schema).json(str(log)), ["domain", "task_id"])
    write(log / "1.json", {"domain": "d", "task_id": "1", "error": "boom"}, {"domain": "d", "task_id": "2"})
    E.append_log(stream(), out, mark).awaitTermination()
    write(log / "2.json", {"domain": "d", "task_id": "1"}, {"domain": "d", "task_id": "2"})
    E.append_log(stream(), out, mark).awaitTermination()
    assert sorted(r["task_id"] for r in spark.read.json(out).collect()) == ["1", "2"]


def test_gate_refuses_a_broken_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    write(log / "1.json", {"domain": "d", "task_id": "1", "error": "boom"})
    rows = spark.readStream.schema(J.RESULT).json(str(log))
    with pytest.raises(Exception):
        E.gated_write(rows, str(tmp_path / "out"), str(tmp_path / "mark"), ["task_id"]).awaitTermination()


def test_curated_demonstrations(spark):
    from pyspark.sql.types import StructType

    from lodestone.operators import messages as M

    m = [("assistant", "early", None, None, None, None), ("user", "q", None, None, None, None), ("assistant", "a", None, None, None, None)]
    schema = StructType().add("domain", "string").add("task_id", "string").add("passed", "boolean").add("complete", "boolean").add("branch", "integer").add("opd_used", "boolean").add("ord", "integer")
    schema = schema.add("m", __import__("pyspark.sql.types", fromlist=["ArrayType"]).ArrayType(M.MESSAGE))
    now = spark.createDataFrame([("a", "1", True, True, 0, False, 0, m), ("a", "2", False, True, 0, False, 1, m), ("b", "1", True, True, 2, True, 2, m)], schema)
    got = loops.curate([now, now]).collect()
    assert sorted((r["domain"], r["task_id"]) for r in got) == [("a", "1"), ("b", "1")]
    assert [x["content"] for x in got[0]["m"]] == ["q", "a"]


def test_command_line(capsys):
    assert main(["--list"]) == 0 and "4cycle" in capsys.readouterr().out
    assert main(["code", "nothing"]) == 2
    assert main(["code", "cycle", "--dry-run"]) == 0


def test_cycle(spark, tmp_path):
    tasks = spark.range(60).select(F.concat(F.lit("t"), "id").alias("task_id"), F.lit("d").alias("dataset"), F.lit("p").alias("prompt"), F.col("id").alias("ord"))
    one = loops.Cycle(spark, str(tmp_path), 0).run(tasks)
    two = loops.Cycle(spark, str(tmp_path), 1).run(tasks, one["skill_stats"])
    total = lambda d: d["skill_stats"].agg(F.sum("total")).first()[0]
    assert total(two) > total(one) and two["ablation"].count() == 4


def test_artifacts(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    from lodestone.operators import models, runs
    from lodestone.operators import skills as S
    from lodestone.sources import artifacts as A

    stats = spark.createDataFrame([("coding", "small", 1, 2)], "signature string, model string, successes long, total long")
    A.write_book(str(tmp_path), S.book_parts(spark), stats)
    # an edited part shows in the procedure, as books are rendered when they are read
    data = json.loads((tmp_path / "skill_statistics.json").read_text())
    data["skills"][0]["pitfalls"] = ["a pitfall of hand"]
    (tmp_path / "skill_statistics.json").write_text(json.dumps(data))
    assert A.read_book(spark, str(tmp_path))[0].where("procedure LIKE '%- a pitfall of hand%'").count() == 1
    book, again = A.read_book(spark, str(tmp_path))
    assert book.count() == 3 and again.collect() == stats.collect() and A.read_book(spark, str(tmp_path / "none"))[0].count() == 0
    assert (tmp_path / "skill.md").read_text().count("\n\n---\n\n") == 2
    rows = spark.createDataFrame([(Vectors.dense([float(i)]), int(i > 3)) for i in range(8)], ["features", "label"])
    A.save_router(str(tmp_path), models.fit_logistic(rows), {"threshold_default": 0.5})
    model, meta = A.load_router(str(tmp_path))
    assert meta["embedding_model"] == A.DEFAULT_EMBEDDING and models.probability(model, rows).where("prob > 0.5").count() == 4
    assert A.load_router(str(tmp_path / "none")) is None
    with pytest.raises(LookupError):
        A.require_model("m", [])
    A.mark(A.snapshot(str(tmp_path / "run"), {"a": 1}), "elsewhere")
    tasks = spark.createDataFrame([("d", 1, 0), ("d", 1, 1)], "domain string, task_id int, ord int")
    assert runs.lookup(tasks, "d", "1")["ord"] == 0
    with pytest.raises(KeyError):
        runs.lookup(tasks, "d", "2")
    with pytest.raises(Exception, match="without its other"):
        runs.low_rank_pairs(spark.createDataFrame([("x.lora_A.w",)], "key string")).collect()
