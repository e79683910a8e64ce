"""Counts that the writing job itself takes: one job a scan."""

import json

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lodestone.operators import messages as M
from lodestone.plans import loops
from lodestone.sources import jsonl as J


def jobs(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_skipped_lines_are_counted_in_the_scan(spark, tmp_path):
    lines = [{"task_id": "a", "prompt": "p", "small_success": True}, {"task_id": "b", "prompt": ""}, {"task_id": "c", "prompt": "q", "small_success": False}, {"task_id": "d", "prompt": "r"}]
    path = tmp_path / "t.jsonl"
    path.write_text("".join(json.dumps(x) + "\n" for x in lines) + "{broken\n")
    (kept, skipped), n = jobs(spark, "examples", lambda: J.read_examples(spark, str(path)))
    assert n == 1 and skipped == 2 and sorted(r["task_id"] for r in kept.collect()) == ["a", "c"]
    seen = Observation()
    assert J.examples(spark, str(path), seen).count() == 2 and seen.get == {"n": 4, "skipped": 2}


def test_failures_and_traces_are_counted_in_the_write(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x"), ("c", "y")], "task_id string, error string")
    failed, n = jobs(spark, "split", lambda: J.write_split(df, str(tmp_path / "good"), str(tmp_path / "bad")))
    assert failed == 2 and n == 2  # two folders, two writes
    traces = spark.createDataFrame([(True, False), (False, True), (False, False)], "small_success boolean, large_success boolean")
    told, n = jobs(spark, "traces", lambda: J.write_traces(traces, str(tmp_path / "traces")))
    assert told == {"n": 3, "small_ok": 1, "large_ok": 1, "final_ok": 2} and n == 1
    assert J.write_traces(traces.limit(0), str(tmp_path / "none"))["n"] == 0


def test_chunks_are_counted_in_the_write(spark, tmp_path):
    tasks, calls = spark.range(7).select(F.col("id").alias("ord"), F.lit("t").alias("task_id")), []

    def run(part):
        calls.append(1)
        return part

    assert loops.collect_chunks(tasks, str(tmp_path / "c"), 3, run) == 7 and len(calls) == 3
    assert loops.collect_chunks(tasks, str(tmp_path / "c"), 3, run) == 7 and len(calls) == 3


def test_agents_without_messages_are_counted_in_the_scan(spark, tmp_path):
    schema = StructType().add("domain", "string").add("task_id", "string").add("ord", "integer").add("m", ArrayType(M.MESSAGE))
    df = spark.createDataFrame([("a", "1", 0, [("user", "q", None, None, None, None)]), ("a", "2", 1, []), ("a", "3", 2, None)], schema)
    seen = Observation()
    rows = loops.agent_rows(df, spark.createDataFrame([("a", "s", "t")], "domain string, system string, tools string"), spark.createDataFrame([("a", "p")], "domain string, procedure string"), counts=seen)
    assert rows.count() == 1 and seen.get == {"skipped": 2, "n": 3}
