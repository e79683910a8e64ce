"""Streams whose state ends: by time, by budget, by errors; and goes on from an earlier run."""

import json

import pytest

from lodestone.streaming import episodes as E

SCHEMA = "instance string, ord long, kind string, official double, recall double, ts string"


def day(n, hour=0):
    return f"2024-01-{n:02d} {hour:02d}:00:00"


class Fed:
    """A stream over a folder that files are added to; ``more`` runs what is there and gives rows and state rows so far."""

    def __init__(self, spark, folder, schema, build):
        self.spark, self.folder, self.files = spark, folder, 0
        self.source, self.out, self.checkpoint = folder / "in", str(folder / "out"), str(folder / "checkpoint")
        self.source.mkdir()
        self.build = lambda: build(spark.readStream.schema(schema).json(str(self.source)))

    def more(self, *rows):
        self.files += 1
        (self.source / f"{self.files}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        q = self.build().writeStream.format("json").option("path", self.out).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress) if p["stateOperators"]]
        return [r.asDict() for r in self.spark.read.json(self.out).collect()], states[-1]


def test_resume_forgets_keys_the_watermark_has_passed(spark, tmp_path):
    fed = Fed(spark, tmp_path, "domain string, task_id string, error string, ts string", lambda df: E.completed_once(df, ["domain", "task_id"], "ts", "1 day"))
    row = lambda task, ts, error=None: {"domain": "d", "task_id": task, "error": error, "ts": ts}
    got, state = fed.more(row("a", day(1), "down"), row("a", day(1)), row("b", day(1)))
    assert sorted(r["task_id"] for r in got) == ["a", "b"] and state == 2
    got, state = fed.more(row("a", day(1, 5)), row("c", day(9)))  # the first is a repetition
    assert sorted(r["task_id"] for r in got) == ["a", "b", "c"] and state == 1
    got, state = fed.more(row("d", day(20)))
    assert state == 1


def test_escalation_lasts_across_batches_until_the_episode_is_silent(spark, tmp_path):
    fed = Fed(spark, tmp_path, "episode long, ord long, prob double, ts string", lambda df: E.escalations(df, 0.5, idle="2 days"))
    row = lambda e, o, p, ts: {"episode": e, "ord": o, "prob": p, "ts": ts}
    _, state = fed.more(row(1, 0, 0.1, day(1)), row(1, 1, 0.7, day(1, 1)), row(2, 0, None, day(1)))
    assert state > 0
    got, _ = fed.more(row(1, 2, 0.0, day(1, 2)), row(2, 1, 0.2, day(1, 2)))
    assert {(r["episode"], r["ord"]): r["escalated"] for r in got} == {(1, 0): False, (1, 1): True, (1, 2): True, (2, 0): False, (2, 1): False}
    _, before = fed.more(row(3, 0, 0.1, day(2)))
    _, after = fed.more(row(4, 0, 0.1, day(25)))
    assert after < before  # 1, 2 and 3 are forgotten
    got, _ = fed.more(row(1, 9, 0.0, day(25, 1)))
    assert [r["escalated"] for r in got if r["ord"] == 9] == [False]


def test_episodes_end_by_every_way(spark, tmp_path):
    fed = Fed(spark, tmp_path, SCHEMA, lambda df: E.episode_registry(df, 0.25, idle="2 days", max_steps=3))
    row = lambda i, o, k, ts, official=None, recall=None: {"instance": i, "ord": o, "kind": k, "official": official, "recall": recall, "ts": ts}
    first = [row("early", 0, "step", day(1)), row("early", 1, "finalize", day(1))]
    first += [row("done", 0, "start", day(1)), row("done", 1, "step", day(1), 1.0, 0.4), row("done", 2, "finalize", day(1)), row("done", 3, "finalize", day(1), 0.0, 0.0)]
    first += [row("wrong", 0, "start", day(1)), row("wrong", 1, "error", day(1), 1.0, 1.0)]
    first += [row("budget", k, "step" if k else "start", day(1), 0.0, k / 4) for k in range(6)]
    first += [row("silent", 0, "start", day(1)), row("silent", 1, "step", day(1), None, 0.5), row("cut", 0, "start", day(1))]
    got, _ = fed.more(*first)
    ends = lambda rows: {r["instance"]: (r["steps"], round(r["score"], 6), r["reason"]) for r in rows}
    assert ends(got) == {"done": (1, 0.25 + 0.75 * 0.4, "finalized"), "wrong": (0, 0.0, "error"), "budget": (3, 0.5625, "max_steps")}
    got, before = fed.more(row("cut", 1, "step", day(2)), row("cut", 2, "terminate", day(2), 1.0), row("done", 4, "start", day(2)), row("done", 5, "finalize", day(2), 0.0, 0.0))
    assert len(got) == 4 and ends(got)["cut"] == (1, 0.25, "terminated")
    got, after = fed.more(row("late", 0, "start", day(20)))
    assert len(got) == 5 and ends(got)["silent"] == (1, 0.375, "idle") and after < before
    got, _ = fed.more(row("other", 0, "step", day(28)))
    assert ends(got)["late"] == (0, 0.0, "idle")


def test_registry_goes_on_from_an_initial_state(spark, tmp_path):
    millis = 1704067200000  # 2024-01-01
    held = spark.createDataFrame([("open", 2, False, 1.0, 0.0, millis), ("over", 5, True, 1.0, 1.0, millis)], "instance string, steps long, over boolean, official double, recall double, millis long")
    fed = Fed(spark, tmp_path, SCHEMA, lambda df: E.episode_registry(df, max_steps=3, initial=held))
    got, _ = fed.more(*[{"instance": i, "ord": 9, "kind": "step", "official": None, "recall": 1.0, "ts": day(1, 1)} for i in ("open", "over", "new")])
    assert [(r["instance"], r["steps"], r["score"], r["reason"]) for r in got] == [("open", 3, 1.0, "max_steps")]


def test_a_span_is_read():
    assert E._millis("2 days") == 172_800_000
    with pytest.raises(ValueError):
        E._millis("soon")
