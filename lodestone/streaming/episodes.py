"""Trace logs and episodes as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.folders import exists, temporary_path


def log_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """Rows appended to a folder of JSON lines."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def completed_once(rows: DataFrame, keys: list[str], time: str | None = None, late: str = "7 days") -> DataFrame:
    """The first row without error of each key; errors leave no trace in the state, so a retry gets through.

    With a time column a key is remembered until the watermark (``late`` behind
    the latest row) has passed it, else for ever.
    """
    done = rows.where(F.coalesce("error", F.lit("")) == "")
    if time is None:
        return done.dropDuplicates(keys)
    return done.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append_log(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended to a folder; run again it goes on where it ended."""
    return rows.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _millis(span: str) -> int:
    """A span such as '7 days', in milliseconds."""
    return int(pd.Timedelta(span).total_seconds() * 1000)


def _ending(rows: DataFrame, time: str, late: str) -> DataFrame:
    """The rows with a watermark; state with timers needs the RocksDB store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


class _Ending(StatefulProcessor):
    """State that a timer removes some time after an episode's last row."""

    schema: str

    def __init__(self, idle: str):
        self.idle = _millis(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def wait(self, last_millis: int) -> None:
        """The timer is set anew; rows that come late do not bring it forward."""
        due = last_millis + self.idle
        for old in list(self.handle.listTimers()):
            due = max(due, old)
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Escalation(_Ending):
    schema = "on boolean"

    def __init__(self, threshold: float, idle: str):
        super().__init__(idle)
        self.threshold = threshold

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        on, last = self.state.exists() and bool(self.state.get()[0]), 0
        for r in sorted(rows, key=lambda r: r.ord):
            on = on or (r.prob is not None and r.prob >= self.threshold)
            last = max(last, r.millis)
            yield Row(episode=key[0], ord=r.ord, prob=r.prob, escalated=on)
        self.state.update((on,))
        self.wait(last)


def escalations(turns: DataFrame, threshold: float, time: str = "ts", late: str = "1 hour", idle: str = "7 days") -> DataFrame:
    """Per turn whether the teacher serves: from the first turn at the threshold on, across batches.

    turns: episode, ord, prob and a time.  The state of an episode is one flag,
    which goes when the watermark (``late`` behind the latest turn) is ``idle``
    past its last turn; a turn after that begins the episode anew.
    """
    rows = _ending(turns, time, late).select("episode", "ord", "prob", time, F.unix_millis(time).alias("millis"))
    return rows.groupBy("episode").transformWithState(_Escalation(threshold, idle), "episode long, ord long, prob double, escalated boolean", "append", "eventtime")


class _Registry(_Ending):
    schema = "steps long, over boolean, official double, recall double"

    def __init__(self, weight: float, idle: str, max_steps: int | None):
        super().__init__(idle)
        self.weight, self.max_steps = weight, max_steps

    def score(self, official: float, recall: float) -> float:
        return self.weight * official + (1.0 - self.weight) * recall

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        r = initialState
        self.state.update((r.steps, r.over, r.official or 0.0, r.recall or 0.0))
        self.wait(r.millis)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        steps, over, official, recall = self.state.get() if self.state.exists() else (-1, False, 0.0, 0.0)  # -1: not started
        last, known = 0, self.state.exists()
        for r in sorted(rows, key=lambda r: r.ord):
            last = max(last, r.millis)
            if over or steps < 0 and r.kind != "start":
                continue
            known = True
            if r.kind == "start":
                steps = max(steps, 0)
                continue
            steps += r.kind == "step"
            official, recall = (now if now is not None else before for now, before in ((r.official, official), (r.recall, recall)))
            end = {"finalize": "finalized", "terminate": "terminated", "error": "error"}.get(r.kind)
            if end is None and self.max_steps is not None and steps >= self.max_steps:
                end = "max_steps"
            if end:
                over = True
                yield Row(instance=key[0], steps=steps, score=0.0 if end == "error" else self.score(official, recall), reason=end)
        if known:
            self.state.update((steps, over, official, recall))
            self.wait(last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        steps, over, official, recall = self.state.get()
        self.state.clear()
        if not over:
            yield Row(instance=key[0], steps=steps, score=self.score(official, recall), reason="idle")


def episode_registry(events: DataFrame, weight: float = 0.5, time: str = "ts", late: str = "1 hour", idle: str = "7 days", max_steps: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """instance, steps, score, reason: one row an episode, when it ends for the first time.

    events: instance, ord, kind (start, step, finalize, terminate, error), the
    rewards official and recall as they stand (null: as before, 0 at first) and
    a time.  Rows before the start, starting again and all after the end change
    nothing.  An episode ends when it is finalized, terminated, has taken
    ``max_steps`` steps or has had no row for ``idle``: it is scored by what it
    reached.  An error ends it with 0.  ``initial`` (instance, steps, over,
    official, recall, millis of the last row) goes on with episodes of an earlier
    run.  The state of an episode goes ``idle`` after its last row.
    """
    rows = _ending(events, time, late).select("instance", "ord", "kind", "official", "recall", time, F.unix_millis(time).alias("millis"))
    begun = initial.groupBy("instance") if initial is not None else None
    return rows.groupBy("instance").transformWithState(_Registry(weight, idle, max_steps), "instance string, steps long, score double, reason string", "append", "eventtime", begun)


def running_stats(observations: DataFrame) -> DataFrame:
    """successes and total by signature and model, updated as observations come."""
    return observations.groupBy("signature", "model").agg(F.count_if("success").alias("successes"), F.count("*").alias("total"))


def windowed_outcomes(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event time and kind, with a bound on lateness."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def gated_write(rows: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Each micro-batch is written only if its keys are distinct and free of errors; replays overwrite themselves."""

    def write(batch: DataFrame, number: int) -> None:
        bad = batch.agg((F.count("*") != F.count_distinct(*keys)).alias("twice"), F.max((F.coalesce("error", F.lit("")) != "").cast("int")).alias("failed")).first()
        if bad["twice"] or bad["failed"]:
            raise ValueError(f"batch {number} is not complete")
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder.

    Each micro-batch has a folder of its own, so a replayed one overwrites
    itself; in complete mode the last one is the result.  Nothing goes through
    the driver.
    """
    spark, root = rows.sparkSession, temporary_path(rows.sparkSession, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={number}")

    rows.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not exists(spark, f"{root}/out"):
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(f"{root}/out").select(*rows.columns)
