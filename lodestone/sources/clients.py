"""Model calls behind an interface; offline, outcomes are made up from hashes."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.traces import MOCK_BARS

RESULT = "success boolean, error string, completion string, code string, latency double, prompt_tokens int, completion_tokens int"
#: Field -> what an empty result holds.
EMPTY = {name: {"boolean": False, "string": "", "double": 0.0, "int": 0}[kind] for name, kind in (f.split() for f in RESULT.split(", "))}
#: What a repair adds to what was used before.
_USED = ("latency", "prompt_tokens", "completion_tokens")
ERROR_CHARS = 200


class ModelClient(Protocol):
    def __call__(self, task: dict, role: str) -> dict: ...


def result(**known) -> dict:
    """A result with the given fields, the others empty."""
    return EMPTY | known


def mock_client(task: dict, role: str, cycle: int = 0, sample: int = 0) -> dict:
    """The outcome that ``operators.traces.mock_success`` gives for the task."""
    key = "|".join((str(task["task_id"]), role, str(cycle), str(sample)))
    passed = int.from_bytes(hashlib.md5(key.encode()).digest(), "big") % 10 < MOCK_BARS[role]
    return result(success=passed, error="" if passed else "mock failure", completion=f"# {role}\n", prompt_tokens=len(task.get("prompt") or ""), completion_tokens=8)


def with_retries(client: ModelClient, retries: int = 3, pause: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> ModelClient:
    """A client that tries again after growing pauses; what still fails is a failed result."""
    waits = [pause * (k + 1) for k in range(retries - 1)]

    def call(task: dict, role: str) -> dict:
        for wait in [*waits, None]:
            try:
                return client(task, role)
            except Exception as e:  # noqa: BLE001  any failure of a call is a failed row
                failure = result(error=f"{type(e).__name__}: {e}"[:ERROR_CHARS])
            if wait is not None:
                sleep(wait)
        return failure

    return call


def with_repairs(client: ModelClient, turns: int) -> ModelClient:
    """Up to ``turns`` more calls until one succeeds; latency and tokens add up."""

    def call(task: dict, role: str) -> dict:
        done = client({**task, "turn": 0, "last_error": ""}, role)
        for k in range(1, turns + 1):
            if done["success"]:
                break
            more = client({**task, "turn": k, "last_error": done["error"]}, role)
            done = more | {n: done[n] + more[n] for n in _USED}
        return done

    return call


def collect(tasks: DataFrame, client: ModelClient, role: str) -> DataFrame:
    """The tasks with the client's result for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [client(t, role) for t in pdf.to_dict("records")]
            yield pdf.assign(**{n: [g[n] for g in got] for n in EMPTY})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema.fields)
    return tasks.mapInPandas(run, f"{kinds}, {RESULT}")
