"""Chat completions over HTTP: many calls at once in each task, a rate for the whole job, failures as rows.

``completions`` asks for the rows of a table; the data source
``chat_completions`` reads the answers to requests that lie in a folder of JSON
lines, in parts of about equal size.
"""

from __future__ import annotations

import io
import json
import threading
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .clients import ERROR_CHARS, ModelClient, result

ANSWER = "completion string, error string, attempts int, latency double, prompt_tokens int, completion_tokens int"
#: Bytes of requests that one task of the data source takes.
SPLIT_BYTES = 1 << 20


@dataclass(frozen=True)
class Endpoint:
    """Where and how to ask; ``rate``: calls a second of the whole job (None: no bound), ``workers``: calls at once in a task."""

    base: str
    model: str
    key: str = "EMPTY"
    temperature: float = 0.0
    max_tokens: int | None = None
    retries: int = 3
    pause: float = 1.5
    timeout: float = 60.0
    workers: int = 8
    rate: float | None = None
    extra: dict = field(default_factory=dict)


class TokenBucket:
    """At most ``rate`` takes a second, and ``burst`` at once; shared by threads."""

    def __init__(self, rate: float | None, burst: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.held, self.at, self.lock = burst, clock(), threading.Lock()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("lock", "at")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)  # each process keeps its own time
        self.at, self.lock = self.clock(), threading.Lock()

    def take(self) -> None:
        if self.rate is None:
            return
        with self.lock:  # what is taken is owed: the next one waits longer
            now = self.clock()
            self.held = min(self.burst, self.held + (now - self.at) * self.rate) - 1
            self.at = now
            wait = max(0.0, -self.held / self.rate)
        if wait:
            self.sleep(wait)


def ask(endpoint: Endpoint, messages: list[dict]) -> dict:
    """One call: completion and tokens; whatever goes wrong is raised."""
    body = {"model": endpoint.model, "messages": messages, "temperature": endpoint.temperature, **endpoint.extra}
    if endpoint.max_tokens is not None:
        body["max_tokens"] = endpoint.max_tokens
    request = urllib.request.Request(f"{endpoint.base.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {endpoint.key}"})
    with urllib.request.urlopen(request, timeout=endpoint.timeout) as response:
        said = json.load(response)
    used = said.get("usage") or {}
    return {"completion": said["choices"][0]["message"].get("content") or "", "prompt_tokens": int(used.get("prompt_tokens") or 0), "completion_tokens": int(used.get("completion_tokens") or 0)}


def answered(endpoint: Endpoint, messages: list[dict], bucket: TokenBucket, sleep: Callable[[float], None] = time.sleep) -> dict:
    """An ANSWER: up to ``retries`` calls with growing pauses; what still fails has its last error."""
    began, error = time.monotonic(), ""
    for attempt in range(1, endpoint.retries + 1):
        bucket.take()
        try:
            return {"error": "", "attempts": attempt, **ask(endpoint, messages), "latency": time.monotonic() - began}
        except Exception as e:  # noqa: BLE001  any failure of a call is a failed row
            error = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
        if attempt < endpoint.retries:
            sleep(endpoint.pause * attempt)
    return {"completion": "", "error": error, "attempts": endpoint.retries, "latency": time.monotonic() - began, "prompt_tokens": 0, "completion_tokens": 0}


def _all(endpoint: Endpoint, requests: Iterable[list[dict]], share: int) -> Iterator[dict]:
    """The answers in order, ``workers`` calls at a time; a task has its share of the rate."""
    bucket = TokenBucket(endpoint.rate / share if endpoint.rate else None)
    with ThreadPoolExecutor(endpoint.workers) as pool:
        waiting = []
        for messages in requests:
            waiting.append(pool.submit(answered, endpoint, messages, bucket))
            if len(waiting) >= 2 * endpoint.workers:  # no more than these are held
                yield waiting.pop(0).result()
        for w in waiting:
            yield w.result()


def client(endpoint: Endpoint, check: Callable[[dict, str], tuple[bool, str]] = lambda task, completion: (True, "")) -> ModelClient:
    """A model client for cache and traces; ``check`` says of a task and completion whether it passes, and why not."""
    bucket = TokenBucket(endpoint.rate)

    def call(task: dict, role: str) -> dict:
        got = answered(endpoint, task.get("messages") or [{"role": "user", "content": task["prompt"]}], bucket)
        ok, why = check(task, got["completion"]) if not got["error"] else (False, got["error"])
        return result(success=ok, error=why, **{k: got[k] for k in ("completion", "latency", "prompt_tokens", "completion_tokens")})

    return call


def completions(rows: DataFrame, endpoint: Endpoint, tasks: int, messages: str = "messages", counts: Observation | None = None) -> DataFrame:
    """The rows with an ANSWER each; ``messages``: array of role and content.

    They are dealt to ``tasks`` tasks, each with its share of the rate.  With
    ``counts`` the job that writes the result also counts calls, failures and
    retries.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            requests = [[{"role": m["role"], "content": m["content"]} for m in (said if said is not None else [])] for said in pdf[messages]]
            got = list(_all(endpoint, requests, tasks))
            yield pdf.assign(**{name.split()[0]: [g[name.split()[0]] for g in got] for name in ANSWER.split(", ")})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.repartition(tasks).mapInPandas(run, f"{kinds}, {ANSWER}")
    if counts is None:
        return out
    return out.observe(counts, F.count("*").alias("n"), F.count_if(F.col("error") != "").alias("failed"), F.coalesce(F.sum(F.col("attempts") - 1), F.lit(0)).alias("retried"))


@dataclass
class _Part(InputPartition):
    path: str
    start: int
    end: int
    #: How many parts share the rate.
    share: int = 1

    def __hash__(self) -> int:
        return hash((self.path, self.start))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.endpoint, self.size = options["path"], Endpoint(**json.loads(options["endpoint"])), int(options.get("split_bytes", SPLIT_BYTES))

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def partitions(self) -> list[_Part]:
        from pyarrow import fs

        system, folder = self._system()
        files = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.is_file and f.base_name.endswith((".json", ".jsonl")))
        cuts = [(p, at, min(at + self.size, size)) for p, size in files for at in range(0, size, self.size)]
        return [_Part(*cut, len(cuts)) for cut in cuts] or [_Part("", 0, 0)]

    def _lines(self, part: _Part) -> Iterator[dict]:
        """The lines that begin in the part."""
        if not part.path:
            return
        system, _ = self._system()
        with io.BufferedReader(system.open_input_file(part.path)) as f:
            f.seek(max(part.start - 1, 0))
            if part.start:
                f.readline()  # the rest of a line that begins before
            while f.tell() < part.end:
                line = f.readline()
                if line.strip():
                    yield json.loads(line)

    def read(self, part: _Part) -> Iterator[tuple]:
        ids: list = []

        def requests() -> Iterator[list[dict]]:
            for line in self._lines(part):
                ids.append(str(line["id"]))
                yield line["messages"]

        for k, got in enumerate(_all(self.endpoint, requests(), part.share)):
            yield (ids[k], *(got[name.split()[0]] for name in ANSWER.split(", ")))


class ChatCompletions(DataSource):
    """``spark.read.format("chat_completions")``: path (JSON lines of id and messages), endpoint (JSON of an Endpoint), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "chat_completions"

    def schema(self) -> str:
        return f"id string, {ANSWER}"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_completions(spark: SparkSession, path: str, endpoint: Endpoint, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """id and ANSWER for each request in the folder."""
    spark.dataSource.register(ChatCompletions)
    return spark.read.format("chat_completions").option("endpoint", json.dumps(asdict(endpoint))).option("split_bytes", str(split_bytes)).load(path)
