"""Chat completions from a local server that fails in known ways."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lodestone.plans import loops
from lodestone.sources import chat


class Server:
    """Answers in capitals; every tenth request fails once, every hundredth always."""

    def __init__(self):
        self.calls, self.open, self.most, lock = Counter(), 0, 0, threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                said = body["messages"][-1]["content"]
                with lock:
                    outer.calls[said] += 1
                    outer.open += 1
                    outer.most = max(outer.most, outer.open)
                    times = outer.calls[said]
                n = int(said.split()[-1])
                bad = n % 100 == 0 or n % 10 == 0 and times == 1 or self.path != "/v1/chat/completions" or self.headers["Authorization"] != "Bearer k"
                threading.Event().wait(0.002)
                data = json.dumps({"choices": [{"message": {"content": said.upper()}}], "usage": {"prompt_tokens": len(said), "completion_tokens": 2}}).encode()
                with lock:
                    outer.open -= 1
                self.send_response(500 if bad else 200)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        self.http = type("Http", (ThreadingHTTPServer,), {"request_queue_size": 256})(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.endpoint = chat.Endpoint(f"http://127.0.0.1:{self.http.server_port}/v1", "m", key="k", pause=0.001, workers=6)


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def test_a_thousand_tasks(spark, server, tmp_path):
    rows = spark.range(1000).select("id", F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("ask "), "id").alias("content"))).alias("messages"))
    counts = Observation("calls")
    chat.completions(rows, server.endpoint, 4, counts=counts).write.parquet(str(tmp_path / "out"))
    assert counts.get == {"n": 1000, "failed": 10, "retried": 10 * 2 + 90}
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 1000 and got[7]["completion"] == "ASK 7" and got[7]["attempts"] == 1 and got[7]["prompt_tokens"] == 5
    assert got[30]["attempts"] == 2 and got[30]["error"] == "" and got[300]["completion"] == "" and "500" in got[300]["error"]
    assert server.most > 4  # more calls at once than tasks


def test_the_data_source_reads_answers_in_parts(spark, server, tmp_path):
    for k in range(3):
        lines = [json.dumps({"id": n, "messages": [{"role": "user", "content": f"é ask {n}"}]}, ensure_ascii=False) for n in range(k, 200, 3)]
        (tmp_path / f"{k}.jsonl").write_text("\n".join(lines) + ("\n" if k else ""), encoding="utf-8")
    df = chat.read_completions(spark, str(tmp_path), server.endpoint, split_bytes=1000)
    got = df.withColumn("part", F.spark_partition_id()).collect()
    assert sorted(int(r["id"]) for r in got) == list(range(200)) and len({r["part"] for r in got}) > 6
    assert {int(r["id"]) for r in got if r["error"]} == {0, 100} and all(r["completion"] == f"É ASK {r['id']}" for r in got if not r["error"])
    (tmp_path / "none").mkdir()
    assert chat.read_completions(spark, str(tmp_path / "none"), server.endpoint).collect() == []


def test_the_cache_is_filled_over_http(spark, server, tmp_path):
    tasks = spark.createDataFrame([(f"t{k}", f"p {k}", k) for k in (1, 2, 100)], "task_id string, prompt string, ord int")
    cache, failed = loops.build_cache(tasks, str(tmp_path / "cache"), chat.client(server.endpoint, lambda task, said: (said == task["prompt"].upper(), "")), str(tmp_path / "failures"))
    assert failed == 1 and sorted(r["result"]["completion"] for r in cache.collect()) == ["P 1", "P 2"]


def test_the_rate_is_kept():
    now, waits = [0.0], []
    bucket = chat.TokenBucket(10.0, 2.0, lambda: now[0], waits.append)
    for _ in range(5):
        bucket.take()
    assert waits == pytest.approx([0.1, 0.2, 0.3])  # two at once, then one each tenth of a second
    now[0] = 60.0
    bucket.take()
    assert len(waits) == 3
    chat.TokenBucket(None).take()
