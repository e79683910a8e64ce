"""Shared plumbing: reading tables, the shared scratch folder, small helpers."""

from __future__ import annotations

import atexit
import shutil
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import row_index
from ..sources.folders import delete, scratch_path

#: Words, as every operator of this subpackage cuts them (Java and Python regex).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *stems: str) -> list[str]:
    """Names made from the stems that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in stems:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of an Arrow batch, at most: with whole texts in them, batches of 10,000 rows take too much of a worker's memory.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS, if it is higher."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    ``save`` writes a DataFrame and gives it back as read from there; ``drop``
    deletes tables that no later plan reads. What is left goes at exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = scratch_path(spark, name)
        _open.append(self)
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        if path.startswith("file:"):  # works after the session's end, too
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
            return
        delete(self.spark, path)


#: What has been opened and not closed yet.
_open: list[Scratch] = []


@contextmanager
def scratch_closed(*kept: Scratch) -> Iterator[None]:
    """Deletes what is opened inside when it ends: for results that have been written by then."""
    before = len(_open)
    yield
    for scratch in [x for x in _open[before:] if x not in kept]:
        scratch.close()
        _open.remove(scratch)


def under_keys(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id and text with a key in doc_id's place for each different text of an id, and the keys: key, doc_id, text_hash.

    Keys ascend by doc_id and then by the text's hash, whatever the
    partitioning; rows with null id keep it, and have no key.  Both tables are
    written.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    pairs = hashed.where(F.col("doc_id").isNotNull()).select("doc_id", "text_hash").distinct()
    order = [F.col("doc_id").asc(), F.col("text_hash").asc()]
    keys = scratch.save(row_index(pairs, order, "key", keys=["doc_id", "text_hash"]).select("key", "doc_id", "text_hash"), "keys")
    keyed = hashed.join(keys, ["doc_id", "text_hash"], "left").select(F.col("key").alias("doc_id"), "text")
    return scratch.save(keyed, "keyed-docs"), keys


def dense_bytes(cells: DataFrame, count: int):
    """cell (int), value (0 to 255) -> a NumPy array of ``count`` bytes; cells not named are 0.

    Executors fill blocks of bytes, so that what reaches the driver is at most
    ``count`` bytes in a few rows, however many cells there are.
    """
    import numpy as np
    import pyarrow as pa

    bits = 13

    def run(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, value = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            order = np.argsort(cell, kind="stable")
            cell, value = cell[order].astype(np.int64), value[order].astype(np.uint8)
            edges = np.flatnonzero(np.diff(cell >> bits)) + 1
            for c, v in zip(np.split(cell, edges), np.split(value, edges)):
                if len(c):
                    blocks.setdefault(int(c[0] >> bits), np.zeros(1 << bits, np.uint8))[c & ((1 << bits) - 1)] = v
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], names=["block", "data"])

    blocks = cells.select("cell", "value").repartition(F.shiftright("cell", bits)).mapInArrow(run, "block int, data binary")
    out = np.zeros(max(count, 1 << bits), np.uint8)
    for r in blocks.collect():
        out[r["block"] << bits : (r["block"] + 1) << bits] = np.frombuffer(r["data"], np.uint8)
    return out[:count]
