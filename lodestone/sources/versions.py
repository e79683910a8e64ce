"""Tables in versions: each written whole under its own name, then entered in a chain of manifests.

A version exists once its manifest does; a manifest is created under a name that
may exist only once, so of two writers one is told to try again.  Readers of a
version see the same files whatever is written beside it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .folders import delete


class Conflict(RuntimeError):
    """Another writer took the next version."""


def _system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _manifest(path: str, version: int) -> str:
    return f"{path}/_versions/{version:010d}.json"


def history(spark: SparkSession, path: str) -> list[dict]:
    """The manifests, oldest first: version, parent, data (folder), note."""
    system, folder = _system(spark, f"{path}/_versions")
    if not system.exists(folder):
        return []
    files = sorted(s.getPath().toString() for s in system.listStatus(folder) if s.getPath().getName().endswith(".json"))
    if not files:
        return []
    lines = spark.read.text(files, wholetext=True).collect()  # a row a version
    return sorted((json.loads(r["value"]) for r in lines), key=lambda m: m["version"])


def latest(spark: SparkSession, path: str) -> int | None:
    """The number of the newest version; None where there is none."""
    system, folder = _system(spark, f"{path}/_versions")
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=None)


def publish(rows: DataFrame, path: str, note: str = "") -> int:
    """Writes the rows as the next version and gives its number.

    The rows may be read from an earlier version.  Where another writer was
    faster the written folder goes and Conflict is raised.
    """
    spark = rows.sparkSession
    parent = latest(spark, path)
    version, data = (0 if parent is None else parent + 1), f"data-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(f"{path}/{data}")
    whole = json.dumps({"version": version, "parent": parent, "data": data, "note": note})
    # the whole manifest under a temporary name, then one rename, which fails where the name is taken
    system, held = _system(spark, f"{path}/_versions/.{data}")
    out = system.create(held, False)
    out.write(bytearray(whole.encode()))
    out.close()
    _, target = _system(spark, _manifest(path, version))
    taken = system.exists(target) or not system.rename(held, target)
    if taken:
        system.delete(held, False)
        delete(spark, f"{path}/{data}")
        raise Conflict(f"version {version} of {path} exists")
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version, by default the newest; a missing one is an error."""
    number = latest(spark, path) if version is None else version
    found = [m for m in history(spark, path) if m["version"] == number]
    if not found:
        raise FileNotFoundError(f"no version {number} of {path}")
    return spark.read.parquet(f"{path}/{found[0]['data']}")


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes the data of all but the newest versions; the chain of manifests stays."""
    for m in history(spark, path)[: -keep or None]:
        delete(spark, f"{path}/{m['data']}")
