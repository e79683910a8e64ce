"""Artifacts of a run on disk: skill books, routers, snapshots, markers."""

from __future__ import annotations

import json
import os

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession

from ..operators.skills import rendered
from .jsonl import rows_of, write_report

DEFAULT_EMBEDDING = "hashed-words"


_PARTS = "signature string, when_to_use string, steps array<string>, pitfalls array<string>, patterns array<string>"


def write_book(folder: str, parts: DataFrame, stats: DataFrame) -> None:
    """skill.md (procedures in order of signature) and skill_statistics.json (parts, procedures, counts); one row a signature."""
    os.makedirs(folder, exist_ok=True)
    rows = sorted(rows_of(parts.join(rendered(parts), "signature")), key=lambda r: r["signature"])
    with open(os.path.join(folder, "skill.md"), "w", encoding="utf-8") as f:
        f.write("\n\n---\n\n".join(r["procedure"] for r in rows))
    write_report(os.path.join(folder, "skill_statistics.json"), {"skills": rows, "stats": rows_of(stats)})


def read_book(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The book, its procedures rendered anew from their parts, and its statistics; empty ones where there is no file."""
    skills, stats = [], []
    path = os.path.join(folder, "skill_statistics.json")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        skills = [tuple(r[c] for c in ("signature", "when_to_use", "steps", "pitfalls", "patterns")) for r in data["skills"]]
        stats = [(r["signature"], r["model"], r["successes"], r["total"]) for r in data["stats"]]
    return rendered(spark.createDataFrame(skills, _PARTS)), spark.createDataFrame(stats, "signature string, model string, successes long, total long")


def save_router(folder: str, model: LogisticRegressionModel, meta: dict) -> None:
    model.write().overwrite().save(os.path.join(folder, "router"))
    write_report(os.path.join(folder, "router_meta.json"), meta)


def load_router(folder: str) -> tuple[LogisticRegressionModel, dict] | None:
    """The router and what is known of it; None where there is none."""
    if not os.path.isdir(os.path.join(folder, "router")):
        return None
    meta: dict = {}
    try:
        with open(os.path.join(folder, "router_meta.json"), encoding="utf-8") as f:
            meta = json.load(f)
    except (OSError, json.JSONDecodeError):
        pass  # an unreadable note leaves the defaults
    return LogisticRegressionModel.load(os.path.join(folder, "router")), {"embedding_model": DEFAULT_EMBEDDING, **meta}


def snapshot(folder: str, config: dict) -> str:
    """The run's configuration, kept beside its results."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "config.json")
    write_report(path, config)
    return path


def mark(path: str, origin: str) -> None:
    """Where a reused file came from."""
    with open(f"{path}.reused_from", "w", encoding="utf-8") as f:
        f.write(origin + "\n")


def require_model(name: str, registered: list[str]) -> None:
    """An error unless an endpoint serves the model."""
    if name not in registered:
        raise LookupError(f"{name} is not served; there are {', '.join(sorted(registered)) or 'none'}")
