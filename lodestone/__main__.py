"""Command line: ``python -m lodestone --list``, ``BENCHMARK RECIPE DATA [--out FOLDER] [--dry-run]``, ``query NAME DATA``."""

from __future__ import annotations

import argparse
import sys

from .plans import QUERIES
from .plans.loops import RECIPES


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("benchmark", nargs="?")
    parser.add_argument("recipe", nargs="?")
    parser.add_argument("data", nargs="?", default=".")
    parser.add_argument("--out", default="results")
    parser.add_argument("--list", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    if args.list:
        for (benchmark, recipe), what in sorted(RECIPES.items()):
            print(f"{benchmark:<8} {recipe:<12} {what}")
        return 0
    known = (args.benchmark, args.recipe) in RECIPES or args.benchmark == "query" and args.recipe in QUERIES
    if not known:
        print(f"unknown recipe: {args.benchmark} {args.recipe}", file=sys.stderr)
        return 2
    if args.dry_run:
        print(f"would run {args.benchmark} {args.recipe} on {args.data} into {args.out}")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    run(spark, args.benchmark, args.recipe, args.data, args.out)
    return 0


def run(spark, benchmark: str, recipe: str, data: str, out: str) -> None:
    from .plans import loops
    from .plans.views import tasks
    from .sources.jsonl import rows_of

    if benchmark == "query":
        QUERIES[recipe](spark, data).write.mode("overwrite").parquet(f"{out}/{recipe}")
        return
    if benchmark == "agent" and recipe in ("cycle", "4cycle", "skills", "sft", "router"):
        from .plans.loop_queries import agent_tables

        # one mechanism alone is a cycle of which one result is reported
        done = loops.agent_cycles(spark, out, 4 if recipe == "4cycle" else 1, *agent_tables(spark, data))
        wanted = {"skills": "lessons", "sft": "demonstrations"}.get(recipe, "paired")
        for cycle in done:
            rows = cycle[wanted].groupBy("domain").count() if wanted == "demonstrations" else cycle[wanted]
            loops.report(rows_of(rows), out, wanted)
        return
    if recipe in ("skills", "sft", "rl"):
        loops.Cycle(spark, out).run(tasks(spark, data), mechanisms=(recipe,))
        return
    if recipe in ("cycle", "4cycle"):
        book = None
        for n in range(4 if recipe == "4cycle" else 1):
            done = loops.Cycle(spark, out, n).run(tasks(spark, data), book)
            book = done["skill_stats"]
        loops.report(rows_of(done["ablation"]), out, "ablation")
        return
    name = {"baselines": "method_comparison", "ablation": "policy_metrics", "features": "router_features", "paired": "mcnemar"}[recipe]
    loops.report(rows_of(QUERIES[name](spark, data)), out, name)


if __name__ == "__main__":
    sys.exit(main())
