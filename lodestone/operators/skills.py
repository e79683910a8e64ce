"""Skill books: observations folded by signature, rendering, lessons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import py_strip, signature

MAX_EXEMPLARS = 10_000
MAX_CHARS = 4_000

# When to use each skill, and its procedure.
SECTIONS: dict[str, tuple[str, list[str]]] = {
    "humaneval": (
        "Task is a HumanEval-style problem: a complete function signature and docstring, often with worked examples written as doctests.",
        [
            "Read the docstring's examples carefully -- they define the exact expected behavior, including edge cases.",
            "Keep the given function name and signature exactly as written.",
            "Handle boundary cases explicitly: empty input, negative numbers, single-element input, boundary values.",
            "Return one self-contained function; do not add extra top-level code, explanations, or tests.",
            "Prefer a direct, correct implementation over a clever one-liner.",
        ],
    ),
    "mbpp": (
        "Task is an MBPP-style problem: the goal is a plain-English sentence, and the exact function name/signature is only implied by the assert statements that follow the prompt.",
        [
            "Infer the exact function name and argument order from the assert statements before writing any code.",
            "Solutions are typically short, direct algorithms (loops, basic string/list operations); avoid over-engineering or unnecessary abstractions.",
        ],
    ),
    "coding": ("", ["Return only complete Python code. Prefer compact, direct solutions."]),
}


def observations(traces: DataFrame, order: str = "ord") -> DataFrame:
    """signature, model, success, completion, prompt, task_id of each model that ran on a trace."""
    get = lambda c: F.col(c) if c in traces.columns else F.lit(None).cast("string")
    one = lambda model, ok, text: F.struct(F.lit(model).alias("model"), F.coalesce(ok, F.lit(False)).alias("success"), text.alias("completion"))
    small = one("small", F.col("small_success"), get("small_completion"))
    large = one("large", F.col("large_success"), get("large_completion"))
    skipped = F.coalesce(F.col("large_skipped"), F.lit(False)) if "large_skipped" in traces.columns else F.lit(False)
    both = F.when(skipped, F.array(small)).otherwise(F.array(small, large))
    return traces.select(signature(F.col("dataset")).alias("signature"), "task_id", "prompt", F.col(order).alias("ord"), F.explode(both).alias("o")).select("signature", "task_id", "prompt", "ord", "o.*")


def stats(obs: DataFrame) -> DataFrame:
    return obs.groupBy("signature", "model").agg(F.count_if("success").alias("successes"), F.count("*").alias("total"))


def merge_stats(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of an earlier book and of new observations, added."""
    both = previous.unionByName(new)
    return both.groupBy("signature", "model").agg(F.sum("successes").alias("successes"), F.sum("total").alias("total"))


def exemplars(obs: DataFrame, most: int | None = MAX_EXEMPLARS) -> DataFrame:
    """The most recent successes with prompt and completion, by signature; None: all of them."""
    w = Window.partitionBy("signature").orderBy(F.col("ord").desc(), F.col("model"))
    keep = F.col("success") & (F.coalesce("completion", F.lit("")) != "") & (F.coalesce("prompt", F.lit("")) != "")
    if most is None:
        return obs.where(keep)
    return obs.where(keep).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def shortest(rows: DataFrame, k: int) -> DataFrame:
    """The k shortest completions of each signature, cut for display; equals keep their order."""
    w = Window.partitionBy("signature").orderBy(F.length("completion"), "ord", "model")
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return rows.select("signature", "rank", "task_id", F.substring(py_strip(F.col("prompt")), 1, 500).alias("prompt"), F.substring(py_strip(F.col("completion")), 1, 700).alias("completion"))


def can_downgrade(successes: Column, total: Column, min_rate: float = 0.8, min_samples: int = 1) -> Column:
    """Whether small serves well enough; null without enough samples."""
    return F.when(total >= min_samples, F.try_divide(successes.cast("double"), total) >= min_rate)


def summary(skill_stats: DataFrame) -> DataFrame:
    return skill_stats.agg(F.count_distinct("signature").alias("n_skills"), F.sum("total").alias("n_observations"), F.array_join(F.sort_array(F.collect_set("signature")), ",").alias("signatures"))


def _section(title: str, lines: Column, numbered: bool = False) -> Column:
    text = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x) if numbered else F.concat(F.lit("- "), x)), "\n")
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.concat(F.lit(f"## {title}\n"), text))


def render(name: Column, when_to_use: Column, procedure: Column, pitfalls: Column, patterns: Column, max_chars: int = MAX_CHARS) -> Column:
    """Sections of a skill up to a budget of characters: the first that does not fit ends the text."""
    parts = F.array_compact(F.array(
        F.concat(F.lit("# Skill: "), name), F.when(F.coalesce(when_to_use, F.lit("")) != "", F.concat(F.lit("## When to use\n"), when_to_use)),
        _section("Procedure", procedure, True), _section("Common pitfalls", pitfalls), _section("Recurring patterns", patterns),
    ))
    step = lambda acc, p: F.when(acc["open"] & (F.length(acc["text"]) + F.when(acc["text"] == "", 0).otherwise(2) + F.length(p) <= max_chars), F.struct(F.when(acc["text"] == "", p).otherwise(F.concat(acc["text"], F.lit("\n\n"), p)).alias("text"), F.lit(True).alias("open"))).otherwise(F.struct(acc["text"].alias("text"), F.lit(False).alias("open")))
    return F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit(True).alias("open")), step, lambda a: a["text"])


def book_parts(spark, lessons: DataFrame | None = None) -> DataFrame:
    """signature, when_to_use, steps, pitfalls, patterns: the fixed sections, with distilled lessons where there are any."""
    rows = spark.createDataFrame([(k, w, p) for k, (w, p) in SECTIONS.items()], "signature string, when_to_use string, steps array<string>")
    none = F.array().cast("array<string>")
    if lessons is not None:
        rows = rows.join(lessons, "signature", "left")
    else:
        rows = rows.withColumn("pitfalls", none).withColumn("patterns", none)
    return rows.select("signature", "when_to_use", "steps", F.coalesce("pitfalls", none).alias("pitfalls"), F.coalesce("patterns", none).alias("patterns"))


def rendered(parts: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """signature, procedure text."""
    return parts.select("signature", render(F.col("signature"), F.col("when_to_use"), F.col("steps"), F.col("pitfalls"), F.col("patterns"), max_chars).alias("procedure"))


def book(spark, lessons: DataFrame | None = None) -> DataFrame:
    return rendered(book_parts(spark, lessons))


def with_skill(rows: DataFrame, skills: DataFrame) -> DataFrame:
    """Each row's procedure by its dataset's signature; none: empty.  A book has a row a signature."""
    keyed = rows.withColumn("signature", signature(F.col("dataset")))
    return keyed.join(skills, "signature", "left").withColumn("procedure", F.coalesce("procedure", F.lit("")))


def render_examples(examples: Column) -> Column:
    one = lambda e, i: F.concat(F.lit("### Example "), (i + 1).cast("string"), F.lit("\nProblem:\n```python\n"), e["prompt"], F.lit("\n```\nSolution:\n```python\n"), e["completion"], F.lit("\n```"))
    return F.when(F.size(examples) > 0, F.concat(F.lit("## Worked examples\n\n"), F.array_join(F.transform(examples, one), "\n\n"))).otherwise("")


def lessons(texts: DataFrame, key: str, style: str = "code", cap: int = 400, most: int | None = 4) -> DataFrame:
    """key, text -> key, pitfalls, patterns: bullets below each heading, in order.

    style "code": headings start with PITFALLS or PATTERNS, bullets with - or *,
    at most ``most`` each; "dialogue": headings are "## Common pitfalls" and
    "## Recurring patterns", bullets start with "- ", all are kept.
    """
    lines = texts.select(key, F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line")).withColumn("line", py_strip(F.col("line")))
    heads = ("PITFALLS", "PATTERNS") if style == "code" else ("## COMMON PITFALLS", "## RECURRING PATTERNS")
    head = F.when(F.upper("line").startswith(heads[0]), "pitfalls").when(F.upper("line").startswith(heads[1]), "patterns")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_head", head).withColumn("_in", F.last("_head", True).over(w))
    if style == "code":
        bullet, item = F.col("line").rlike(r"^[-*]"), py_strip(F.regexp_replace("line", r"^[-*]+", ""))
    else:
        bullet, item = F.col("line").startswith("- "), py_strip(F.substring("line", 3, 1 << 30))
    found = lines.where(F.col("_head").isNull() & F.col("_in").isNotNull() & bullet).select(key, "_in", "pos", F.substring(item, 1, cap).alias("item"))
    found = found.where(F.col("item") != "") if style == "code" else found
    take = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("_in") == name, F.struct("pos", "item")))), lambda x: x["item"])
    cut = (lambda c: F.slice(c, 1, most)) if style == "code" and most else (lambda c: c)
    out = found.groupBy(key).agg(cut(take("pitfalls")).alias("pitfalls"), cut(take("patterns")).alias("patterns"))
    none = F.array().cast("array<string>")
    return texts.select(key).join(out, key, "left").select(key, *[F.coalesce(c, none).alias(c) for c in ("pitfalls", "patterns")])


def distill(rows: DataFrame, distiller: Callable[[str, list[dict], list[str], list[str]], tuple[list[str], list[str]]], previous: DataFrame | None = None, most: int = 64) -> DataFrame:
    """signature, pitfalls, patterns from each signature's latest ``most`` exemplars, by a pluggable distiller.

    The distiller also gets the previous lessons.  Where it fails or says
    nothing they stay, and so they do for signatures without new exemplars.
    """
    few = exemplars(rows, most).select("signature", "task_id", "prompt", "completion", "ord")
    none = F.array().cast("array<string>")
    before = rows.sparkSession.createDataFrame([], "signature string, pitfalls array<string>, patterns array<string>") if previous is None else previous
    before = before.select("signature", F.coalesce("pitfalls", none).alias("pitfalls"), F.coalesce("patterns", none).alias("patterns"))
    few = few.join(before, "signature", "left")

    def run(key, pdf):
        import pandas as pd

        held = [[] if pdf[c].iloc[0] is None else list(pdf[c].iloc[0]) for c in ("pitfalls", "patterns")]
        try:
            new = distiller(key[0], pdf.drop(columns=["signature", "pitfalls", "patterns"]).sort_values("ord").to_dict("records"), *held)
            pitfalls, patterns = (list(x or []) for x in new)
        except Exception:  # noqa: BLE001  a failing distiller must not end the job
            pitfalls, patterns = [], []
        if not pitfalls and not patterns:
            pitfalls, patterns = held
        return pd.DataFrame([{"signature": key[0], "pitfalls": pitfalls, "patterns": patterns}])

    said = few.groupBy("signature").applyInPandas(run, "signature string, pitfalls array<string>, patterns array<string>")
    return said.unionByName(before.join(few.select("signature").distinct(), "signature", "left_anti"))


def router_text(prompt: Column, response: Column | None = None) -> Column:
    """What a text router reads: the prompt, and below it the small model's answer if that is to count."""
    text = F.coalesce(prompt, F.lit(""))
    return text if response is None else F.concat(text, F.lit("\n<SMALL_RESPONSE>\n"), F.coalesce(response, F.lit("")))


def parse_tool_call(text: Column) -> Column:
    """name and arguments (JSON text) of the first tagged call; nulls if there is none that parses."""
    body = F.nullif(F.regexp_extract(text, r"(?s)<tool_call>\s*(.*?)\s*</tool_call>", 1), F.lit(""))
    ok = F.when(F.try_parse_json(body).isNotNull(), body)
    return F.struct(F.get_json_object(ok, "$.name").alias("name"), F.get_json_object(ok, "$.arguments").alias("arguments"))


def transcript(messages: Column, most: int = 20_000) -> Column:
    """``role: content`` and ``role [tool_call f]: args`` lines of an episode."""
    from .messages import call_name

    calls = lambda m: F.transform(F.coalesce(m["tool_calls"], F.array().cast(_calls())), lambda c: F.concat(m["role"], F.lit(" [tool_call "), call_name(c), F.lit("]: "), F.coalesce(c["arguments"], c["function"]["arguments"], F.lit(""))))
    said = lambda m: F.when(F.coalesce(m["content"], F.lit("")) != "", F.array(F.concat(m["role"], F.lit(": "), m["content"]))).otherwise(F.array().cast("array<string>"))
    return F.substring(F.array_join(F.flatten(F.transform(messages, lambda m: F.concat(calls(m), said(m)))), "\n"), 1, most)


def _calls():
    from pyspark.sql import types as T

    from .messages import CALL

    return T.ArrayType(CALL)
