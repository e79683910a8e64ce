"""JSON lines in and out: strict, lenient and keyed scans, documents, sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .folders import delete, temporary_path

# Names and types of trace columns.
TRACE = (
    "task_id string, dataset string, prompt string, entry_point string, test string, split string, _src string, small_success boolean, large_success boolean, "
    "small_completion string, large_completion string, small_cost double, large_cost double, small_samples int, small_pass_count int, large_skipped boolean, policy_route string, "
    "small_turns array<struct<turn:int,success:boolean,completion:string,code:string,error:string>>, small_latency double, large_latency double, round int, error string"
)
TASK = "task_id string, prompt string, entry_point string, test string, split string, _src string"
CACHE = "cache_key string, task_id string, model string, temperature double, max_tokens int, repair_turns int, result struct<success:boolean,error:string,completion:string,code:string,latency:double,prompt_tokens:int,completion_tokens:int>"
RESULT = "domain string, task_id string, reward double, passed boolean, error string"


def read_strict(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Blank lines are passed over; a malformed line is an error."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def read_lenient(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Malformed lines are dropped; a field of another type is null, and its row stays."""
    lines = spark.read.text(paths).where(F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def with_presence(spark: SparkSession, paths: str | list[str], schema: str, *names: str) -> DataFrame:
    """The lenient scan with ``has_<name>``: whether the key was in the line at all."""
    lines = spark.read.text(paths).where(F.try_parse_json("value").isNotNull())
    keys = F.json_object_keys("value")
    rows = lines.select(F.from_json("value", schema).alias("r"), *[F.coalesce(F.array_contains(keys, n), F.lit(False)).alias(f"has_{n}") for n in names])
    return rows.select("r.*", *[f"has_{n}" for n in names])


def _placed(spark: SparkSession, paths: str | list[str], schema: str, strict: bool) -> DataFrame:
    """The rows with ``line_no``: by age of the job that wrote a file, the file's name, and the place in it.

    Spark packs files into tasks by size, so a task's own order says nothing of
    theirs.  The files of one job bear its id; a job is as old as its first file.
    """
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_at"))
    job = F.regexp_extract("_file", r"part-\d+-([0-9a-f-]{36})", 1)
    job = F.when(job != "", job).otherwise(F.col("_file"))
    files = files.withColumn("_job", job).withColumn("_began", F.min("_at").over(Window.partitionBy("_job")))
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("_row"))
    lines = lines.where(F.trim("value") != "") if strict else lines.where(F.try_parse_json("value").isNotNull())
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r"), "_file", "_row").join(files, "_file")
    return parsed.select("r.*", F.struct(F.col("_began").alias("began"), F.col("_job").alias("job"), F.col("_file").alias("file"), "_row.block", "_row.row").alias("line_no"))


def read_ordered(spark: SparkSession, paths: list[str], schema: str, strict: bool = True) -> DataFrame:
    """Files (or folders of them) in the given order: ``file_ord``, and ``line_no``, which ascends with the lines of each."""
    out = None
    for i, path in enumerate(paths):
        rows = _placed(spark, path, schema, strict).withColumn("file_ord", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no files")
    return out


def read_keyed(spark: SparkSession, path: str, schema: str = CACHE, key: str = "cache_key") -> DataFrame:
    """The last line of each key; of a folder that was appended to, the last job's."""
    rows = _placed(spark, path, schema, True)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "line_no")]), "line_no").alias("v")).select(key, "v.*")


def written(df: DataFrame, write: Callable[[DataFrame], None], **counts: Column) -> dict:
    """Writes the rows, and gives aggregates of them that the writing job itself has taken."""
    seen = Observation()
    write(df.observe(seen, *[c.alias(n) for n, c in counts.items()]))
    return seen.get


def _usable() -> Column:
    return (F.coalesce("prompt", F.lit("")) != "") & F.col("small_success").isNotNull()


def examples(spark: SparkSession, path: str, counts: Observation | None = None) -> DataFrame:
    """Traces with a prompt and both outcomes; the first job over them fills ``counts`` with n and skipped."""
    rows = read_lenient(spark, path, TRACE)
    if counts is not None:
        rows = rows.observe(counts, F.count("*").alias("n"), F.count_if(~_usable()).alias("skipped"))
    return rows.where(_usable())


def read_examples(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The same, written and read again, and how many lines were skipped: one scan, in one job."""
    held, seen = temporary_path(spark, "examples"), Observation()
    kept = examples(spark, path, seen)
    kept.write.parquet(held)
    return spark.read.schema(kept.schema).parquet(held), int(seen.get["skipped"])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """domain, task_id, reward; a repeated key is an error."""
    rows = read_strict(spark, path, RESULT).select(F.coalesce("domain", F.lit("")).alias("domain"), "task_id", "reward")
    twice = rows.groupBy("domain", "task_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated result: {twice[0]['domain']}/{twice[0]['task_id']}")
    return rows


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """bucket, domain, task_id of a partition document {bucket: [{domain, task_id}]}."""
    text = spark.read.text(path, wholetext=True)
    buckets = text.select(F.explode(F.from_json("value", "map<string, array<struct<domain:string,task_id:string>>>")).alias("bucket", "rows"))
    return buckets.select("bucket", F.explode("rows").alias("r")).select("bucket", "r.*")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_split(df: DataFrame, path: str, failures: str, append: bool = False) -> int:
    """Good rows and, at ``failures``, those with an error: how many; without any, the folder goes."""
    bad = F.coalesce("error", F.lit("")) != ""
    write_jsonl(df.where(~bad), path, append)
    failed = written(df.where(bad), lambda rows: write_jsonl(rows, failures), n=F.count("*"))["n"]
    if not failed:
        delete(df.sparkSession, failures)
    return failed


def write_traces(traces: DataFrame, path: str) -> dict:
    """Traces as JSON lines, and the summary of the run: rows, and how many small, large and both together solved."""
    solved = F.col("small_success") | F.col("large_success")
    return written(traces, lambda rows: write_jsonl(rows, path), n=F.count("*"), small_ok=F.count_if("small_success"), large_ok=F.count_if("large_success"), final_ok=F.count_if(solved))


def write_report(path: str, report: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False, default=str)
        f.write("\n")


def rows_of(df: DataFrame) -> list[dict]:
    """A small aggregate as dictionaries, for reports."""
    return [r.asDict(recursive=True) for r in df.collect()]


def markdown(title: str, rows: Iterable[dict], digits: int = 4) -> str:
    """Rows as a Markdown table under a title."""
    rows = list(rows)
    if not rows:
        return f"# {title}\n\n(no rows)\n"
    names = list(rows[0])
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    body = ["| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows]
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *body, ""])
