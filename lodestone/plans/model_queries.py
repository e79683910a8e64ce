"""Routers and other operators without an SQL form: rows only."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions
from ..operators import messages as M
from ..operators import models, verify
from ..operators import traces as T
from .message_queries import episodes
from .registry import query, rounded
from .views import TRACES, table, tasks, traces


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") < 4).cast("int").alias("label"))


@query()
def lr_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    out = models.probability(models.fit_logistic(rows), rows)
    return rounded(out.select("vec_id", "label", "prob"), 6)


@query()
def router_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("task", F.col("vec_id") % 50)
    return rounded(models.metrics(models.grouped_cv(rows, "task")), 6)


@query(f"""WITH {TRACES}, r AS (SELECT round(router_prob, 2)::DOUBLE AS prob, ((NOT small_success) AND large_success)::INT AS label FROM traces),
s AS (SELECT prob, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r GROUP BY prob),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT (SELECT round(sum(p * (2 * below + n))::DOUBLE / (2 * sum(p) * sum(n))::DOUBLE, 9) FROM b) AS auc, round(count(*) FILTER ((prob >= 0.5::DOUBLE) = (label = 1))::DOUBLE / count(*), 9) AS acc,
  round(2 * count(*) FILTER (prob >= 0.5::DOUBLE AND label = 1) / (count(*) FILTER (prob >= 0.5::DOUBLE) + count(*) FILTER (label = 1))::DOUBLE, 9) AS f1_large,
  round(avg((prob - label) * (prob - label)), 9) AS brier, count(*)::BIGINT AS n FROM r""")
def score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of given scores: ranks over ranges of the score."""
    t = traces(spark, sf_dir)
    return rounded(models.metrics(t.select(F.round("router_prob", 2).alias("prob"), T.rescue(F.col("small_success"), F.col("large_success")).cast("int").alias("label"))))


@query("""WITH s AS (SELECT source, count(*) AS c FROM documents GROUP BY source), f AS (SELECT source, ((row_number() OVER (ORDER BY c DESC, source NULLS FIRST) - 1) % 5)::INT AS fold FROM s)
SELECT doc_id, fold FROM documents JOIN f USING (source)""")
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5).select("doc_id", "fold")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents), b AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars DESC) - 1 AS position FROM documents)
SELECT position, doc_id, n_chars FROM a JOIN b USING (position)""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beside what was predicted for them, by place alone: documents in order, lengths from the longest on."""
    d = table(spark, sf_dir, "documents")
    return functions.positional_join(d.select("doc_id"), d.select("n_chars"), "doc_id", [F.col("n_chars").desc()])


@query()
def text_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text")).join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label")), "doc_id")
    router = models.TextRouter().fit(d)
    return rounded(router.transform(d).select("doc_id", "label", "prob"), 6)


@query()
def gd_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = episodes(spark, sf_dir).select("episode", M.router_features(F.col("m")).alias("f")).select("episode", "f.*")
    return rounded(models.fit_descent_on(f.withColumn("label", F.col("episode") % 2), list(M.FEATURES), key="episode"), 6)


_BODY = "concat('Sure.', chr(10), '```python', chr(10), 'x = ', doc_id, chr(10), 'def f(a):', chr(10), '    return a + ', doc_id, chr(10), '```', chr(10), 'Explanation: it adds.')"


@query("SELECT doc_id, 'def f(a):' || chr(10) || '    return a + ' || doc_id AS code FROM documents")
def extract_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BODY).alias("r"))
    return d.select("doc_id", verify.extract_code(F.col("r"), F.lit("f"), F.lit("")).alias("code"))


@query("""WITH t AS (SELECT user_id, list_concat([1, 2, 9], [(10 + event_id % 7)::INT], [3], [1, 2, 8, 8, 3]) AS tokens, event_id % 2 = 0 AS a FROM events)
SELECT user_id, sum(CASE WHEN a THEN 3 ELSE 1 END - CASE WHEN a THEN 0 ELSE 1 END)::BIGINT AS marked FROM t GROUP BY user_id""")
def loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two assistant spans a row, of which the first may be trained on where the id is even."""
    e = table(spark, sf_dir, "events").select("user_id", F.expr("array(1, 2, 9, CAST(10 + event_id % 7 AS INT), 3, 1, 2, 8, 8, 3)").alias("tokens"), F.expr("array(event_id % 2 = 0, false)").alias("may"))
    mask = models.loss_mask(F.col("tokens"), [1, 2], 3, F.col("may"))
    total = F.aggregate(F.col("mask"), F.lit(0).cast("long"), lambda a, x: a + x)
    return e.withColumn("mask", mask).groupBy("user_id").agg(F.sum(total).alias("marked"))


@query("SELECT 'base.' || source || '.w' AS key, CASE WHEN min(doc_id) % 2 = 0 THEN 'model.' || source || '.w' ELSE 'base.' || source || '.w' END AS new_key FROM documents GROUP BY source")
def key_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("d"))
    wanted = s.where("d % 2 = 0").select(F.concat(F.lit("model."), "source", F.lit(".w")).alias("key"))
    return models.remapped_keys(s.select(F.concat(F.lit("base."), "source", F.lit(".w")).alias("key")), wanted, [("base.", "model.")])


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 3 ELSE doc_id % 3 + 1 END::INT AS n_turns, doc_id % 3 <> 2 AS success, doc_id % 3 = 0 AS initial_success, round(0.5 * CASE WHEN doc_id % 3 = 2 THEN 3 ELSE doc_id % 3 + 1 END, 9)::DOUBLE AS latency FROM documents""")
def repair_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = lambda i: F.struct((F.col("ord") % 3 == i).alias("success") if i < 2 else F.lit(False).alias("success"), F.lit(0.5).alias("latency"), F.lit(3).alias("prompt_tokens"), F.lit(4).alias("completion_tokens"))
    t = tasks(spark, sf_dir).withColumn("r", verify.repaired(F.array(*[turn(i) for i in range(3)])))
    return rounded(t.select(F.col("ord").alias("doc_id"), "r.n_turns", "r.success", "r.initial_success", "r.latency"))


@query()
def embedded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = models.embed(tasks(spark, sf_dir), "prompt", models.hashed_encoder())
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return rounded(e.select("task_id", norm.cast("double").alias("norm")), 4)


@query()
def text_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text router trained on the training shards decides on the held-out shard."""
    from ..operators import routing as R

    t = traces(spark, sf_dir).withColumn("label", T.rescue(F.col("small_success"), F.col("large_success")).cast("int")).withColumn("text", F.col("prompt"))
    router = models.TextRouter().fit(t.where("shard IN (0, 2, 3)"))
    scored = router.transform(t.where("shard = 4"))
    return rounded(R.simulate(scored, F.col("prob") >= 0.5, "verified", "dataset"), 6)
