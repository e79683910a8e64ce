"""Places, positional joins and running sums, whatever the order's type and wherever its values crowd."""

import itertools

import pytest
from pyspark.sql import functions as F

from lodestone.functions import ordering, positional_join, row_index, running_before
from lodestone.operators import models


def test_places_of_any_type(spark):
    values = [None, -3, 10**9, 5, 7, 5, 0, 2, 2, 2]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    kinds = {"long": F.col("v"), "string": F.col("v").cast("string"), "double": F.col("v") / 3, "decimal": F.col("v").cast("decimal(30,3)"), "struct": F.struct((-F.col("v")).alias("x"), "id"), "timestamp": F.timestamp_seconds("v")}
    for kind, column in kinds.items():
        frame = df.withColumn("o", column)
        got = row_index(frame, "o", "i", 3).orderBy("i").collect()
        assert [r["i"] for r in got] == list(range(10)), kind
        assert [r["o"] for r in got] == [r["o"] for r in frame.orderBy(F.col("o").asc_nulls_first()).collect()], kind


def test_ties_go_by_key_and_all_runs_agree(spark):
    df = spark.range(400).select("id", (F.col("id") % 3).alias("o"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    runs = [{r["id"]: r["i"] for r in row_index(df.repartition(n), "o", "i", 5, keys).collect()} for n, keys in itertools.product((1, 7), (["id"], None))]
    assert runs[0] == runs[2] == {r: k for k, r in enumerate(sorted(range(400), key=lambda x: (x % 3, x)))}
    assert runs[1] == runs[3] and sorted(runs[1].values()) == list(range(400))


def test_no_range_is_twice_the_mean(spark):
    # one outlier far away and one value that half of all rows have
    df = spark.range(20_000).select("id", F.when(F.col("id") == 7, 10**15).when(F.col("id") % 2 == 0, 42).otherwise(F.col("id")).alias("o"))
    held = ordering._ranged(df, [F.col("o").asc_nulls_first()], None, 8)
    sizes = [r["count"] for r in held.groupBy(F.expr(ordering._RANGE).alias("r")).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 20_000 and max(sizes) <= 2 * 2500


def test_positional_join(spark):
    left, right = spark.createDataFrame([(c,) for c in "badc"], "a string"), spark.createDataFrame([(x,) for x in (3, 1, None, 2)], "b int")
    assert [tuple(r) for r in positional_join(left, right, "a", "b").orderBy("position").collect()] == [(0, "a", None), (1, "b", 1), (2, "c", 2), (3, "d", 3)]
    assert positional_join(left.limit(0), right.limit(0), "a", "b").count() == 0
    with pytest.raises(ValueError, match="4 rows beside 3"):
        positional_join(left, right.where("b IS NOT NULL"), "a", "b")
    with pytest.raises(ValueError, match="both"):
        positional_join(left, left.withColumnRenamed("a", "A"), "a", "A")


def test_running_sums(spark):
    df = spark.createDataFrame([(k % 7, float(k), k) for k in range(50)], "o long, x double, n long")
    got = running_before(df, "o", {"bx": "x", "bn": "n"}, 4, ["n"]).collect()
    want = sorted((k % 7, k) for k in range(50))
    for r in got:
        before = [k for o, k in want if (o, k) < (r["o"], r["n"])]
        assert r["bn"] == sum(before) and r["bx"] == float(sum(before))
    assert running_before(df.limit(0), "o", {"b": "n"}).collect() == []


def test_area_under_the_curve(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.4, 0), (0.8, 1), (0.9, 0), (0.95, 1)]
    pairs = [(a, b) for a, y in rows if y for b, z in rows if not z]
    want = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    assert models.auc(spark.createDataFrame(rows, "prob double, label int")).first()["auc"] == pytest.approx(want)
    assert models.auc(spark.createDataFrame([(0.5, 1)], "prob double, label int")).first()["auc"] == 0


def test_plans_have_no_window_over_the_whole_table(spark):
    df = spark.range(100).select((F.col("id") / 7).alias("prob"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 9).alias("g"))
    for frame in (models.auc(df), models.folds(df, "g", 3), row_index(df, "prob", "i")):
        plan = frame._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan.split("Physical Plan")[1] or "Window" not in plan.split("Physical Plan")[1].split("SinglePartition")[0]
