"""Routers: logistic regression on vectors or text, gradient descent, metrics, masks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ratio, row_index, running_before
from ..sources.folders import temporary_path

MAX_FEATURES, MIN_DOCS = 40_000, 2
#: Examples that one task holds for a descent; more are dealt, none are left out.
DESCENT_ROWS = 1_000_000


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """weight = n / (2 n_class); a missing class gets one synthetic complement of zeros."""
    n = rows.groupBy(label).agg(F.count("*").alias("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy()))
    return rows.join(F.broadcast(n), label).withColumn("weight", F.col("_n") / (2.0 * F.col("_c"))).drop("_c", "_n")


def fit_logistic(rows: DataFrame, features: str = "features", label: str = "label") -> LogisticRegressionModel:
    """L2-regularised (C = 1), class-balanced logistic regression on unscaled features."""
    rows = rows.select(features, F.col(label).cast("double").alias(label)).persist(StorageLevel.DISK_ONLY)  # counted, weighed and read in every step
    try:
        n = rows.count()
        return LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", regParam=1.0 / max(n, 1), standardization=False, maxIter=1000, tol=1e-9).fit(balanced_weights(rows, label))
    finally:
        rows.unpersist()


def complemented(rows: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """The rows, and where only one class is present one row of zeros of the other."""
    kinds = [r[0] for r in rows.select(label).distinct().limit(2).collect()]
    if len(kinds) != 1:
        return rows
    size = rows.select(F.size(vector_to_array(features)).alias("n")).first()["n"]
    other = rows.sparkSession.createDataFrame([([0.0] * size, 1 - int(kinds[0]))], "_a array<double>, _l int")
    return rows.select(features, F.col(label).cast("int").alias(label)).unionByName(other.select(array_to_vector("_a").alias(features), F.col("_l").alias(label)))


def probability(model: LogisticRegressionModel, rows: DataFrame, name: str = "prob") -> DataFrame:
    """The rows with the probability of large.

    Worked out from the coefficients: a fitted model's own transform ships its
    training summary and with it the session, which fails once a job has been
    observed.
    """
    x, slope = vector_to_array(F.col(model.getFeaturesCol())), _literal(model.coefficients.toArray())
    dot = F.aggregate(F.zip_with(x, slope, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return rows.withColumn(name, 1 / (1 + F.exp(-(dot + F.lit(float(model.intercept))))))


def route(prob: Column, threshold: float) -> Column:
    """large at or above the threshold; small below it and where there is no router."""
    return F.when(prob >= threshold, "large").otherwise("small")


def folds(rows: DataFrame, group: str, splits: int) -> DataFrame:
    """A fold for each group: the largest groups dealt first, round robin (deterministic)."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_c"))
    dealt = row_index(sizes, [F.col("_c").desc(), F.col(group)], "_i", keys=[group])
    return rows.join(dealt.select(group, (F.col("_i") % splits).cast("int").alias("fold")), group)


def auc(scored: DataFrame, prob: str = "prob", label: str = "label") -> DataFrame:
    """Area under the ROC curve by ranks: equal scores are summed first, then counted in order, range by range."""
    steps = scored.groupBy(prob).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = running_before(steps, prob, {"_below": "n"}, keys=[prob])
    half = F.col("p") * (2 * F.col("_below") + F.col("n"))  # whole numbers, so that no order of summing shows
    return below.agg(ratio(F.sum(half.cast("decimal(38,0)")).cast("double"), 2.0 * F.sum("p") * F.sum("n")).alias("auc"))


def metrics(scored: DataFrame, prob: str = "prob", label: str = "label") -> DataFrame:
    """auc, accuracy, F1 of large, Brier score of out-of-fold probabilities."""
    p, y = F.col(prob) >= 0.5, F.col(label) == 1
    tp, fp, fn = F.count_if(p & y), F.count_if(p & ~y), F.count_if(~p & y)
    rest = scored.agg(ratio(F.count_if(p == y), F.count("*")).alias("acc"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_large"), F.avg((F.col(prob) - F.col(label)) ** 2).alias("brier"), F.count("*").alias("n"))
    return auc(scored, prob, label).crossJoin(rest)


def grouped_cv(rows: DataFrame, group: str, features: str = "features", label: str = "label") -> DataFrame | None:
    """Out-of-fold probabilities, groups kept together; None where the data are too few.

    At most five small models are fitted; each is scored on its fold in one pass.
    """
    c = rows.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"), F.count_distinct(group).alias("g")).first()
    least = min(c["p"], c["n"] - c["p"])
    if c["n"] < 6 or least < 2 or c["g"] < 2:
        return None
    splits = min(5, least, c["g"])
    dealt = folds(rows, group, splits)
    out = None
    for k in range(splits):
        train = complemented(dealt.where(F.col("fold") != k), features, label)
        part = probability(fit_logistic(train, features, label), dealt.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def _literal(values: np.ndarray) -> Column:
    """A constant array: parsed from text once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


class TextRouter:
    """TF-IDF (one and two words of two or more characters, sublinear counts, unit length) with logistic regression.

    Counts are written once and their weights are worked out on their arrays, so
    neither fit nor prediction leaves the JVM.
    """

    def __init__(self, most: int = MAX_FEATURES, min_docs: int = MIN_DOCS):
        self.most, self.min_docs = most, min_docs

    def _terms(self, rows: DataFrame, text: str) -> DataFrame:
        words = RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\w\w+", gaps=False, toLowercase=True)
        return NGram(n=2, inputCol="words", outputCol="pairs").transform(words.transform(rows)).withColumn("terms", F.concat("words", "pairs")).drop("words", "pairs")

    def _vocabulary(self, rows: DataFrame) -> list[Row]:
        """term, n, docs of the ``most`` most frequent terms of enough rows (ties: by code point, so that all runs agree)."""
        # each term of a sorted text beside the one before it: a text counts once a term
        ordered = rows.select(F.sort_array("terms").alias("term")).withColumn("before", F.concat(F.array(F.lit(None).cast("string")), "term"))
        told = ordered.select(F.inline(F.arrays_zip("term", "before"))).where(F.col("term").isNotNull())
        enough = told.groupBy("term").agg(F.count("*").alias("n"), F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("docs")).where(F.col("docs") >= self.min_docs)
        return enough.orderBy(F.col("n").desc(), "term").limit(self.most).collect()

    def _weights(self, counts: str) -> tuple[Column, Column]:
        """Places and weights (not yet of unit length) of a count vector's entries."""
        held, idf = F.unwrap_udt(counts), _literal(self.idf)
        return held["indices"], F.zip_with(held["values"], held["indices"], lambda v, i: (1 + F.log(v)) * F.get(idf, i))

    def fit(self, rows: DataFrame, text: str = "text", label: str = "label") -> TextRouter:
        if rows.select(label).distinct().count() < 2:
            raise ValueError("the training rows hold one class only")
        spark, self.text = rows.sparkSession, text
        terms = self._terms(rows.select(text, label), text)
        known = self._vocabulary(terms)
        self.vectorizer = CountVectorizerModel.from_vocabulary([r["term"] for r in known], inputCol="terms", outputCol="counts")
        held = temporary_path(spark, "counts")
        self.vectorizer.transform(terms).select("counts", F.col(label).alias("label")).write.parquet(held)
        counted = spark.read.parquet(held)
        self.idf = np.log((1 + counted.count()) / (1 + np.array([r["docs"] for r in known]))) + 1
        # vectors are structs of size, places and values; written as such they are read as vectors
        at, weights = self._weights("counts")
        weighed = counted.select("label", at.alias("at"), weights.alias("w"))
        vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(len(self.idf)).alias("size"), F.col("at").alias("indices"), _unit(F.col("w")).alias("values"))
        path = temporary_path(spark, "features")
        weighed.select("label", vector.alias("features")).write.parquet(path)
        label_type = counted.schema["label"].dataType
        self.model = fit_logistic(spark.read.schema(T.StructType([T.StructField("label", label_type), T.StructField("features", VectorUDT())])).parquet(path))
        return self

    def transform(self, rows: DataFrame, name: str = "prob") -> DataFrame:
        at, weights = self._weights("counts")
        found = self.vectorizer.transform(self._terms(rows, self.text)).withColumn("_at", at).withColumn("_w", weights)
        slope = _literal(self.model.coefficients.toArray())
        dot = F.aggregate(F.zip_with("_w", "_at", lambda w, i: w * F.get(slope, i)), F.lit(0.0), lambda a, x: a + x)
        score = dot / _length("_w") + F.lit(float(self.model.intercept))
        return found.select(*rows.columns, (1 / (1 + F.exp(-score))).alias(name))


def _unit(values: Column) -> Column:
    """The array divided by its length, which is worked out once an array: a column of it would be merged into the step of each entry."""
    held = F.array(F.struct(values.alias("v"), _length(values).alias("n")))
    return F.transform(held, lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0]


def _length(values: str | Column) -> Column:
    """The Euclidean length of an array; 1 for one without entries."""
    n = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(n > 0, n).otherwise(1.0)


def fit_descent(x: np.ndarray, y: np.ndarray, epochs: int = 500, rate: float = 0.1, l2: float = 0.01) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent from zero weights and the smoothed log-odds; needs both labels."""
    return _descend(lambda weights, bias: _slopes(x, y, weights, bias), x.shape[1], len(y), float(y.sum()), epochs, rate, l2)


def _slopes(x: np.ndarray, y: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Sums over rows of each feature times the error, and of the error."""
    error = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30))) - y
    return np.append(x.T @ error, error.sum())


def _descend(slopes: Callable[[np.ndarray, float], np.ndarray], size: int, n: int, positives: float, epochs: int, rate: float, l2: float) -> tuple[np.ndarray, float]:
    """The descent over ``n`` rows, given their sums at a step's weights."""
    if positives in (0.0, float(n)):
        raise ValueError("both labels are needed")
    weights, bias = np.zeros(size), float(np.log((positives + 1) / (n - positives + 1)))
    for _ in range(epochs):
        step = slopes(weights, bias) / n
        bias, weights = bias - rate * float(step[-1]), weights - rate * (step[:-1] + l2 * weights)
    return weights, bias


def fit_descent_on(rows: DataFrame, names: list[str], label: str = "label", key: str | None = None, epochs: int = 500, rate: float = 0.1, l2: float = 0.01) -> DataFrame:
    """name, weight rows of a router by descent on all rows.

    One task goes through all steps with at most ``DESCENT_ROWS`` rows; more of
    them are dealt by the key's hash, and each step is a job that sums over them.
    """
    spark, order = rows.sparkSession, F.xxhash64(*[F.col(n) for n in ([key] if key else names)])
    path = temporary_path(spark, "examples")
    told = rows.select(*[F.col(n).cast("double").alias(n) for n in names], F.col(label).cast("double").alias("_y"), order.alias("_h"))
    told.write.parquet(path)
    told = spark.read.schema(told.schema).parquet(path)
    found = told.agg(F.count("*").alias("n"), F.sum("_y").alias("positives")).first()
    if found["n"] > DESCENT_ROWS:
        weights, bias = _fit_in_parts(told, names, found["n"], found["positives"], epochs, rate, l2)
        return spark.createDataFrame([(n, float(w)) for n, w in zip([*names, "bias"], [*weights, bias])], "name string, weight double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h")
        w, b = fit_descent(pdf[names].to_numpy(), pdf["_y"].to_numpy(), epochs, rate, l2)
        return pd.DataFrame({"name": [*names, "bias"], "weight": [*w, b]})

    return told.withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(run, "name string, weight double")


def _fit_in_parts(told: DataFrame, names: list[str], n: int, positives: float, epochs: int, rate: float, l2: float) -> tuple[np.ndarray, float]:
    """``fit_descent`` on rows of many tasks, kept as blocks of numbers; the driver gets a part's sums."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], ["block"])

    def summed(blocks: Iterator[np.ndarray], weights: np.ndarray, bias: float) -> list[np.ndarray]:
        return [sum((_slopes(b[:-1].T, b[-1], weights, bias) for b in blocks), np.zeros(len(names) + 1))]

    parts = max(told.sparkSession.sparkContext.defaultParallelism, -(-n // DESCENT_ROWS))
    dealt = told.repartition(parts, "_h").sortWithinPartitions("_h").select(*names, "_y")  # so that runs sum in one order
    blocks = dealt.mapInArrow(packed, "block binary").rdd.map(lambda r: np.frombuffer(r["block"]).reshape(len(names) + 1, -1)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        slopes = lambda weights, bias: np.sum(blocks.mapPartitions(lambda b: summed(b, weights, bias)).collect(), axis=0)
        return _descend(slopes, len(names), n, positives, epochs, rate, l2)
    finally:
        blocks.unpersist()


def save_descent(path: str, names: list[str], weights: list[float], bias: float, threshold: float) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"feature_names": names, "weights": list(weights), "bias": bias, "threshold": threshold}, f, indent=2)


def load_descent(path: str, names: list[str]) -> dict:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if model["feature_names"] != list(names):
        raise ValueError("the model's features are others")
    return model


def embed(rows: DataFrame, column: str, encoder: Callable[[list[str]], np.ndarray], name: str = "embedding") -> DataFrame:
    """Unit vectors of texts by a pluggable encoder, created once a worker and fed whole batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            v = np.asarray(encoder(texts.fillna("").tolist()), np.float32)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(v))

    return rows.withColumn(name, run(F.col(column)))


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a frozen model: signed hashed words."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for r, t in enumerate(texts):
            for w in t.split():
                h = zlib.crc32(w.encode())
                out[r, h % dim] += 1 if h & 0x10000 else -1
        return out

    return encode


def loss_mask(tokens: Column, start: list[int], end: int, trainable: Column) -> Column:
    """1 inside trainable assistant spans, their end token included, the header not.

    tokens: array of ids; ``start``: the ids that open an assistant turn; the
    k-th span follows the k-th mark.  A span without end or with a null id, or
    spans that are not as many as the marks, give null.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def masked(tokens: pa.Array, trainable: pa.Array) -> pa.Array:
        return span_masks(tokens, start, end, trainable)

    return masked(tokens.cast("array<bigint>"), trainable.cast("array<boolean>"))


def span_masks(tokens: pa.Array, start: list[int], end: int, trainable: pa.Array) -> pa.Array:
    """``loss_mask`` of a batch: one pass over its tokens, then the k-th spans of all rows together."""
    known = ~(np.asarray(tokens.is_null()) | np.asarray(trainable.is_null()))
    lengths = np.where(known, tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    ids, marks = tokens.filter(pa.array(known)).flatten(), trainable.filter(pa.array(known)).flatten()
    value, valid = ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_valid())
    n_marks = np.where(known, trainable.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    first, first_mark = np.cumsum(lengths) - lengths, np.cumsum(n_marks) - n_marks
    stop, n = first + lengths, len(value)
    marks = marks.fill_null(False).to_numpy(zero_copy_only=False).astype(np.int8)
    # the next place at or after each at which the header begins, and at which a turn ends; n: none
    opens = np.ones(n, bool)
    for k, s in enumerate(start):
        opens[: n - k] &= valid[k:] & (value[k:] == s)
        opens[n - k :] = False
    opens &= np.arange(n) + len(start) <= np.repeat(stop, lengths)
    following = lambda hit: np.minimum.accumulate(np.append(np.where(hit, np.arange(n), n), n)[::-1])[::-1]
    next_open, next_end = following(opens), following(valid & (value == end))
    nulls = np.concatenate([[0], np.cumsum(~valid)])
    steps, spans, ok = np.zeros(n + 1, np.int64), np.zeros(len(lengths), np.int64), known.copy()
    row, at = np.flatnonzero(known), first[known]
    while len(row):
        at = next_open[at]
        going = at < stop[row]
        row, at = row[going], at[going]
        last = next_end[np.minimum(at + len(start), n)]
        closed = last < stop[row]
        ok[row[~closed]] = False
        row, at, last = row[closed], at[closed], last[closed]
        ok[row[nulls[last + 1] > nulls[at]]] = False
        may = (spans[row] < n_marks[row]) & (marks[np.minimum(first_mark[row] + spans[row], len(marks) - 1)] > 0 if len(marks) else False)
        steps[at[may] + len(start)] += 1
        steps[last[may] + 1] -= 1
        spans[row] += 1
        at = last + 1
    ok &= spans == n_marks
    mask = np.cumsum(steps[:n]).astype(np.int32)[np.repeat(ok, lengths)]
    offsets = np.concatenate([[0], np.cumsum(np.where(ok, lengths, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(mask), mask=pa.array(~ok))


def remapped_keys(keys: DataFrame, wanted: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """key -> new_key: the first rewriting whose result is a wanted key; others keep their name."""
    tries = F.array(*[F.struct(F.lit(i).alias("i"), F.replace(F.col("key"), F.lit(a), F.lit(b)).alias("c")) for i, (a, b) in enumerate([("", ""), *rules])])
    cases = keys.select("key", F.explode(tries).alias("t")).select("key", "t.i", F.col("t.c").alias("c"))
    hit = cases.join(wanted.select(F.col("key").alias("c")).distinct(), "c", "left_semi")
    best = hit.groupBy("key").agg(F.min_by("c", "i").alias("new_key"))
    return keys.join(best, "key", "left").select("key", F.coalesce("new_key", "key").alias("new_key"))
