"""Places and running sums over a whole table without sorting it in one task.

Rows are dealt to ranges of the order and written there in order; only the
ranges' totals are summed together.  Any type that Spark orders will do, and no
range is much larger than another, wherever values crowd: rows of equal order go
by a key, or by a hash of the whole row.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import temporary_path

# A monotonically increasing id: the partition, and 33 bits that count its rows.
_RANGE, _PLACE = "CAST(shiftright(_at, 33) AS INT)", "(_at & 8589934591L)"


def _unhashable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.StructType) and any(_unhashable(f.dataType) for f in kind) or isinstance(kind, T.ArrayType) and _unhashable(kind.elementType)


def _ranged(rows: DataFrame, order: list[Column], keys: list[str] | None, parts: int | None) -> DataFrame:
    """The rows, written in ranges, with _at: the range, and the place in it."""
    spark = rows.sparkSession
    tie = [F.col(k) for k in keys] if keys else [F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if not _unhashable(f.dataType)])]
    by = [*order, *tie]
    path = temporary_path(spark, "ranges")
    dealt = rows.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def _placed(rows: DataFrame, order: str | list[Column], name: str, keys: list[str] | None, parts: int | None) -> tuple[DataFrame, int]:
    by = [F.col(order).asc_nulls_first()] if isinstance(order, str) else order
    held = _ranged(rows, by, keys, parts)
    counts = sorted(held.groupBy(F.expr(_RANGE).alias("_r")).count().collect())  # a row for each range
    before = list(itertools.accumulate((r["count"] for r in counts), initial=0))
    offsets = rows.sparkSession.createDataFrame([(r["_r"], b) for r, b in zip(counts, before)], "_r int, _before long")
    out = held.withColumn("_r", F.expr(_RANGE)).join(F.broadcast(offsets), "_r").withColumn(name, F.col("_before") + F.expr(_PLACE))
    return out.drop("_r", "_before", "_at"), before[-1]


def row_index(rows: DataFrame, order: str | list[Column], name: str, parts: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """``name``: the place (from 0) of each row in ascending ``order`` (a column, nulls first, or sort expressions).

    Rows of equal order go by ``keys``, without them by a hash of the row, so
    that all runs agree but on equal rows.  The rows are written once.
    """
    return _placed(rows, order, name, keys, parts)[0]


def positional_join(left: DataFrame, right: DataFrame, left_order: str | list[Column], right_order: str | list[Column], name: str = "position") -> DataFrame:
    """The n-th row of one table beside the n-th row of the other, and n (from 0).

    Tables of different length are an error, and so are columns of one name.
    """
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} | {c for c in (*left.columns, *right.columns) if c.lower() == name.lower()}
    if both:
        raise ValueError(f"columns in both tables: {sorted(both)}")
    (a, n), (b, m) = _placed(left, left_order, name, None, None), _placed(right, right_order, name, None, None)
    if n != m:
        raise ValueError(f"{n} rows beside {m}")
    return a.join(b, name)


def running_before(rows: DataFrame, order: str, values: dict[str, str], parts: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """The rows with the sums of columns over all rows before them in ``order``; values: name -> column."""
    held = _ranged(rows, [F.col(order).asc_nulls_first()], keys, parts).withColumn("_r", F.expr(_RANGE))
    names = list(values)
    totals = sorted(held.groupBy("_r").agg(*[F.coalesce(F.sum(values[n]), F.lit(0)).alias(n) for n in names]).collect())
    sums, lines = [0] * len(names), []
    for r in totals:
        lines.append((r["_r"], *sums))
        sums = [s + r[n] for s, n in zip(sums, names)]
    kinds = held.select(*[F.sum(values[n]).alias(n) for n in names]).schema
    cast = lambda kind: float if isinstance(kind, (T.DoubleType, T.FloatType)) else (lambda x: x)
    lines = [(r, *[cast(f.dataType)(x) for x, f in zip(line, kinds)]) for r, *line in lines]
    offsets = held.sparkSession.createDataFrame(lines, T.StructType([T.StructField("_r", T.IntegerType()), *[T.StructField(f"_{n}", f.dataType) for n, f in zip(names, kinds)]]))
    inside = Window.partitionBy("_r").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(F.broadcast(offsets), "_r")
    return out.select(*rows.columns, *[(F.col(f"_{n}") + F.coalesce(F.sum(values[n]).over(inside), F.lit(0))).alias(n) for n in names])
