"""Value conventions of traces: falsy defaults, guarded division, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def falsy_default(value: Column, default: float) -> Column:
    """The value, or the default where it is null or zero."""
    return F.coalesce(F.nullif(value.cast("double"), F.lit(0.0)), F.lit(float(default)))


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(float(otherwise)))


def py_strip(text: Column) -> Column:
    """Trim all white space, not only spaces."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def dataset_name(task_id: Column, source: Column) -> Column:
    """One of the two known sets by id prefix or source, else the lower-cased source, else "code"."""
    key, src = F.lower(task_id), F.lower(F.coalesce(source, F.lit("")))
    known = lambda name: key.startswith(name) | (src == name)
    return F.when(known("humaneval"), "humaneval").when(known("mbpp"), "mbpp").otherwise(F.coalesce(F.nullif(src, F.lit("")), F.lit("code")))


def signature(dataset: Column) -> Column:
    name = F.lower(py_strip(F.coalesce(dataset, F.lit(""))))
    return F.when(name.isin("humaneval", "mbpp"), name).otherwise("coding")
