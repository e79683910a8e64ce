"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import py_strip


def last_line(text: Column, most: int = 200) -> Column:
    """The last line of what a program said, cut; null if it said nothing."""
    said = py_strip(F.coalesce(text, F.lit("")))
    return F.when(said != "", F.substring(F.element_at(F.split(said, r"\r\n|\n|\r"), -1), 1, most))


def parse_list(text: Column) -> Column:
    """``[a, b]`` as an array of trimmed names; empty entries are dropped."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\[|\]\s*$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(py_strip(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def import_lines(text: Column) -> Column:
    """Lines of a program that import something."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: x.rlike(r"^\s*(import |from )"))


def local_model(name: Column, url: Column) -> Column:
    """A model's name without its provider prefix, where the endpoint is local."""
    local = F.contains(url, F.lit("127.0.0.1")) | F.contains(url, F.lit("localhost"))
    return F.when(local, F.regexp_replace(name, "^openai/", "")).otherwise(name)
