"""Mix sources to target weights by nested hash thresholds (DataFrame operations only).

Sizes are summed by source and hash bucket; the budget's threshold falls into
one bucket, which alone is cut into finer buckets, level by level, until it
holds one hash.  Rows are then taken by comparing their hash with their
source's threshold: nothing is sorted, and no row leaves its task for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh

#: Source weights, in the sources' order by code point, repeating.
WEIGHTS = (3, 1, 2)
#: Bits of the hash that each level of buckets reads; together the whole hash.
LEVELS = (12, 12, 12, 12)
HASH_BITS = sum(LEVELS)


def row_hash(key: Column) -> Column:
    """48 bits of the key's MD5, the same on every run and engine; null hashes as an empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: int = 2) -> DataFrame:
    """source, source_size -> also target: ``share`` of all sizes by weight, at most ``limit`` sizes each.

    Water filling in one pass over the (few) sources, in order of limit/weight:
    filling the sources before one and sharing the rest by weight gives a level
    for each; the right level is the highest of them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    df = sources.withColumn("_w", weight.cast("long")).withColumn("_cap", (F.lit(limit) * F.col("source_size")).cast("long"))
    df = df.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    df = df.withColumn("_before", F.coalesce(F.sum("_cap").over(fill), F.lit(0))).withColumn("_used", F.coalesce(F.sum("_w").over(fill), F.lit(0)))
    df = df.withColumn("_all", F.sum("source_size").over(whole)).withColumn("_weights", F.sum("_w").over(whole))
    df = df.withColumn("_level", (F.lit(share) * F.col("_all") - F.col("_before")) / (F.col("_weights") - F.col("_used")))
    df = df.withColumn("_fill", F.max("_level").over(whole))
    level = F.coalesce(F.col("_fill") * F.col("_w"), F.col("_cap").cast("double"))
    return df.select("source", "source_size", F.least(F.col("_cap").cast("double"), level).alias("target"))


def _boundary(rows: DataFrame, state: DataFrame, shift: int, bits: int) -> DataFrame:
    """One level: the bucket of each source in which its budget ends, and the sizes before it.

    rows: source, hash, size; state: source, prefix (the bucket so far), taken, budget.
    """
    inside = rows.join(state.select(F.col("source").alias("_s"), "prefix"), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", shift + bits) == F.col("prefix")))
    sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("part"))
    upto = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("part").over(upto)).withColumnRenamed("source", "_s")
    joined = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
    over = F.col("taken") + F.col("upto") > F.col("budget")
    return joined.groupBy("source", "budget").agg(
        # the first bucket whose end lies beyond the budget, else the last one
        F.coalesce(F.min(F.when(over, F.struct("bucket", "upto", "part"))), F.max(F.struct("bucket", "upto", "part"))).alias("at"),
        F.min("taken").alias("taken"),
    ).select("source", "budget", F.col("at.bucket").alias("prefix"), (F.col("taken") + F.col("at.upto") - F.col("at.part")).alias("taken"), F.col("at.part").alias("part"))


def _tag(source: str) -> Column:
    """A plain string for each source, null's own too: a hot source's rows can then be split, or the plan broadcast."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def plan_mix(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """rows: source, hash, size -> per source: target, copies that all rows give, last hash that gives one more.

    With ``scratch`` the sources and each level's state (a row a source) are
    written, so that no level is worked out twice.
    """
    save = scratch.save if scratch else (lambda df, _: df)
    sums = save(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    sources = save(source_targets(sums, weights, share, limit), "sources")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("copies", copies)
    state = sources.select("source", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("taken"))
    shift = HASH_BITS
    for k, bits in enumerate(LEVELS):
        shift -= bits
        state = save(_boundary(rows, state.select("source", "budget", "prefix", "taken"), shift, bits), f"level-{k}")
    # the boundary is now one hash: take it if that comes nearer to the budget
    take = F.col("taken") + F.col("part") - F.col("budget") < F.col("budget") - F.col("taken")
    last = state.select(F.col("source").alias("_s"), F.when(take, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("last_hash"))
    return sources.join(last, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = 1.5, limit: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """key, source, size, source_size, target, taken: how many words the mix takes of each row.

    Every row gives ``taken`` = size times a whole number of copies (0 to
    ``limit``).  A source's taken words differ from its target by at most half
    the words of its heaviest key.  A null or empty text has size 0, a very long
    one its whole size; a null source is a source, last in order; rows with
    equal (or null) keys share one decision, so no tie is left open.  An empty
    table gives an empty result.  Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    # one narrow table, so that the whole texts are read and counted once
    rows = scratch.save(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), text_size(F.col(text)).alias("size"), row_hash(F.col(key)).alias("hash")), "sizes")
    plan = scratch.save(plan_mix(rows, weights, share, limit, scratch), "plan").withColumnRenamed("source", "_s")
    copies = F.col("copies") + F.when(F.col("hash") <= F.col("last_hash"), 1).otherwise(0)
    taken = (F.col("size") * F.least(copies, F.lit(limit))).cast("long")
    joined = rows.withColumn("_k", _tag("source")).join(plan.withColumn("_k", _tag("_s")), "_k")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0 to ``limit`` times), with the same columns and values.

    Null, empty and very long texts, null sources, rows of equal or null id and
    an empty table are treated as by ``mix``: a text without words has size 0
    and comes as often as its source's threshold says.  Further columns, of
    whatever name, pass through.
    """
    limit = options.get("limit", 2)
    scratch = scratch or Scratch(docs.sparkSession, "mixed")
    rows = scratch.save(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), row_hash(F.col("doc_id")).alias("hash")), "sizes")
    tag, copies, last, turn = fresh(docs.columns, "_tag", "_copies", "_last", "_turn")
    plan = scratch.save(plan_mix(rows, scratch=scratch, **options), "plan").select(_tag("source").alias(tag), F.col("copies").alias(copies), F.col("last_hash").alias(last))
    joined = docs.withColumn(tag, _tag("source")).join(plan, tag)
    times = F.least(F.col(copies) + F.when(row_hash(F.col("doc_id")) <= F.col(last), 1).otherwise(0), F.lit(limit))
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int")))).where(times > 0).select(*[F.col(f"`{c}`") for c in docs.columns])


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
s1 AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS ratio FROM s0),
s2 AS (
  SELECT *, coalesce(sum(cap) OVER f, 0)::BIGINT AS before, coalesce(sum(w) OVER f, 0)::BIGINT AS used,
         (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS weights
  FROM s1 WINDOW f AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - before::DOUBLE) / (weights - used)::DOUBLE AS lvl FROM s2),
s4 AS (SELECT *, max(lvl) OVER () AS fill FROM s3),
s5 AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(fill * w, cap::DOUBLE)) AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM s5),
s7 AS (SELECT *, target - copies * source_size AS budget FROM s6),
u AS (SELECT source, h, sum(size)::BIGINT AS part FROM d GROUP BY source, h),
c AS (SELECT source, h, part, sum(part) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM u),
t AS (
  SELECT s7.source, coalesce(arg_min(c.h, c.h) FILTER (c.upto > budget), max(c.h)) AS edge
  FROM s7 JOIN c ON s7.source IS NOT DISTINCT FROM c.source GROUP BY s7.source),
e AS (
  SELECT t.source, CASE WHEN upto - budget < budget - (upto - part) THEN edge ELSE edge - 1 END AS last_hash
  FROM t JOIN c ON t.source IS NOT DISTINCT FROM c.source AND t.edge = c.h
  JOIN s7 ON t.source IS NOT DISTINCT FROM s7.source)
SELECT d.doc_id, d.size, s7.source_size, s7.target,
       (d.size * least(copies + CASE WHEN h <= last_hash THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
