"""How far the sources of a language differ in their words, in exact integers.

Words that many groups use are compared in dense tiles of terms by groups;
words that few use only where they occur.  Both are sums of what a word adds
to the distance that two groups would have if they used none of their words:
an absent word costs nothing but that base, which is added once at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .letters import Stretch, distinct, stretches, strings, wide_mask

#: A language keeps the terms of at least so many of its documents.
MIN_DOCUMENTS = 30
#: Added to each count.
SMOOTHING = 5
SCALE = 1_000_000_000
#: Terms reported of a group.
TOP_TERMS = 50
#: A term is dense if at least one in so many groups of its language uses it: from there on a column costs less than its pairs.
DENSE_SHARE = 4
#: Groups on a tile's side, and about so many terms in it.
SIDE, TERMS = 256, 4096


def _counted(s: Stretch, group: np.ndarray, keys: pa.Table) -> pa.RecordBatch:
    """Occurrences (n) and documents (d) of each term of each group of the stretch."""
    first, which = distinct(s.hash, s.text)  # a row for each term of each text
    times = np.bincount(which)
    of = group[s.first + s.text[first]]
    heads, term = distinct(s.hash[first], of)
    n, d = np.bincount(term, weights=times).astype(np.int64), np.bincount(term)
    at, word = keys.take(pa.array(of[heads])).combine_chunks(), first[heads]
    return pa.RecordBatch.from_arrays([*(at.column(k).combine_chunks().cast(pa.string()) for k in (0, 1)), strings(s.data, s.start[word], s.end[word]), pa.array(n), pa.array(d.astype(np.int64))], names=["lang", "source", "term", "n", "d"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), summed by task only; nulls are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
            code = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
            some, group = np.unique(code, return_inverse=True)
            width = max(len(source.dictionary), 1)
            keys = pa.table([lang.dictionary.take(pa.array(some // width)), source.dictionary.take(pa.array(some % width))], names=["lang", "source"])
            for s in stretches(batch.column(2), wide_mask):
                if len(s.hash):
                    yield _counted(s, group, keys)

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(run, "lang string, source string, term string, n long, d long")


def _price(n: Column, whole: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (whole + 5 * kept)), in decimals of 38 digits; null where no term is kept."""
    exact = lambda c: c.cast("decimal(20,0)")
    top, under = F.lit(SCALE).cast("decimal(10,0)") * exact(n + SMOOTHING), exact(whole + SMOOTHING * kept)
    return F.when(kept > 0, F.call_function("div", top, under) + 1)


def _tile(key: tuple[pa.Scalar, ...], rows: pa.Table, width: int) -> pa.Table:
    """What the terms of a block add to the base distance of each pair of a group of side A and one of side B."""
    (lang, a, b, _), column = (k.as_py() for k in key), lambda c: rows.column(c).combine_chunks()
    idx, p, dense = (column(c).to_numpy(zero_copy_only=False) for c in ("idx", "p", "dense"))
    words = column("term").dictionary_encode()
    term = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    side, local = idx // width, idx % width
    none = term < 0

    def base_of(x: int) -> np.ndarray:
        mine = none & (side == x)
        out = np.zeros(int(mine.sum()), np.int64)
        out[local[mine]] = p[mine]
        return out

    base_a, base_b = base_of(a), base_of(b)
    base = np.abs(base_a[:, None] - base_b[None, :])
    out = np.zeros(base.shape, np.int64)

    # dense terms: a full column each, absent groups at their base
    some = dense & ~none
    _, t = np.unique(term[some], return_inverse=True)
    count = int(t.max()) + 1 if len(t) else 0

    def filled(x: int, bases: np.ndarray) -> np.ndarray:
        table, mine = np.repeat(bases[None, :], count, axis=0), side[some] == x
        table[t[mine], local[some][mine]] = p[some][mine]
        return table

    if count:
        left, right = filled(a, base_a), filled(b, base_b)
        for k in range(len(base_a)):
            out[k] = np.abs(right - left[:, k : k + 1]).sum(axis=0) - count * base[k]

    # sparse terms: each against the base of the other side, as often as a group has that price ...
    few = ~dense & ~none

    def alone(x: int, other: np.ndarray, gap: np.ndarray) -> np.ndarray:
        mine, found = few & (side == x), np.zeros(gap.shape, np.int64)
        if mine.any():
            pairs, times = np.unique(np.stack([local[mine], p[mine]]), axis=1, return_counts=True)
            np.add.at(found, pairs[0], times[:, None] * (np.abs(pairs[1][:, None] - other[None, :]) - gap[pairs[0]]))
        return found

    out += alone(a, base_b, base) + alone(b, base_a, base.T).T
    # ... and put right where both use the term
    order = np.argsort(term[few], kind="stable")
    t, s, k, price = term[few][order], side[few][order], local[few][order], p[few][order]
    for step in range(1, int(np.bincount(t).max()) if len(t) else 0):
        same = np.flatnonzero(t[step:] == t[:-step])
        for x, y in ((same, same + step), (same + step, same)):
            ok = (s[x] == a) & (s[y] == b)
            x, y = x[ok], y[ok]
            np.add.at(out, (k[x], k[y]), np.abs(price[x] - price[y]) - np.abs(price[x] - base_b[k[y]]) - np.abs(base_a[k[x]] - price[y]) + base[k[x], k[y]])

    i, j = np.nonzero(out)
    value = out[i, j]
    first, second = (i + a * width).astype(np.int32), (j + b * width).astype(np.int32)
    if a != b:
        first, second, value = np.concatenate([first, second]), np.concatenate([second, first]), np.concatenate([value, value])
    return pa.table([pa.array([lang] * len(value), pa.string()), pa.array(first), pa.array(second), pa.array(value)], names=["lang", "idx", "other", "more"])


def _tiled(rows: DataFrame, width: int) -> DataFrame:
    """Each row (lang, sides, idx, ...) for every tile that its group stands in."""
    mine, other = F.floor(F.col("idx") / width).cast("int"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    return rows.withColumn("_x", mine).withColumn("_y", other).withColumn("side_a", F.least("_x", "_y")).withColumn("side_b", F.greatest("_x", "_y"))


def audit(docs: DataFrame, scratch: Scratch | None = None, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, dense_share: int = DENSE_SHARE, width: int = SIDE, block_terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source differs from the others of its language.

    Part ``pair``: the distance to each other source, summed over all kept
    terms.  Part ``term``: the ``top`` terms that the source uses more than its
    language.  Null text, lang and source are empty strings, so they make groups
    of their own; groups without terms, and languages that keep none (distance
    0), still have their pairs.  Every row is a document, also of repeated or
    null id; very long texts are counted whole.  Ties go to the smaller item in
    UTF-8 order.  An empty table gives an empty result.  Other columns are not
    read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "divergence")
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    # a list for each term that stays: at most one entry a source
    lists = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("uses")).where(F.col("d") >= min_documents)
    lists = scratch.save(lists.drop("d"), "lists")
    kept = lists.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("whole"))
    uses = lists.select("lang", "term", "all_n", F.size("uses").alias("groups"), F.explode("uses").alias("use")).select("lang", "term", "all_n", "groups", "use.*")
    sums = uses.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    occurring = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    in_lang = Window.partitionBy("lang")
    groups = occurring.join(sums, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["own", "kept", "whole"])
    groups = groups.withColumn("idx", F.row_number().over(in_lang.orderBy("source")) - 1).withColumn("size", F.count("*").over(in_lang))
    groups = groups.withColumn("base", _price(F.lit(0), F.col("own"), F.col("kept"))).withColumn("sides", F.ceil(F.col("size") / width).cast("int"))
    groups = scratch.save(groups.withColumn("blocks", F.greatest(F.ceil(F.col("kept") / block_terms), F.lit(1)).cast("int")), "groups")

    prices = uses.join(groups, ["lang", "source"]).withColumn("p", _price(F.col("n"), F.col("own"), F.col("kept")))
    over = F.col("p") - _price(F.col("all_n"), F.col("whole"), F.col("kept"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = prices.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    cells = prices.select("lang", "sides", "idx", "p", "term", block.alias("block"), (F.col("groups") * dense_share >= F.col("size")).alias("dense"))
    bases = groups.where("kept > 0").select("lang", "sides", "idx", F.col("base").alias("p"), F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("dense"))
    
    def tile(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _tile(key, rows, width)

    tiles = _tiled(cells.unionByName(bases), width).select("lang", "side_a", "side_b", "block", "idx", "p", "term", "dense")
    more = tiles.groupBy("lang", "side_a", "side_b", "block").applyInArrow(tile, "lang string, idx int, other int, more long")
    more = more.groupBy("lang", "idx", "other").agg(F.sum("more").alias("more"))

    # the result itself has a row for each pair of sources of a language
    others = groups.select("lang", F.col("source").alias("item"), F.col("idx").alias("other"), F.col("base").alias("other_base"))
    pairs = groups.join(others, "lang").where("idx <> other").join(more, ["lang", "idx", "other"], "left")
    value = F.coalesce(F.col("kept") * F.abs(F.col("base") - F.col("other_base")) + F.coalesce(F.col("more"), F.lit(0)), F.lit(0))
    pairs = pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(best))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM u GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
c AS (SELECT u.lang, u.source, u.term, count(*)::HUGEINT AS n FROM u JOIN k ON u.lang = k.lang AND u.term = k.term GROUP BY 1, 2, 3),
g0 AS (SELECT DISTINCT lang, source FROM d),
g AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g0.lang AND c.source = g0.source), 0)::HUGEINT AS own,
         (SELECT count(*) FROM k WHERE k.lang = g0.lang)::HUGEINT AS kept, coalesce((SELECT sum(lang_n) FROM k WHERE k.lang = g0.lang), 0)::HUGEINT AS whole
  FROM g0),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (own + 5 * kept) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 5)) // (whole + 5 * kept) AS q
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g0 a JOIN g0 b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
