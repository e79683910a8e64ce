"""Nearest neighbours by vantage-point trees, one per shard.

Rows go to the shard of the nearest of a few vantage points, and each shard
builds one tree: a node holds vantage points of its own, and each child the
rows nearest to one of them, with the range of their distances from it.  By the
triangle inequality a row x of child i is at least as far from a query q as

    max(low_i - d(q, v_i), d(q, v_i) - high_i, (d(q, v_i) - min_j d(q, v_j)) / 2)

and the same holds for a whole shard.  What this bound, times ``factor``, puts
beyond the query's k-th distance so far is skipped: with factor 1 the search is
exact.  A query is first searched in its own shard, and goes with the distance
found there only to shards that the bound lets through.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

K = 10
#: Rows of a shard, about; a task holds one tree of as many vectors and one block of queries.
SHARD_ROWS = 100_000
#: Rows of a leaf, about, vantage points of a node at most, and children that a query visits before the others.
LEAF, FAN, FIRST = 24, 1024, 4
QUERY_BLOCK = 512
#: Rows of which vantage points of shards are drawn, those of smallest id hash: so many a shard, and at most.
SHARD_SAMPLE, SAMPLE_ROWS = 16, 1 << 16
#: How much the pruning is relaxed; measured recall is in the README.
FACTOR = 4.5
RESULT = "query_id long, vec_id long, score double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, by a matrix product: exact to some 1e-7 of the vectors' length."""
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def lower_bounds(d: np.ndarray, low: np.ndarray, high: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """How far any row of each child is at least from each query; d: distances from the vantage points.

    A hair is taken off, as distances are rounded (scale: the queries' length and the vantage points').
    """
    bound = np.maximum(np.maximum(low - d, d - high), (d - d.min(axis=1, keepdims=True)) / 2)
    return np.maximum(bound - 1e-6 * scale, 0)


class Tree:
    """Points in leaf order, and nodes as parallel arrays; a node's children follow each other."""

    def __init__(self, ids, points, first, end, child, children, vantage, low, high):
        self.ids, self.points = ids, points
        #: Of each node: its points; first child and number of children (0: leaf); vantage point and range of distances in its parent.
        self.first, self.end, self.child, self.children, self.vantage, self.low, self.high = first, end, child, children, vantage, low, high
        #: Pairs of query and point that were compared.
        self.read = 0

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, k: int = K, leaf: int = LEAF, fan: int = FAN) -> Tree:
        order = np.lexsort((ids, *points.T[::-1]))
        ids, points = ids[order], points[order]
        # of equal vectors only the k + 1 smallest ids can be among anyone's k nearest
        new = np.ones(len(ids), bool)
        if len(ids) > 1:
            new[1:] = (points[1:] != points[:-1]).any(axis=1)
        start = np.flatnonzero(new)
        rank = np.arange(len(ids)) - start[np.cumsum(new) - 1]
        ids, points = ids[rank <= k], points[rank <= k]
        wide = points.astype(np.float64)
        rng = np.random.default_rng(12345)
        seq = rng.permutation(len(ids))
        first, end, child, children, vantage, low, high = [0], [len(ids)], [0], [0], [-1], [0.0], [0.0]
        todo = [0] if len(ids) else []
        while todo:
            me = todo.pop()
            a, b = first[me], end[me]
            if b - a <= 2 * leaf:
                continue
            chosen = seq[np.sort(rng.choice(np.arange(a, b), min(fan, (b - a) // leaf), replace=False))]
            centre = wide[chosen]
            owner, far = np.empty(b - a, np.int64), np.empty(b - a)
            for i in range(a, b, 2048):  # a bounded part of the matrix at a time
                d = distances(wide[seq[i : min(i + 2048, b)]], centre)
                owner[i - a : i - a + len(d)] = d.argmin(axis=1)
                far[i - a : i - a + len(d)] = d.min(axis=1)
            by = np.argsort(owner, kind="stable")
            seq[a:b], owner, far = seq[a:b][by], owner[by], far[by]
            kinds, starts = np.unique(owner, return_index=True)
            if len(kinds) < 2:
                continue
            child[me], children[me] = len(first), len(kinds)
            for c, x, y in zip(kinds.tolist(), starts.tolist(), [*starts[1:].tolist(), b - a]):
                todo.append(len(first))
                for column, value in zip((first, end, child, children, vantage, low, high), (a + x, a + y, 0, 0, chosen[c], far[x:y].min(), far[x:y].max())):
                    column.append(value)
        place = np.empty(len(seq), np.int64)
        place[seq] = np.arange(len(seq))
        vantage = np.array([place[v] if v >= 0 else -1 for v in vantage], np.int64)
        whole = (np.array(x, np.int64) for x in (first, end, child, children))
        return cls(ids[seq], points[seq], *whole, vantage, np.array(low), np.array(high))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *(self.ids, self.points, self.first, self.end, self.child, self.children, self.vantage, self.low, self.high))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        z = np.load(io.BytesIO(data))
        return cls(*(z[f"arr_{i}"] for i in range(9)))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K, factor: float = FACTOR, radius: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest of each query (inf where there are fewer), its own id left out.

        radius: distances beyond which the queries need nothing more.
        """
        queries = queries.astype(np.float64)
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), np.iinfo(np.int64).max)
        most = np.full(len(queries), np.inf) if radius is None else radius
        squares = (queries**2).sum(axis=1)

        def limit(active: np.ndarray) -> np.ndarray:
            return np.minimum(best[active, -1], most[active])

        def compare(active: np.ndarray, a: int, b: int) -> None:
            """Exact distances, by differences, of what a matrix product can't rule out."""
            points, ids = self.points[a:b].astype(np.float64), self.ids[a:b]
            self.read += len(active) * len(ids)
            size = squares[active][:, None] + (points**2).sum(axis=1)
            rough = size - 2 * (queries[active] @ points.T)
            x, y = np.nonzero(~(rough - 1e-12 * size - 1e-300 > (limit(active) ** 2 * (1 + 1e-12))[:, None]) & (ids[None, :] != query_ids[active][:, None]))
            if not len(x):
                return
            d = np.full(rough.shape, np.inf)
            for i in range(0, len(x), 100_000):
                r, c = x[i : i + 100_000], y[i : i + 100_000]
                d[r, c] = np.sqrt(((queries[active[r]] - points[c]) ** 2).sum(axis=1))
            some = np.unique(x)
            active = active[some]
            d = np.concatenate([best[active], d[some]], axis=1)
            i = np.concatenate([found[active], np.broadcast_to(ids, (len(some), len(ids)))], axis=1)
            i[np.isinf(d)] = np.iinfo(np.int64).max
            order = np.lexsort((i, d), axis=-1)[:, :k]
            best[active] = np.take_along_axis(d, order, axis=1)
            found[active] = np.take_along_axis(i, order, axis=1)

        def visit(me: int, active: np.ndarray) -> None:
            if not self.children[me]:
                compare(active, int(self.first[me]), int(self.end[me]))
                return
            kids = np.arange(self.child[me], self.child[me] + self.children[me])
            centre = self.points[self.vantage[kids]].astype(np.float64)
            d = distances(queries[active], centre)
            scale = np.sqrt(squares[active])[:, None] + np.sqrt((centre**2).sum(axis=1))
            bound = lower_bounds(d, self.low[kids], self.high[kids], scale) * factor
            # the nearest children first, so that the others meet a short distance
            near = np.argsort(d, axis=1, kind="stable")[:, :FIRST]
            done = np.zeros(d.shape, bool)
            for turn in range(near.shape[1]):
                mine = near[:, turn]
                go = np.flatnonzero(bound[np.arange(len(active)), mine] <= limit(active))
                for c in np.unique(mine[go]):
                    some = go[mine[go] == c]
                    visit(int(kids[c]), active[some])
                    done[some, c] = True
            for c in range(len(kids)):
                some = np.flatnonzero(~done[:, c] & (bound[:, c] <= limit(active)))
                if len(some):
                    visit(int(kids[c]), active[some])

        if len(self.ids) and len(queries):
            visit(0, np.arange(len(queries)))
        return best, found


def usable(vector: Column) -> Column:
    """Not null, not zero, and only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


class Cells:
    """Vantage points of the shards of one vector length, and the range of distances of the rows nearest to each."""

    def __init__(self, points: np.ndarray, first: int):
        self.points, self.first = points, first
        self.low, self.high, self.parts = np.zeros(len(points)), np.zeros(len(points)), np.zeros(len(points), np.int64)
        self.shard = np.zeros(len(points), np.int64)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(queries, self.points)
        scale = np.sqrt((queries**2).sum(axis=1))[:, None] + np.sqrt((self.points**2).sum(axis=1))
        return d, lower_bounds(d, self.low, self.high, scale)


def _cells(rows: DataFrame, sizes: dict[int, int], shard_rows: int, dtype) -> dict[int, Cells]:
    """Vantage points by vector length, drawn from at most SAMPLE_ROWS rows: about one for shard_rows rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    want = {dim: max(-(-n // shard_rows), min(cores, -(-n // 4096))) for dim, n in sizes.items()}
    drawn = rows.where(F.col("dim").isin([d for d, w in want.items() if w > 1])).orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE_ROWS, SHARD_SAMPLE * sum(want.values()))).select("dim", "embedding").collect()
    out, first = {}, 0
    for dim in sorted(sizes):
        sample = np.array([r["embedding"] for r in drawn if r["dim"] == dim], dtype).reshape(-1, dim)
        points = np.unique(sample, axis=0)
        points = points[np.random.default_rng(7).permutation(len(points))[: want[dim]]].astype(np.float64) if want[dim] > 1 and len(points) else np.zeros((1, dim))
        out[dim] = Cells(points, first)
        first += len(points)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of each query, ties to the smaller id.

    Both tables have vec_id and embedding.  Rows whose vector is null, empty,
    zero, or holds null or non-finite components, and rows without id, take no
    part; a query meets only vectors of its own length, however long.  Rows that
    bear the query's id are its own and no candidates; of query rows of equal id
    the smallest vector counts.  Fewer candidates than k: all of them.  Empty
    tables give an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "vptree")
    ok = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    dtype = np.float64 if "double" in vectors.schema["embedding"].dataType.simpleString() else np.float32
    kind = vectors.schema["embedding"].dataType
    rows = ok(vectors)
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # one row a vector length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cells = spark.sparkContext.broadcast(_cells(rows, sizes, shard_rows, dtype))

    def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        dim = batch.column(batch.schema.get_field_index("dim")).to_numpy()
        for n in np.unique(dim).tolist():
            part = batch.filter(pa.array(dim == n))
            yield n, part, _matrix(part.column(part.schema.get_field_index("embedding")), dtype).astype(np.float64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, part, points in by_dim(batch):
                own = cells.value[n]
                d = distances(points, own.points)
                yield pa.RecordBatch.from_arrays([pa.array((own.first + d.argmin(axis=1)).astype(np.int32)), pa.array(d.min(axis=1)), part.column(0), part.column(1)], names=["cell", "far", "vec_id", "embedding"])

    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()), T.StructField("vec_id", T.LongType()), T.StructField("embedding", kind)])
    dealt = scratch.save(rows.mapInArrow(deal, schema), "dealt")
    # a vantage point's rows make several shards if they are many; a row a vantage point reaches the driver
    table, total = cells.value, 0
    ranges = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    for own in (table[d] for d in sorted(table)):
        for i in range(len(own.points)):
            r = ranges.get(own.first + i)
            own.parts[i] = -(-r["n"] // shard_rows) if r else 0
            own.low[i], own.high[i] = (r["low"], r["high"]) if r else (np.inf, -np.inf)
            own.shard[i] = total
            total += int(own.parts[i])
    table = spark.sparkContext.broadcast(table)
    parts = np.concatenate([table.value[d].parts for d in sorted(table.value)])
    shards = np.concatenate([table.value[d].shard for d in sorted(table.value)])
    at = lambda values: F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), F.col("cell") + 1)
    shard = (at(shards) + F.pmod(F.xxhash64("vec_id"), at(np.maximum(parts, 1)))).cast("int")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        numbers = held.column("shard").to_numpy()
        for s in np.unique(numbers):
            part = held.filter(pa.array(numbers == s)).combine_chunks()
            tree = Tree.build(part.column("vec_id").to_numpy(), _matrix(part.column("embedding").combine_chunks(), dtype), k)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([tree.dump()], pa.binary())], names=["shard", "tree"])

    # a partition is one shard, of a bounded number of rows
    index = scratch.save(dealt.withColumn("shard", shard).select("shard", "vec_id", "embedding").repartitionById(total, F.col("shard")).mapInArrow(build, "shard int, tree binary"), "index")
    asked = ok(queries).groupBy("vec_id", "dim").agg(F.min("embedding").alias("embedding")).select(F.col("vec_id").alias("query_id"), "embedding", "dim")
    asked = scratch.save(asked.where(F.col("dim").isin(list(sizes))).withColumn("radius", F.lit(float("inf"))), "queries")
    request = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("query_id", T.LongType()), T.StructField("embedding", kind), T.StructField("radius", T.DoubleType())])

    def routed(away: bool):
        """Rows for the shards of each query's nearest vantage point, or for the others that the bound lets through."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, part, points in by_dim(batch):
                    own = table.value[n]
                    d, bound = own.bounds(points)
                    d[:, own.parts == 0] = np.inf
                    home = np.arange(len(own.points)) == d.argmin(axis=1)[:, None]
                    radius = part.column(3).to_numpy()[:, None]
                    q, c = np.nonzero((~home & (own.parts > 0) & (bound * factor <= radius)) if away else home)
                    times = own.parts[c]
                    to = np.repeat(own.shard[c], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    q = pa.array(np.repeat(q, times))
                    for i in range(0, len(q), 4096):
                        some = q[i : i + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array(to[i : i + 4096].astype(np.int32)), *(part.column(x).take(some) for x in (0, 1, 3))], names=request.names)

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for s in np.unique(numbers):  # ascending, as the rows are
                part = batch.filter(pa.array(numbers == s))
                has = part.column(4).is_valid().to_numpy(zero_copy_only=False)
                if has.any():
                    tree = Tree.load(part.column(4)[int(np.flatnonzero(has)[0])].as_py())
                part = part.filter(pa.array(~has))
                for i in range(0, len(part), QUERY_BLOCK):
                    block = part.slice(i, QUERY_BLOCK)
                    ids = block.column(1).to_numpy()
                    d, found = tree.search(ids, _matrix(block.column(2), dtype), k, factor, block.column(3).to_numpy())
                    some = np.isfinite(d)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[some.ravel()]), pa.array(found[some]), pa.array(d[some])], names=["query_id", "vec_id", "score"])

    def searched(sent: DataFrame, name: str) -> DataFrame:
        # each shard's tree comes first, then its queries
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in request.fields[1:]]
        both = index.select("shard", *none, "tree").unionByName(sent.withColumn("tree", F.lit(None).cast("binary")))
        both = both.repartitionById(total, F.col("shard")).sortWithinPartitions("shard", F.col("tree").isNull())
        return scratch.save(both.mapInArrow(search, RESULT), name)

    home = searched(asked.mapInArrow(routed(False), request), "home")
    # the k-th distance at home; a query with fewer rows there has none yet
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    reach = home.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("reach"))
    far = asked.join(reach, "query_id", "left").select("query_id", "embedding", "dim", F.coalesce("reach", "radius").alias("radius"))
    away = searched(far.mapInArrow(routed(True), request), "away")
    best = home.unionByName(away).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_of_hundredth(vectors: DataFrame) -> DataFrame:
    """The nearest rows of those whose id is divisible by 100; odd rows as in ``nearest``."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
