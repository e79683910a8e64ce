"""N-gram Jaccard join by a token-group matrix.

Documents of equal shingle sets are one class.  Representatives are partitioned
into groups of similar documents; each group stores the union of its members'
tokens.  A query shares a token of its prefix with every group that can hold a
partner; its overlap with the group's union bounds its overlap with every
member, and only groups that the bound lets through are opened and compared
member by member.  Groups are families verified to be linked already, so what
remains to compare is between groups, and the number of rows stays linear in
the number of tokens, not quadratic in a family's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, dense_bytes, under_keys
from .components import components
from .textvec import Words, mix, runs

SHINGLE = 5
#: Documents link when OVER * |intersection| >= SHARE * |union|.
SHARE, OVER = 80, 100
#: Members of a group, at most about so many: a larger family has several groups.
GROUP_MEMBERS = 64
#: Cells of the frequency sketch that orders tokens (one byte each, sent to every task).
SKETCH_CELLS = 1 << 21
#: Tokens counted together when repeated ones are looked for.
COUNT_TOKENS = 1 << 21
#: Slots of the filter of needed documents (one bit each, sent to every task).
FILTER_SLOTS = 1 << 23


class Sets:
    """The distinct shingle hashes of the texts of a run, text by text, ascending."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int):
        words = Words(data, offsets, True)
        gram, first = words.grams(k)
        text = words.text[first]
        few = np.flatnonzero((words.count > 0) & (words.count < k))
        if len(few):  # fewer words than a shingle has: the whole sequence is one
            whole = []
            for t in few:
                h = np.uint64(words.count[t])
                for w in words.hash[words.first[t] : words.first[t + 1]]:
                    h = mix(np.array([h ^ w]))[0]
                whole.append(h)
            gram, text = np.concatenate([gram, np.array(whole, np.uint64)]), np.concatenate([text, few])
        order = np.lexsort((gram, text))
        gram, text = gram[order], text[order]
        new = np.ones(len(gram), bool)
        if len(gram):
            new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
        self.token, self.text = gram[new], text[new]
        self.size = np.bincount(self.text, minlength=len(offsets) - 1)
        self.first = np.zeros(len(self.size) + 1, np.int64)
        np.cumsum(self.size, out=self.first[1:])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two sums of mixed tokens a text: equal sets, and in practice only they, have equal ones."""
        out = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            upto = np.zeros(len(self.token) + 1, np.uint64)
            np.cumsum(mix(self.token ^ np.uint64(salt)), out=upto[1:])
            out.append((upto[self.first[1:]] - upto[self.first[:-1]]).view(np.int64))
        return out[0], out[1]


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Tokens that a set of n must show so that any partner's tokens meet them."""
    return n - -(-SHARE * n // OVER) + 1


def least_shown(n: Column, m: Column) -> Column:
    """Prefix tokens that linked sets of sizes n and m have in common, at least.

    What they share beyond the prefix that ends first in the order is at most
    what that set holds beyond its prefix.
    """
    need = F.ceil(SHARE * (n + m) / F.lit(OVER + SHARE))
    rest = F.ceil(SHARE * F.greatest(n, m) / F.lit(OVER)) - 1
    return need - rest


def least_shown_in(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """A lower bound of the same for sizes in two ranges.

    Without its two ceilings the value is linear in either size on each side of
    the diagonal, so it is least at an end of a range or at the furthest size
    that such an end can link with.  The ceilings raise need by less than 1 and
    rest by less than 1, so the whole is less by 1 at most between the ends.
    """
    down, up = (lambda c: F.ceil(SHARE * c / F.lit(OVER))), (lambda c: F.floor(OVER * c / F.lit(SHARE)))
    ends = []
    for a0, a1, b0, b1 in ((lo, hi, other_lo, other_hi), (other_lo, other_hi, lo, hi)):
        ends += [least_shown(a0, F.greatest(a0, F.least(b1, up(a0)))), least_shown(a1, F.least(a1, F.greatest(b0, down(a1))))]
    return F.least(*ends) - F.when((lo == hi) & (other_lo == other_hi), 0).otherwise(1)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two ascending arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def _light(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: doc_id, n, d1, d2 of each row; kind 1: a sketch cell (doc_id) and how often its tokens repeat (n)."""
    names = ["kind", "doc_id", "n", "d1", "d2"]

    def repeated(tokens: list[np.ndarray]) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(tokens), return_counts=True)
        value, n = value[n > 1], n[n > 1]
        cell, at = np.unique(value & np.uint64(SKETCH_CELLS - 1), return_inverse=True)
        most = np.zeros(len(cell), np.int64)
        np.maximum.at(most, at, n)
        none = pa.nulls(len(cell), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(cell), np.int32)), pa.array(cell.astype(np.int64)), pa.array(most), none, none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for i, j, data, offsets in runs(batch.column(1)):
                sets = Sets(data, offsets, k)
                d1, d2 = sets.digests()
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int32)), batch.column(0)[i:j], pa.array(sets.size), pa.array(d1), pa.array(d2)], names=names)
                held.append(sets.token)
                count += len(sets.token)
                if count >= COUNT_TOKENS:
                    yield repeated(held)
                    held, count = [], 0
        if held:
            yield repeated(held)

    return docs.mapInArrow(run, "kind int, doc_id long, n long, d1 long, d2 long")


def _sketch(light: DataFrame) -> np.ndarray:
    """By cell, the logarithm of how often its tokens were seen to repeat (SKETCH_CELLS bytes)."""
    cells = light.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n"))
    return dense_bytes(cells.select(F.col("doc_id").cast("int").alias("cell"), F.least(F.ceil(F.log2("n")), F.lit(63)).cast("int").alias("value")), SKETCH_CELLS)


def _prefixes(docs: DataFrame, k: int, sketch) -> DataFrame:
    """token, doc_id, n, score: each set's prefix in the order of (how often tokens repeat, hash).

    Any one order of all tokens makes the prefix exact; putting repeated ones
    last keeps the lists of documents with one token short.  ``score`` is how
    much a set's tokens repeat on average, with bits of its digest to part
    equals: among near copies it is highest for the one that the others vary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sketch.value.astype(np.uint64) << np.uint64(58)
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            for i, j, data, offsets in runs(batch.column(1)):
                sets = Sets(data, offsets, k)
                ids = batch.column(0)[i:j]
                here = ids.to_pylist()
                d1, d2 = sets.digests()
                use = np.zeros(j - i, bool)
                for t, key in enumerate(zip(d1.tolist(), d2.tolist())):
                    # of equal sets in a task, a later one counts only if its id is smaller: the class goes by its smallest
                    if sets.size[t] and here[t] is not None and here[t] < seen.get(key, 1 << 63):
                        seen[key], use[t] = here[t], True
                token, text = sets.token, sets.text
                total = np.bincount(text, weights=(level[token & np.uint64(SKETCH_CELLS - 1)] >> np.uint64(58)).astype(float), minlength=j - i)
                mean = np.minimum(64 * total / np.maximum(sets.size, 1), 2047).astype(np.int64)
                score = (mean << 20) | (d1.view(np.uint64) >> np.uint64(44)).astype(np.int64)
                rank = level[token & np.uint64(SKETCH_CELLS - 1)] | (token >> np.uint64(6))
                order = np.lexsort((rank, text))
                place = np.arange(len(token)) - sets.first[text]
                some = order[(place < prefix_size(sets.size)[text]) & use[text]]
                if len(some):
                    at = text[some]
                    yield pa.RecordBatch.from_arrays([pa.array(token[some].view(np.int64)), ids.take(pa.array(at)), pa.array(sets.size[at].astype(np.int32)), pa.array(score[at].astype(np.int32))], names=["token", "doc_id", "n", "score"])

    return docs.mapInArrow(run, "token long, doc_id long, n int, score int")


def _needed(ids: DataFrame) -> np.ndarray:
    """Which slots the ids hash to: FILTER_SLOTS bits, of which a full filter only saves nothing."""
    slots = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_SLOTS)).cast("int").alias("cell"), F.lit(1).alias("value"))
    return np.packbits(dense_bytes(slots, FILTER_SLOTS))


def _whole_sets(docs: DataFrame, k: int, needed) -> DataFrame:
    """doc_id, n, tokens (ascending 64-bit hashes) of the documents in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.unpackbits(needed.value).astype(bool), set()
        for batch in batches:
            use = wanted[batch.column(2).to_numpy(zero_copy_only=False)]
            for t in np.flatnonzero(use):  # of rows of one id a task gives the first
                doc = batch.column(0)[t].as_py()
                use[t] = doc not in seen
                seen.add(doc)
            batch = batch.filter(pa.array(use))
            for i, j, data, offsets in runs(batch.column(1)):
                sets = Sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(sets.size.astype(np.int32)), pa.array([sets.token[a:b].tobytes() for a, b in zip(sets.first, sets.first[1:])], pa.binary())], names=["doc_id", "n", "tokens"])

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_SLOTS)).cast("int").alias("slot")
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", slot).mapInArrow(run, "doc_id long, n int, tokens binary")


def _needed_sets(docs: DataFrame, k: int, ids: DataFrame) -> DataFrame:
    return _whole_sets(docs, k, docs.sparkSession.sparkContext.broadcast(_needed(ids)))


def _dealt_by_group(members: DataFrame, asked: DataFrame, payload: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """group, part, kind, doc_id, component, n, tokens: each part's members (kind 0) before its queries (kind 1).

    A group with very many queries is dealt to several parts, each of which gets
    its members.
    """
    rows = members.select("group", F.lit(0).alias("kind"), "doc_id", "component").unionByName(asked.select("group", F.lit(1).alias("kind"), "doc_id", "component"))
    per = 256
    many = asked.groupBy("group").agg(F.ceil(F.count("*") / per).cast("int").alias("_parts")).where("_parts > 1")
    rows = rows.join(scratch.save(many, f"many-{name}"), "group", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    mine = F.sequence(F.lit(0), F.col("_parts") - 1)
    one = F.array(F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("kind") == 0, mine).otherwise(one)))
    rows = rows.join(payload, "doc_id").select("group", "part", "kind", "doc_id", "component", "n", "tokens")
    parts = int(payload.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "group", "part").sortWithinPartitions("group", "part", "kind")


class _Group:
    """One group's members, and how many tokens a query has in common with each."""

    def __init__(self):
        self.docs, self.components, self.sizes, self.sets, self.matrix = [], [], [], [], None

    def add(self, doc: int, component: int, n: int, tokens: np.ndarray) -> None:
        self.docs.append(doc)
        self.components.append(component)
        self.sizes.append(n)
        self.sets.append(tokens)

    def close(self) -> None:
        if self.matrix is None:
            every = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(self.sets)), [len(t) for t in self.sets])
            self.matrix = np.unique(every), every, owner
            self.docs, self.components, self.sizes = np.array(self.docs), np.array(self.components), np.array(self.sizes)

    def common(self, tokens: np.ndarray) -> np.ndarray:
        _, every, owner = self.matrix
        at = np.searchsorted(tokens, every)
        return np.bincount(owner[tokens[np.minimum(at, len(tokens) - 1)] == every], minlength=len(self.sets))


def _groups(batches: Iterator[pa.RecordBatch], tokens_of) -> Iterator[tuple[_Group, int, int, int, int, np.ndarray]]:
    """Each query with its group: (group, group id, doc, component, n, tokens)."""
    at, group = None, _Group()
    for batch in batches:
        for g, part, kind, doc, component, n, tokens in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6)):
            if at != (g, part):
                at, group = (g, part), _Group()
            tokens = tokens_of(tokens)
            if kind == 0:
                group.add(doc, component, n, tokens)
            elif group.docs is not None and len(group.docs):
                group.close()
                yield group, g, doc, component, n, tokens


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)


def screen_groups(packs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """kind, doc_id, group: queries that a group's shown tokens let through (1), and the members they may link with (0).

    packs: group, members (doc_id, component, n, tokens shown); pairs: group,
    other (that ``group`` asks).  A row holds a whole group, so the rows are as
    many as the pairs of groups.
    """
    per = 8
    many = pairs.groupBy("other").agg(F.ceil(F.count("*") / per).cast("int").alias("_parts"))
    many = scratch.save(many, "many-screen")
    mine = packs.join(many.withColumnRenamed("other", "group"), "group").select(F.col("group").alias("other"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("kind"), "members")
    theirs = pairs.join(many, "other").select("group", "other", F.pmod(F.xxhash64("group"), F.col("_parts")).cast("int").alias("part"))
    theirs = scratch.save(theirs, "dealt-screen").join(packs, "group").select("other", "part", F.lit(1).alias("kind"), "members")

    def unpack(members: pa.Scalar) -> list[tuple[int, int, int, np.ndarray]]:
        rows = members.values
        tokens = rows.field("tokens")
        at, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        return [(d, c, n, np.sort(flat[at[k] : at[k + 1]])) for k, (d, c, n) in enumerate(zip(*(rows.field(f).to_pylist() for f in ("doc_id", "component", "n"))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, group, named = None, _Group(), set()
            for batch in batches:
                for g, part, kind, members in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                    if at != (g, part):
                        at, group, named = (g, part), _Group(), set()
                    if kind == 0:
                        for m in unpack(members):
                            group.add(*m)
                        group.close()
                        continue
                    for doc, component, n, tokens in unpack(members):
                        m = group.sizes
                        need = -(-SHARE * (n + m) // (OVER + SHARE)) + 1 - -(-SHARE * np.maximum(n, m) // OVER)
                        some = (group.common(tokens) >= np.maximum(need, 1)) & (group.components != component) & (OVER * np.minimum(n, m) >= SHARE * np.maximum(n, m))
                        if some.any():
                            yield 1, doc, g
                            for other in group.docs[some].tolist():
                                if other not in named:
                                    named.add(other)
                                    yield 0, other, g

        yield from _batched(rows(), ["kind", "doc_id", "group"], [pa.int32(), pa.int64(), pa.int64()])

    parts = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mine.unionByName(theirs).repartition(parts, "other", "part").sortWithinPartitions("other", "part", "kind").mapInArrow(run, "kind int, doc_id long, group long")


def open_groups(members: DataFrame, asked: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) between queries and members of the groups asked, as many as join their components.

    members and asked: doc_id, component, group.  A group's union is built once,
    and a query opens the group only if enough of its tokens are in the union.
    A member whose component the query has joined already is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            root: dict[int, int] = {}
            current = None

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for group, _, doc, component, n, tokens in _groups(batches, lambda t: np.frombuffer(t.as_buffer(), np.uint64).copy()):
                if group is not current:
                    root, current = {}, group
                if OVER * overlap(tokens, group.matrix[0]) < SHARE * n:
                    continue
                common = group.common(tokens)
                for m in np.flatnonzero(OVER * common >= SHARE * (n + group.sizes - common)):
                    a, b = find(component), find(int(group.components[m]))
                    if group.docs[m] != doc and a != b:
                        root[max(a, b)] = min(a, b)
                        yield doc, int(group.docs[m])

        yield from _batched(rows(), ["a", "b"], [pa.int64(), pa.int64()])

    return _dealt_by_group(members, asked, sets, scratch, name).mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, k: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row (columns doc_id and text).

    component_id is the smallest doc_id reachable by links, the row's own
    included.  Null and empty texts, and texts without words, have no shingles
    and are linked with nothing; rows of equal id belong together, each with the
    links of its own text; a null id gets a null component; texts of any length
    are compared whole.  An empty table gives an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    light = scratch.save(_light(docs, k), "light")
    sizes = light.where("kind = 0").drop("kind")
    # ids that have different sets: each text goes under a key of its own, and the keys of an id are linked
    span = sizes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("n", "d1", "d2")).alias("_a"), F.max(F.struct("n", "d1", "d2")).alias("_b"))
    keys = None
    if not span.where("_a < _b").isEmpty():
        docs, keys = under_keys(docs, scratch)
        light = scratch.save(_light(docs, k), "light-keyed")
        sizes = light.where("kind = 0").drop("kind")

    # classes of equal sets: the smallest id stands for all
    sets = sizes.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(sets.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n")), "classes")
    copies = classes.where("_n > 1").drop("_n")
    same = scratch.save(sets.join(copies, ["d1", "d2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct(), "same")

    # tokens of prefixes that several representatives show
    sketch = spark.sparkContext.broadcast(_sketch(light))
    prefixes = scratch.save(_prefixes(docs, k, sketch), "prefixes")
    shared = prefixes.groupBy("token").agg(F.max_by("doc_id", "score").alias("hub"), F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo < _hi").select("token", "hub")
    # a copy stands for its class's smallest id
    shared = shared.join(same.select(F.col("a").alias("hub"), F.col("b").alias("_rep")), "hub", "left").select("token", F.coalesce("_rep", "hub").alias("hub"))
    shared = scratch.save(shared, "shared")
    posts = prefixes.join(shared, "token").join(same.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")
    posts = scratch.save(posts.select("token", "doc_id", "n", "hub"), "posts")
    scratch.drop("prefixes", "shared")

    # families: each representative asks the group of one hub, that with which it shares most;
    # a token's hub is the most typical of its documents
    near = posts.where("doc_id <> hub").groupBy("doc_id", "hub", "n").agg(F.count("*").alias("c"))
    near = near.groupBy("doc_id", "n").agg(F.max(F.struct("c", (-F.col("hub")).alias("h"))).alias("m")).select("doc_id", "n", "m.c", (-F.col("m.h")).alias("group"))
    near = scratch.save(near, "near")
    hub_sizes = classes.select(F.col("rep").alias("group"), F.col("n").alias("m"))
    best = near.join(hub_sizes, "group").where((F.col("c") >= least_shown(F.col("n"), F.col("m"))) & (OVER * F.least("n", "m") >= SHARE * F.greatest("n", "m")))
    best = scratch.save(best.select("doc_id", F.col("doc_id").alias("component"), "group"), "best")
    hubs = scratch.save(best.select("group").distinct().select(F.col("group").alias("doc_id"), F.col("group").alias("component"), "group"), "hubs")
    whole = scratch.save(_needed_sets(docs, k, best.select("doc_id").unionByName(hubs.select("doc_id"))), "sets")
    stars = scratch.save(open_groups(hubs, best, whole, scratch, "stars"), "stars")
    scratch.drop("sets")
    families = scratch.save(components(stars, scratch, "families"), "families")

    # between families: tokens that meet in different ones
    rows = posts.select("token", "doc_id", "n").join(families.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "doc_id"))
    rows = scratch.save(rows, "labelled")
    mixed = rows.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("token")
    mixed = scratch.save(mixed, "mixed")
    rows = scratch.save(rows.join(mixed, "token"), "meeting")
    scratch.drop("labelled", "mixed", "posts")
    # documents near one hub, linked or not, are a group, or several of a bounded number of members
    docs_in = rows.select("doc_id", "component", "n").distinct().join(near.select("doc_id", F.col("group").alias("_hub")), "doc_id", "left").withColumn("_hub", F.coalesce("_hub", "doc_id"))
    docs_in = scratch.save(docs_in, "clustered")
    # a component that fills groups of its own does so: two groups of one component need no comparison;
    # sizes are joined from tables, so that a hub near very many documents can be split
    large = scratch.save(docs_in.groupBy("_hub", "component").agg(F.count("*").alias("_c")).where(F.col("_c") >= GROUP_MEMBERS).select("_hub", "component", F.lit(True).alias("_own")), "large")
    docs_in = docs_in.join(large, ["_hub", "component"], "left").withColumn("_key", F.xxhash64("_hub", F.when(F.col("_own"), F.col("component"))))
    docs_in = scratch.save(docs_in.select("doc_id", "component", "n", "_key"), "keyed")
    count = scratch.save(docs_in.groupBy("_key").agg(F.ceil(F.count("*") / GROUP_MEMBERS).cast("int").alias("_parts")), "count")
    placed = scratch.save(docs_in.join(count, "_key").select("doc_id", F.xxhash64("_key", F.pmod(F.xxhash64("doc_id"), F.col("_parts"))).alias("group"), "component", "n"), "placed")
    # the matrix: which group shows which token; groups that show one token in common may hold a link
    shows = scratch.save(rows.select("token", "doc_id").join(placed.select("doc_id", "group"), "doc_id").select("token", "group").distinct(), "shows")
    spans = scratch.save(placed.groupBy("group").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("component").alias("c0"), F.max("component").alias("c1")), "spans")
    pairs = shows.join(shows.withColumnRenamed("group", "other"), "token").where("group < other").groupBy("group", "other").agg(F.count("*").alias("c"))
    side = lambda name, tag: spans.select(F.col("group").alias(name), *[F.col(x).alias(f"{x}{tag}") for x in ("lo", "hi", "c0", "c1")])
    pairs = pairs.join(side("group", "a"), "group").join(side("other", "b"), "other").where("NOT (c0a = c1a AND c0b = c1b AND c0a = c0b)")
    pairs = pairs.where((F.col("c") >= least_shown_in(*[F.col(x) for x in ("loa", "hia", "lob", "hib")])) & (OVER * F.col("hia") >= SHARE * F.col("lob")) & (OVER * F.col("hib") >= SHARE * F.col("loa"))).select("group", "other")
    pairs = scratch.save(pairs.unionByName(spans.where("c0 < c1").select("group", F.col("group").alias("other"))), "pairs")
    shown = scratch.save(rows.groupBy("doc_id").agg(F.collect_list("token").alias("tokens")), "shown")
    scratch.drop("shows", "meeting", "clustered", "keyed")
    packs = scratch.save(placed.join(shown, "doc_id").groupBy("group").agg(F.collect_list(F.struct("doc_id", "component", F.col("n").cast("int").alias("n"), "tokens")).alias("members")), "packs")
    passed = scratch.save(screen_groups(packs, pairs, scratch), "passed")
    labels = placed.select("doc_id", "component")
    asks = scratch.save(passed.where("kind = 1").select("doc_id", "group").distinct().join(labels, "doc_id"), "asks")
    members = scratch.save(passed.where("kind = 0").select("doc_id", "group").distinct().join(labels, "doc_id"), "members")
    whole = scratch.save(_needed_sets(docs, k, asks.select("doc_id").unionByName(members.select("doc_id"))), "sets")
    bridges = scratch.save(open_groups(members, asks, whole, scratch, "bridges"), "bridges")
    scratch.drop("sets", "asks", "members", "pairs", "shown", "packs", "passed")

    links = stars.unionByName(bridges).unionByName(same)
    if keys is not None:
        first = keys.groupBy("doc_id").agg(F.min("key").alias("b"))
        links = links.unionByName(keys.join(first, "doc_id").where("key > b").select(F.col("key").alias("a"), "b"))
    found = scratch.save(components(links, scratch, "all").withColumnRenamed("node", "doc_id"), "found")
    out = sizes.join(found, "doc_id", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    if keys is None:
        return out
    # keys ascend with ids, so a component's smallest key has its smallest id
    mine, first = (keys.select(F.col("key").alias(name), F.col("doc_id").alias(f"_{name}")) for name in ("doc_id", "component_id"))
    out = out.join(mine, "doc_id", "left").join(first, "component_id", "left")
    return out.select(F.col("_doc_id").alias("doc_id"), "n_shingles", F.col("_component_id").alias("component_id"))


def without_near_copies(docs: DataFrame, k: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with the same columns.

    Rows with null id, and rows that repeat an id that stays, stay; null and
    empty texts are near to nothing; of ties the smallest id stays; texts of any
    length are compared whole; an empty table gives an empty result; further
    columns, of whatever name, pass through.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-copies")
    found = similar(docs, k, scratch)
    gone = scratch.save(found.where("component_id < doc_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
