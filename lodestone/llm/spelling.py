"""Groups of spelling variants: words one edit apart, found in minimal acyclic automata.

If two words differ by one code point, the half of the longer one that does not
hold the edit stands in both.  Words are dealt by their halves; each task
builds a forward automaton of the words dealt by their beginning and a backward
one of those dealt by their end, walks the half that agrees exactly, and
completes the other with one error.  The automata number their words, so that
what is found is a number, not a string.  Halves that too many words share are
cut again: both halves of the open half in turn, with all the rest agreeing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .letters import _LOWER, Stretch, distinct, latin_mask, stretches, strings
from .textvec import mix

#: A run whose checksum with its document's id this divides loses a code point.
DROP_ONE_IN = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Words are dealt to tasks of about so many; a key that more than KEY_WORDS share is cut again.
TASK_WORDS, KEY_WORDS = 1 << 16, 1 << 15

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def checksums(seeds: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, together: int = 64) -> np.ndarray:
    """crc32 of lower-cased pieces, each continued from a seed; all pieces advance by a byte at a time."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -together) :]  # longer ones are few and go one by one
    out = np.empty(len(size), np.uint32)
    value, at, sizes = ~seeds[order].astype(np.uint32), start[order], size[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        on = int(np.searchsorted(-sizes, -k))  # those longer than k
        value[:on] = _CRC[(value[:on] ^ _LOWER[data[at[:on] + k]]) & np.uint32(0xFF)] ^ (value[:on] >> np.uint32(8))
    out[order] = ~value
    for k in np.flatnonzero(size > together):
        out[k] = zlib.crc32(_LOWER[data[start[k] : end[k]]].tobytes(), int(seeds[k]))
    return out


def _counted(s: Stretch, seeds: np.ndarray) -> pa.RecordBatch | None:
    """The words of the stretch that are long enough, and how often each occurs."""
    first, which = distinct(s.hash, s.text)  # a run shares its fate in all of a text
    times = np.bincount(which)
    start, end = s.start[first], s.end[first]
    points = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum((s.data & 0xC0) != 0x80, out=points[1:])
    length = points[end] - points[start]
    long = length >= MIN_LENGTH
    first, times, start, end, length = (x[long] for x in (first, times, start, end, length))
    if not len(first):
        return None
    crc = checksums(seeds[s.first + s.text[first]], s.data, start, end)
    struck = crc % DROP_ONE_IN == 0
    whole = np.flatnonzero(~struck)
    heads, word = distinct(s.hash[first[whole]])
    n = np.bincount(word, weights=times[whole]).astype(np.int64)
    cut: Counter[str] = Counter()
    for k in np.flatnonzero(struck & (length > MIN_LENGTH)):
        text, gone = _LOWER[s.data[start[k] : end[k]]].tobytes().decode(), int(crc[k]) % int(length[k])
        cut[text[:gone] + text[gone + 1 :]] += int(times[k])
    at = whole[heads]
    words = pa.concat_arrays([strings(s.data, start[at], end[at]), pa.array(list(cut), pa.string())])
    return pa.RecordBatch.from_arrays([words, pa.array(np.concatenate([n, np.fromiter(cut.values(), np.int64, len(cut))]))], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the words of at least MIN_LENGTH code points and MIN_COUNT occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = np.array([zlib.crc32(f"{k}:".encode()) for k in batch.column(0).to_pylist()], np.uint32)
            for s in stretches(batch.column(1), latin_mask):
                found = _counted(s, seeds)
                if found is not None:
                    yield found

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


class Automaton:
    """Minimal acyclic automaton of sorted, distinct byte strings; each word's number is its place among them."""

    def __init__(self, words: list[bytes]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        offset = np.cumsum(size) - size
        # the tree of beginnings, depth by depth: in sorted order equal beginnings stand together
        node, active, nodes = np.zeros(len(words), np.int64), np.arange(len(words)), 1
        parents, chars, firsts, ends = [], [], [], [active[size == 0] * 0]
        depth = 0
        while True:
            active = active[size[active] > depth]
            if not len(active):
                break
            above, char = node[active], data[offset[active] + depth]
            new = np.ones(len(active), bool)
            new[1:] = (above[1:] != above[:-1]) | (char[1:] != char[:-1])
            node[active] = nodes + np.cumsum(new) - 1
            parents.append(above[new])
            chars.append(char[new].astype(np.int64))
            firsts.append(nodes)
            nodes += int(new.sum())
            depth += 1
            ends.append(node[active[size[active] == depth]])
        final = np.zeros(nodes, bool)
        final[np.concatenate(ends)] = True
        # from the leaves up: nodes of equal continuations are one state, and each knows how many words go on from it
        content, count = mix(final.astype(np.uint64) + np.uint64(7)), final.astype(np.int64)
        for above, char, first in zip(reversed(parents), reversed(chars), reversed(firsts)):
            below = slice(first, first + len(above))
            content[below] = mix(content[below])
            np.add.at(content, above, mix(content[below] + char.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            np.add.at(count, above, count[below])
        content[0] = mix(content[:1])[0]
        _, keep, state = np.unique(content, return_index=True, return_inverse=True)
        self.start, self.final = int(state[0]), final[keep]
        above = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        char, child = (np.concatenate(chars) if chars else above), np.arange(1, nodes)
        kept = np.zeros(nodes, bool)
        kept[keep] = True
        of = kept[above]
        above, char, child = state[above[of]], char[of], child[of]
        order = np.argsort(above * 256 + char)
        above, child = above[order], child[order]
        self.char = char[order]
        self.key = above * 256 + self.char
        self.next, words_below = state[child], count[child]
        self.first = np.searchsorted(above, np.arange(len(keep) + 1))
        # a word's number: the words that end on its way and those of the edges before its own
        upto = np.cumsum(words_below) - words_below
        self.skip = upto - upto[self.first[above]] + self.final[above] if len(above) else upto

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states go on with the char, and by which edge."""
        key = state * 256 + char
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        ok = np.flatnonzero(self.key[at] == key) if len(self.key) else np.zeros(0, np.int64)
        return ok, at[ok]

    def one_error(self, words: list[bytes], low: np.ndarray, high: np.ndarray, last_of_run: bool) -> tuple[np.ndarray, np.ndarray]:
        """(which, number): words of the automaton that a word becomes by one replacement or deletion in low <= place < high.

        Bytes are replaced by greater ones, and of a run of equal bytes only the
        last one is deleted (or the first one), so that each pair is found once.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        offset = np.cumsum(size) - size
        exact = (np.arange(len(words)), np.full(len(words), self.start), np.zeros(len(words), np.int64))
        wrong = tuple(np.zeros(0, np.int64) for _ in range(3))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        t = 0

        def over(items: tuple, t: int) -> tuple:
            """Those that go on with their word's byte at t."""
            ok, edge = self.step(items[1], data[offset[items[0]] + t])
            return items[0][ok], self.next[edge], items[2][ok] + self.skip[edge]

        while len(exact[0]) or len(wrong[0]):
            done = size[wrong[0]] == t
            ended = done & self.final[wrong[1]]
            found.append((wrong[0][ended], wrong[2][ended]))
            wrong = over(tuple(x[~done] for x in wrong), t)
            open_ = high[exact[0]] > t
            exact = tuple(x[open_] for x in exact)
            if len(exact[0]):
                here = low[exact[0]] <= t
                q, state, number = (x[here] for x in exact)
                at = offset[q] + t
                beside = np.where(size[q] > t + 1, data[at + 1], -1) if last_of_run else (data[at - 1] if t else np.full(len(q), -1))
                gone = beside != data[at]
                many = self.first[state + 1] - self.first[state]
                edge = np.arange(many.sum()) + np.repeat(self.first[state] - (np.cumsum(many) - many), many)
                q2, n2 = np.repeat(q, many), np.repeat(number, many)
                other = self.char[edge] > data[offset[q2] + t]
                more = (np.concatenate([q[gone], q2[other]]), np.concatenate([state[gone], self.next[edge[other]]]), np.concatenate([number[gone], (n2 + self.skip[edge])[other]]))
                wrong = tuple(np.concatenate(x) for x in zip(wrong, more))
                exact = over(exact, t)
            t += 1
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_pairs(words: list[bytes], query: np.ndarray, backward: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Sorted distinct words, and the places of the two of each pair; row k asks for its word if ``query``."""
    names = sorted(set(words))
    place = {w: k for k, w in enumerate(names)}
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for back in (False, True):
        mine = np.flatnonzero(backward == back)
        if not len(mine):
            continue
        turned = (lambda w: w[::-1]) if back else (lambda w: w)
        held = sorted({turned(words[k]) for k in mine})
        asked = mine[query[mine]]
        texts = [turned(words[k]) for k in asked]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        a, b = (size - high[asked], size - low[asked]) if back else (low[asked], high[asked])
        which, number = Automaton(held).one_error(texts, a, b, not back)
        of_query = np.fromiter((place[words[k]] for k in asked), np.int64, len(asked))
        of_number = np.fromiter((place[turned(w)] for w in held), np.int64, len(held))
        left.append(of_query[which])
        right.append(of_number[number])
    return names, np.concatenate(left), np.concatenate(right)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, best_n, best: what a task's pairs say about each word in them."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    n, query, backward, low, high = (table.column(c).to_numpy() for c in ("n", "query", "backward", "low", "high"))
    names, left, right = near_pairs(words, query, backward, low.astype(np.int64), high.astype(np.int64))
    count_of = dict(zip(words, n.tolist()))
    count = np.fromiter((count_of[w] for w in names), np.int64, len(names))
    target, other = np.concatenate([left, right]), np.concatenate([right, left])
    if not len(target):
        return
    order = np.lexsort((other, -count[other], target))
    target, other = target[order], other[order]
    heads = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    near = np.diff(np.append(heads, len(target)))
    text = lambda places: pa.array([names[k].decode("latin-1") for k in places], pa.string())
    yield pa.RecordBatch.from_arrays([text(target[heads]), pa.array(near), pa.array(count[other[heads]]), text(other[heads])], names=["word", "n_near", "best_n", "best"])


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    """rows (word, n, length, more, part) with low, high and key: all but places low to high of a word of length + more."""
    cuts = 2 ** (level + 1)
    size = F.col("length") + F.col("more")
    at = lambda whole, part: F.floor(whole * part / F.lit(cuts)).cast("int")

    def key(whole):
        low, high = at(whole, F.col("part")), at(whole, F.col("part") + 1)
        return F.xxhash64(F.lit(level), "part", F.substring("word", F.lit(1), low), F.substring("word", F.col("length") - (whole - high) + 1, whole - high))

    rows = rows.select("word", "n", "length", "more", "part", at(size, F.col("part")).alias("low"), at(size, F.col("part") + 1).alias("high"), key(size).alias("key"), F.when(at(F.col("length"), F.col("part")) < at(F.col("length"), F.col("part") + 1), key(F.col("length"))).alias("own"))
    return rows.where("low < high").withColumn("backward", F.col("part") < cuts // 2)


def dealt(words: DataFrame, scratch: Scratch, most: int = KEY_WORDS) -> DataFrame:
    """Each word by what stays of it: as a query of its own length, and as an answer to words of the same length or one longer."""
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("more"), F.lit(p).alias("part")) for m in (0, 1) for p in (0, 1)]))
    rows, cold, level = _keyed(words.select("word", "n", F.char_length("word").alias("length"), both.alias("_e")).select("word", "n", "length", "_e.*"), 0), None, 0
    while True:
        # one open place cannot be cut: the letters that may stand there bound what shares its key
        hot = scratch.save(rows.where("high - low > 1").groupBy("key").count().where(F.col("count") > most).select("key"), f"hot-{level}")
        last = hot.isEmpty()
        wide = F.col("high") - F.col("low") > 1
        done = rows if last else rows.where(~wide).unionByName(rows.where(wide).join(hot, "key", "left_anti"))
        # a word is one answer, though it may answer both lengths
        done = done.where("more = 0 OR NOT key <=> own").select("word", "n", (F.col("more") == 0).alias("query"), "backward", "low", "high", "key")
        cold = done if cold is None else cold.unionByName(done)
        if last:
            return cold
        cut = rows.where(wide).join(hot, "key", "left_semi")
        halves = cut.select("word", "n", "length", "more", F.explode(F.array(2 * F.col("part"), 2 * F.col("part") + 1)).alias("part"))
        level += 1
        rows = scratch.save(_keyed(halves, level), f"level-{level}")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root for words with a form: each step doubles the way that has been followed (counts double by form, so ways are short)."""
    step, k = scratch.save(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "way-0"), 0
    while True:
        k += 1
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = scratch.save(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"way-{k}")
        step = found.select("word", "root")
        if found.where("moved").isEmpty():
            return step


def variants(docs: DataFrame, scratch: Scratch | None = None, task_words: int = TASK_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    Null and empty texts have no words; very long texts and words are read
    whole; repeated rows count again; a null id makes the checksum of an empty
    one.  Ties of the form go to the word smallest in code-point order.  An empty
    table gives an empty result; columns other than doc_id and text are not
    read.  Equal runs are found by 64-bit hashes.
    """
    scratch = scratch or Scratch(docs.sparkSession, "spelling")
    words = scratch.save(word_counts(docs), "words")
    rows = dealt(words, scratch, key_words)
    tasks = max(1, -(-3 * words.count() // task_words))
    near = rows.repartition(tasks, "key").drop("key").mapInArrow(_near, "word string, n_near long, best_n long, best string")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("best_n"), "best")).alias("top"))
    has = -F.col("top.best_n") >= 2 * F.col("n")
    forms = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("top.best")).alias("form"), F.when(has, -F.col("top.best_n")).alias("form_n"))
    forms = scratch.save(forms, "forms")
    return forms.join(_roots(forms, scratch), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


VARIANTS_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
u AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w
  FROM documents),
p AS (SELECT id, w, count(*) AS k, hex(encode(id || ':' || w)) AS x FROM u WHERE length(w) >= 5 GROUP BY id, w),
h AS (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT)), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM p, t),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, k FROM h),
words AS MATERIALIZED (SELECT w, sum(k)::BIGINT AS n FROM v WHERE length(w) >= 5 GROUP BY w HAVING sum(k) >= 3),
less AS MATERIALIZED (SELECT w, n, unnest(range(length(w))) AS i FROM words),
gone AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i) || substr(w, i + 2) AS g FROM less),
swapped AS (SELECT a.w AS w, b.w AS o, b.n AS o_n FROM gone a JOIN gone b ON a.g = b.g AND a.i = b.i AND a.w <> b.w),
shorter AS (SELECT DISTINCT gone.w AS w, words.w AS o, gone.n AS w_n, words.n AS o_n FROM gone JOIN words ON gone.g = words.w),
near AS (SELECT w, o, o_n FROM swapped UNION ALL SELECT w, o, o_n FROM shorter UNION ALL SELECT o, w, w_n FROM shorter),
best AS (SELECT w, count(*) AS n_near, first(o ORDER BY o_n DESC, o) AS o, max(o_n) AS o_n FROM near GROUP BY w),
f AS MATERIALIZED (
  SELECT words.w, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN o_n >= 2 * n THEN o END AS form, CASE WHEN o_n >= 2 * n THEN o_n END AS form_n
  FROM words LEFT JOIN best ON words.w = best.w),
way AS (
  SELECT w, w AS at FROM f
  UNION ALL
  SELECT way.w, f.form FROM way JOIN f ON way.at = f.w WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, way.at AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM f JOIN way ON f.w = way.w JOIN f l ON way.at = l.w AND l.form IS NULL
"""
