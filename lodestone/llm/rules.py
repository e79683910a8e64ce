"""Quality rules as learned decision lists.

Sequential covering: a rule is grown as a conjunction of thresholds on text
statistics, by information gain on one part of the labelled rows, and pruned
on the other; the rows that it covers are taken out and the next rule is
grown.  The list becomes one ordered ``CASE WHEN`` expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import Words, piece_hashes, runs

#: Labelled rows that the list is learned from, at most: those of smallest key hash.
MAX_LABELLED = 50_000
MIN_WORDS = 50

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules compare: name -> expression over the statistics (SQL, guarded against division by zero).
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _again(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal another of the same text, and which of those an earlier one."""
    order = np.lexsort((np.arange(len(value)), value, text))
    equal = (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])
    some, later = np.zeros(len(value), bool), np.zeros(len(value), bool)
    later[order[1:][equal]] = True
    some[order[1:][equal]] = some[order[:-1][equal]] = True
    return some, later


def statistics_of(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each whole text of an Arrow column (null: no words)."""
    out = [np.zeros((0, len(STATISTICS)), np.int64)]
    for i, j, data, offsets in runs(column):
        words, texts = Words(data, offsets, False), j - i
        per_text = lambda text, some: np.bincount(text[some], minlength=texts)
        point = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=point[1:])  # code points begin at other bytes than these
        chars = np.bincount(words.text, weights=point[words.end] - point[words.start], minlength=texts)
        symbol = np.searchsorted(offsets, np.flatnonzero(_SYMBOL[data]), side="right") - 1
        breaks = np.flatnonzero(data == 10)
        # a line ends at a break or where its text does
        start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        start = start[start < len(data)]
        end = np.minimum(np.append(start[1:], len(data)), offsets[np.searchsorted(offsets, start, side="right")])
        end = end - (data[end - 1] == 10)
        said = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
        start, end = start[said], end[said]
        line = np.searchsorted(offsets, start, side="right") - 1
        gram, first = words.grams(3)
        often = first[_again(words.text[first], gram)[0]]
        marked = np.zeros(len(words.hash), bool)
        for k in range(3):
            marked[often + k] = True
        doubled = _again(line, piece_hashes(data, start, end, False))[1]
        out.append(np.stack([words.count, chars.astype(np.int64), np.bincount(symbol, minlength=texts), per_text(line, doubled), per_text(words.text, marked)], axis=1))
    return np.concatenate(out)


def text_statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    return tuple(statistics_of(pa.array([text], pa.string()))[0].tolist())


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of each row's text (null: no words)."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(STATISTICS)))], names=["doc_id", *STATISTICS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{s} long" for s in STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class Rule:
    """All of (feature, "<=" or ">", threshold) -> reject or keep; with what it covered when learned."""

    terms: list[tuple[str, str, float]]
    reject: bool
    covered: int = 0
    right: int = 0

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(rows.values()))), bool)
        for name, op, cut in self.terms:
            out &= rows[name] <= cut if op == "<=" else rows[name] > cut
        return out

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[n]} {op} {cut!r}D)" for n, op, cut in self.terms) or "true"


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)
    #: The verdict where no rule holds.
    keep_else: bool = True

    def kept(self) -> Column:
        """The ordered conditional expression; first rule that holds decides."""
        out = None
        for r in self.rules:
            out = (F if out is None else out).when(F.expr(r.sql()), F.lit(not r.reject))
        return F.lit(self.keep_else) if out is None else out.otherwise(F.lit(self.keep_else))

    def predict(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        keep = np.full(len(next(iter(rows.values()))), self.keep_else)
        open_ = np.ones(len(keep), bool)
        for r in self.rules:
            hit = r.holds(rows) & open_
            keep[hit] = not r.reject
            open_ &= ~hit
        return keep


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First-order gain of going from (p0, n0) covered to (p, n)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> list[tuple[str, str, float]]:
    """Terms, each the cut of greatest gain, until only bad rows are covered or no cut gains."""
    inside, terms = np.ones(len(bad), bool), []
    while len(terms) < most:
        y = bad[inside]
        p0, n0 = int(y.sum()), int((~y).sum())
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for name in sorted(rows):
            x = rows[name][inside]
            order = np.argsort(x, kind="stable")
            x, pos = x[order], np.cumsum(y[order])
            ends = np.flatnonzero(x[1:] > x[:-1])
            if not len(ends):
                continue
            p, n = pos[ends], ends + 1 - pos[ends]
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                gain = _gain(p0, n0, pp, nn)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (name, op, float((x[ends[k]] + x[ends[k] + 1]) / 2)))
        if best[1] is None:
            break
        terms.append(best[1])
        name, op, cut = best[1]
        inside &= rows[name] <= cut if op == "<=" else rows[name] > cut
    return terms


def _prune(terms: list, rows: dict[str, np.ndarray], bad: np.ndarray) -> list:
    """The prefix of the terms that is worth most on rows not used to grow it."""

    def worth(t: list) -> float:
        hit = Rule(t, True).holds(rows)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((terms[:k] for k in range(len(terms), 0, -1)), key=worth, default=[])


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, turn: np.ndarray, precision: float = 0.9, most_rules: int = 16) -> DecisionList:
    """A decision list that rejects what its rules cover; ``turn`` (0..2): 2 prunes, the others grow.

    A rule is kept only if at least ``precision`` of what it covers is bad, in
    the growing and in the pruning part, so that good rows stay.
    """
    out, left = DecisionList(), np.ones(len(bad), bool)
    for _ in range(most_rules):
        g, p = left & (turn != 2), left & (turn == 2)
        if not (bad & g).any():
            break
        part = lambda m: {k: v[m] for k, v in rows.items()}
        terms = _prune(_grow(part(g), bad[g]), part(p), bad[p])
        if not terms:
            break
        rule = Rule(terms, True)
        hit = rule.holds(rows) & left
        covered, right = int(hit.sum()), int((hit & bad).sum())
        held = [(int((hit & m).sum()), int((hit & m & bad).sum())) for m in (g, p)]
        if covered < 3 or any(c and r < precision * c for c, r in held):
            break
        rule.covered, rule.right = covered, right
        out.rules.append(rule)
        left &= ~hit
    return out


def labelled_rows(stats: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Features, bad and turn of at most ``bound`` labelled rows that pass the base rules."""
    names = list(FEATURES)
    wanted = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rank = F.xxhash64("doc_id")
    rows = stats.where(~base_failed()).join(wanted, "doc_id").select("doc_id", "quality", rank.alias("_h"), *[F.expr(FEATURES[n]).alias(n + "_f") for n in names])
    got = rows.orderBy("_h", "doc_id").limit(bound).toPandas()
    return {n: got[n + "_f"].to_numpy(float) for n in names}, got["quality"].to_numpy() == 0, (got["_h"].to_numpy().astype(np.int64) % 3)


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, **options) -> DecisionList:
    """Learn from the labelled rows only: their texts alone are read for it.

    At most ``bound`` labels are used, those of smallest key hash.
    """
    few = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(bound)
    wanted = few.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left_semi")  # at most ``bound`` numbers
    rows, bad, turn = labelled_rows(with_statistics(texts), few, bound)
    return learn(rows, bad, turn, **options) if len(bad) else DecisionList()


def quality_verdicts(docs: DataFrame, labels: DataFrame, rules: DecisionList | None = None) -> DataFrame:
    """doc_id, the STATISTICS, base_failed and kept of every row.

    Null or empty text: no words, so it fails the base; very long texts are
    counted whole.  Without labels the list is empty and every row that passes
    the base is kept; of labels that contradict each other the lower counts.
    Repeated rows get the same verdict, ties take the first rule that holds, an
    empty table gives an empty result; columns other than doc_id and text are
    not read.
    """
    rules = rules if rules is not None else train(docs, labels)
    out = with_statistics(docs).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & rules.kept())


def quality_documents(docs: DataFrame, labels: DataFrame, rules: DecisionList | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with the same columns and values, in one pass without a join.

    Null, empty and very long texts, repeated rows, empty tables and missing
    labels are judged as by ``quality_verdicts``; further columns, of whatever
    name, pass through.
    """
    rules = rules if rules is not None else train(docs, labels)
    at, held = docs.columns.index("text"), [f"c{k}" for k in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics_of(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, k]) for k in range(len(STATISTICS)))], names=[*held, *STATISTICS])

    # columns go by their place, so that none clashes with a statistic
    schema = T.StructType([*(T.StructField(h, f.dataType) for h, f in zip(held, docs.schema.fields)), *(T.StructField(x, T.LongType()) for x in STATISTICS)])
    rows = docs.mapInArrow(run, schema).where(~base_failed() & rules.kept())
    return rows.select(*[F.col(h).alias(c) for h, c in zip(held, docs.columns)])
