"""Toxic spans by a linear-chain conditional random field.

Labels stand on documents only, so tokens are labelled first: in toxic
documents, those whose word or beginning is significantly more frequent there
than in clean ones.  A field of two states is fitted on labelled stretches of
tokens.  Its forward-backward marginals mark spans in every whole text, and
their sum, maximum and the text's length give the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .letters import Stretch, distinct, gathered, stretches, strings, wide_mask
from .textvec import mix, piece_hashes

#: Labelled rows that are learned from, at most: those of smallest key hash.
MAX_LABELLED = 16_384
#: Stretches of SEGMENT tokens that the field is fitted on, at most, with and without toxic tokens.
SEGMENT, WITH_TOXIC, WITHOUT = 64, 4096, 8192
#: Words and beginnings that label tokens, at most: those of greatest likelihood ratio.
MAX_CUES = 65_536
#: A cue's least likelihood ratio, and the least share of its documents that are toxic.
LEAST_RATIO, LEAST_SHARE = 12.0, 0.8
#: Bytes of the beginnings and ends of words that are features.
BEGINNINGS, ENDS = (3, 4, 5, 6, 7, 8, 9), (3, 4, 5)
#: Bytes of text that are tagged together (a longer text is one chain of its own).
TOGETHER = 2 << 20
#: Hash buckets of features.
BUCKETS = 1 << 18
#: One in so many documents is held out of learning.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass
class Words:
    """The distinct words of a stretch: their lower-cased bytes, hash, and which of them each token is."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    token: np.ndarray

    @classmethod
    def of(cls, s: Stretch) -> Words:
        first, token = distinct(s.hash)
        data, offsets = gathered(s.data, s.start[first], s.end[first])
        return cls(data, offsets[:-1], offsets[1:], s.hash[first], token)

    def parts(self) -> np.ndarray:
        """A row of hashes for each word: itself, its beginnings, its ends (0 where it is not longer)."""
        size, out = self.end - self.start, [self.hash]
        for k in BEGINNINGS:
            out.append(np.where(size > k, mix(piece_hashes(self.data, self.start, np.minimum(self.start + k, self.end), False) + np.uint64(k)), np.uint64(0)))
        for k in ENDS:
            out.append(np.where(size > k, mix(piece_hashes(self.data, np.maximum(self.end - k, self.start), self.end, False) + np.uint64(100 + k)), np.uint64(0)))
        return np.stack(out, axis=1)


def buckets(parts: np.ndarray) -> np.ndarray:
    """The features of a word: one for each part, one as left and one as right neighbour."""
    beside = np.stack([mix(parts[:, 0] + np.uint64(k)) for k in (1001, 1002)], axis=1)
    return (np.concatenate([parts, beside], axis=1) % np.uint64(BUCKETS)).astype(np.int32)


#: Parts of a word that may be cues: itself and its beginnings from the second on.
_CUES = [0, *range(2, 1 + len(BEGINNINGS))]


def cues(rows: DataFrame) -> np.ndarray:
    """rows: text, toxic -> sorted hashes of the parts that toxic documents hold significantly more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for s in stretches(batch.column(0), wide_mask, TOGETHER):
                words = Words.of(s)
                pair, _ = distinct(words.token, s.text)
                parts = words.parts()[:, _CUES]
                key, doc = parts[words.token[pair]].ravel(), np.repeat(s.text[pair] + s.first, len(_CUES))
                key, doc = key[key != 0], doc[key != 0]
                once, _ = distinct(key, doc)
                key, bad = key[once], toxic[doc[once]]
                some, which = np.unique(key, return_inverse=True)
                t = np.bincount(which, weights=bad, minlength=len(some))
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(t.astype(np.int64)), pa.array((np.bincount(which, minlength=len(some)) - t).astype(np.int64))], names=["cue", "t", "c"])

    sizes = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    toxic, clean = int(sizes["t"]), int(sizes["n"] - sizes["t"])
    if not toxic or not clean:
        return np.zeros(0, np.uint64)
    found = rows.select("text", "toxic").mapInArrow(run, "cue long, t long, c long").groupBy("cue").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    part = F.col("t") + F.col("c")
    rate = toxic / (toxic + clean)
    # the likelihood ratio of "toxic documents hold it at another rate" against "at the same"
    log = lambda x, base: F.when(x > 0, x * F.log(x / base)).otherwise(0.0)
    absent_t, absent_c, absent = toxic - F.col("t"), clean - F.col("c"), (toxic + clean) - part
    ratio = 2 * (log(F.col("t"), part * rate) + log(F.col("c"), part * (1 - rate)) + log(absent_t, absent * rate) + log(absent_c, absent * (1 - rate)))
    found = found.where(F.col("t") >= LEAST_SHARE * part).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    got = found.orderBy(F.col("ratio").desc(), "cue").limit(MAX_CUES).select("cue").toPandas()
    return np.sort(got["cue"].to_numpy(np.int64).view(np.uint64))


def segments(rows: DataFrame, marks: np.ndarray) -> DataFrame:
    """rows: doc_id, text, toxic -> stretches of at most SEGMENT tokens: place, text, and a label (int8) for each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for s in stretches(batch.column(1), wide_mask, TOGETHER):
                if not len(s.text):
                    continue
                words = Words.of(s)
                marked = np.isin(words.parts()[:, _CUES], marks).any(axis=1)
                label = (marked[words.token] & toxic[s.first + s.text]).astype(np.int8)
                edge = np.append(True, s.text[1:] != s.text[:-1])
                begin = np.flatnonzero(edge)
                place = np.arange(len(edge)) - begin[np.cumsum(edge) - 1]
                cut = np.flatnonzero(place % SEGMENT == 0)
                ends = np.append(cut[1:], len(edge))
                text = strings(s.data, s.start[cut], s.end[ends - 1])
                labels = pa.array([label[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())
                docs = batch.column(0).take(pa.array(s.first + s.text[cut]))
                yield pa.RecordBatch.from_arrays([docs, pa.array(place[cut]), text, labels, pa.array(np.maximum.reduceat(label, cut) > 0)], names=["doc_id", "place", "text", "labels", "some"])

    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "toxic").mapInArrow(run, "doc_id string, place long, text string, labels binary, some boolean")


@dataclass
class Field:
    """Log odds of "toxic" by feature, and log weights of the first state and of each step; state 1 is toxic."""

    weights: np.ndarray
    start: np.ndarray
    steps: np.ndarray
    #: Of the document's score: constant, log of the sum of marginals, greatest marginal, log of the length.
    document: np.ndarray

    def marginals(self, words: Words, text: np.ndarray) -> np.ndarray:
        """The probability of state 1 of each token; tokens of one text (consecutive) are one chain."""
        if not len(text):
            return np.zeros(0)
        edge = np.append(True, text[1:] != text[:-1])
        odds = log_odds(words.token, ~edge[1:], self.weights[buckets(words.parts())])
        e, a, s = np.exp(np.clip(odds, -30, 30)), np.exp(self.steps), np.exp(self.start)
        one = np.ones(len(e))
        # the odds of the states before and at a token, then those of what follows; a text's first token forgets what was before it
        ahead = odds_along(np.where(edge, 0, e * a[1, 1]), e * np.where(edge, s[1], a[0, 1]), np.where(edge, 0, a[1, 0]), np.where(edge, s[0], a[0, 0]), 1.0)
        next_, e_next = np.append(edge[1:], True), np.append(e[1:], 1.0)
        behind = odds_along(*(x[::-1] for x in (np.where(next_, 0, a[1, 1] * e_next), np.where(next_, one, a[1, 0]), np.where(next_, 0, a[0, 1] * e_next), np.where(next_, one, a[0, 0]))), 1.0)[::-1]
        both = ahead * behind
        return both / (1 + both)


def log_odds(token: np.ndarray, goes_on: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What a token's word (row of weights) and the words beside it in the same text say of it."""
    odds = weights[:, :-2].sum(axis=1)[token]
    odds[1:] += weights[token[:-1], -2] * goes_on
    odds[:-1] += weights[token[1:], -1] * goes_on
    return odds


def odds_along(p: np.ndarray, q: np.ndarray, s: np.ndarray, u: np.ndarray, first: float) -> np.ndarray:
    """r[t] = (p[t] r[t-1] + q[t]) / (s[t] r[t-1] + u[t]), exactly, by runs of about sqrt(n) that advance together."""
    n = len(p)
    size = max(1, int(np.sqrt(n)))
    count = -(-n // size)
    pad = count * size - n
    p, q, s, u = (np.concatenate([x, np.full(pad, v)]).reshape(count, size).T.copy() for x, v in ((p, 1.0), (q, 0.0), (s, 0.0), (u, 1.0)))
    # what each run does to the odds it is given, then what each is given
    a, b, c, d = np.ones(count), np.zeros(count), np.zeros(count), np.ones(count)
    for t in range(size):
        a, b, c, d = p[t] * a + q[t] * c, p[t] * b + q[t] * d, s[t] * a + u[t] * c, s[t] * b + u[t] * d
        whole = a + b + c + d
        a, b, c, d = a / whole, b / whole, c / whole, d / whole
    given, r = np.empty(count), first
    for k, (x, y, z, w) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        given[k] = r
        r = min(max((x * r + y) / (z * r + w), 1e-30), 1e30)
    out, r = np.empty((size, count)), given
    for t in range(size):
        r = (p[t] * r + q[t]) / (s[t] * r + u[t])
        out[t] = r
    return out.T.ravel()[:n]


def fit(words: Words, text: np.ndarray, labels: np.ndarray, steps: int = 80, rate: float = 0.15, penalty: float = 1.0) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over all texts at once; a label for each token."""
    _, row = np.unique(text, return_inverse=True)
    size = np.bincount(row)
    n, longest, token = len(size), int(size.max()), words.token
    col, goes_on = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), (row[1:] == row[:-1]).astype(float)
    ids = buckets(words.parts())
    used, ids = np.unique(ids, return_inverse=True)
    ids = ids.reshape(-1, 3 + len(BEGINNINGS) + len(ENDS))
    y = np.zeros((n, longest), np.int8)
    y[row, col] = labels
    inside = np.arange(longest)[None, :] < size[:, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
    begun = np.bincount(y[:, 0], minlength=2).astype(float)
    each = lambda values, at: np.bincount(at, weights=values, minlength=len(ids))
    x = np.zeros(len(used) + 6)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, start, move = x[: len(used)], x[-6:-4], x[-4:].reshape(2, 2)
        e = np.ones((n, longest))
        e[row, col] = np.exp(np.clip(log_odds(token, goes_on, w[ids]), -30, 30))
        a = np.exp(move)
        ahead = np.empty((longest, n, 2))
        now = np.stack([np.full(n, np.exp(start[0])), np.exp(start[1]) * e[:, 0]], axis=1)
        ahead[0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, longest):
            now = ahead[t - 1] @ a
            now[:, 1] *= e[:, t]
            ahead[t] = np.where(inside[:, t, None], now / now.sum(axis=1, keepdims=True), ahead[t - 1])
        back, pairs = np.ones((n, 2)), np.zeros((2, 2))
        p = np.zeros((n, longest))
        for t in range(longest - 1, -1, -1):
            both = ahead[t] * back
            p[:, t] = both[:, 1] / both.sum(axis=1)
            if t:
                what = back.copy()
                what[:, 1] *= e[:, t]
                joint = ahead[t - 1][:, :, None] * a[None] * what[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                pairs += joint[inside[:, t]].sum(axis=0)
                before = what @ a.T
                back = np.where(inside[:, t, None], before / before.sum(axis=1, keepdims=True), back)
        wrong = (p - y)[row, col]
        of_word = np.repeat(each(wrong, token)[:, None], ids.shape[1], axis=1)
        of_word[:, -2], of_word[:, -1] = each(wrong[1:] * goes_on, token[:-1]), each(wrong[:-1] * goes_on, token[1:])
        g = np.empty_like(x)
        g[: len(used)] = np.bincount(ids.ravel(), weights=of_word.ravel(), minlength=len(used)) + penalty * w
        g[-6:-4] = np.array([n - p[:, 0].sum(), p[:, 0].sum()]) - begun + penalty * start
        g[-4:] = (pairs - seen).ravel() + penalty * move.ravel()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(BUCKETS)
    weights[used] = x[: len(used)]
    return Field(weights, x[-6:-4].copy(), x[-4:].reshape(2, 2).copy(), np.zeros(4))


def _summed(p: np.ndarray, text: np.ndarray, rows: int) -> np.ndarray:
    """A row of inputs of the document's score for each text."""
    most = np.zeros(rows)
    np.maximum.at(most, text, p)
    return np.stack([np.ones(rows), np.log(np.bincount(text, weights=p, minlength=rows) + 0.01), most, np.log1p(np.bincount(text, minlength=rows))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 50) -> np.ndarray:
    """Coefficients of a penalised logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        change = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w = w - change
        if np.abs(change).max() < 1e-8:
            break
    return w


def tagged(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, spans (start and end in code points, score: greatest marginal) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _summed(np.zeros(0), np.zeros(0, np.int64), batch.num_rows)
            of, first, last, best = ([np.zeros(0, np.int64)] for _ in range(4))
            for s in stretches(batch.column(1), wide_mask, TOGETHER):
                p = field.marginals(Words.of(s), s.text)
                x[s.first : s.first + s.rows] = _summed(p, s.text, s.rows)
                # runs of toxic tokens, in code points from their text's start
                hit = p >= 0.5
                if not hit.any():
                    continue
                edge = np.append(True, s.text[1:] != s.text[:-1])
                opens = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
                closes = np.flatnonzero(hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False)))
                point = np.zeros(len(s.data) + 1, np.int64)
                np.cumsum((s.data & 0xC0) != 0x80, out=point[1:])
                zero = point[s.text_start[s.text[opens]]]
                of.append(s.first + s.text[opens])
                first.append(point[s.start[opens]] - zero)
                last.append(point[s.end[closes]] - zero)
                best.append(np.maximum.reduceat(p, np.stack([opens, closes + 1], axis=1).ravel()[: 2 * len(opens) - (closes[-1] + 1 >= len(p))])[::2])
            score = 1 / (1 + np.exp(-np.clip(x @ field.document, -30, 30)))
            of, first, last, best = (np.concatenate(v) for v in (of, first, last, best))
            offsets = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(first), pa.array(last), pa.array(best.astype(float))], names=["start", "end", "score"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), spans], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start: long, end: long, score: double>>")


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, bound: int = MAX_LABELLED) -> Field | None:
    """A field and its document score, from at most ``bound`` labelled rows outside the held-out fold; None without both labels.

    Of labels that contradict each other the higher counts; of texts of one id
    the first in order.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # at most ``bound`` numbers are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = scratch.save(rows, "labelled")
    marks = cues(rows)
    if not len(marks):
        return None
    parts = scratch.save(segments(rows, marks), "segments")
    order = [F.xxhash64("doc_id", "place"), F.col("doc_id"), F.col("place")]
    got = parts.where("some").orderBy(*order).limit(WITH_TOXIC).unionByName(parts.where("NOT some").orderBy(*order).limit(WITHOUT)).select("text", "labels").toPandas()
    [stretch] = stretches(pa.array(got["text"], pa.string()), wide_mask, 1 << 62)
    field = fit(Words.of(stretch), stretch.text, np.frombuffer(b"".join(got["labels"]), np.int8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _summed(np.zeros(0), np.zeros(0, np.int64), batch.num_rows)
            for s in stretches(batch.column(0), wide_mask, TOGETHER):
                x[s.first : s.first + s.rows] = _summed(field.marginals(Words.of(s), s.text), s.text, s.rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(4)), batch.column(1)], names=["a", "b", "c", "d", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(run, "a double, b double, c double, d double, toxic int").toPandas()
    seen = seen.sort_values(list(seen.columns))  # sums do not depend on the order of tasks
    field.document = logistic(seen[["a", "b", "c", "d"]].to_numpy(), seen["toxic"].to_numpy(float))
    return field


def toxic_spans(docs: DataFrame, labels: DataFrame, field: Field | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every row.

    Null and empty texts have no tokens and no spans, and the score of a text
    without toxic tokens; very long texts are one chain and read whole; rows of
    equal text have equal scores.  A null id counts as an empty one for the fold.
    Without labels of both kinds all scores are 0.  An empty table gives an empty
    result; columns other than doc_id and text are not read.
    """
    field = field or train(docs, labels, scratch) or Field(np.zeros(BUCKETS), np.array([0.0, -30.0]), np.array([[0.0, -30.0], [0.0, -30.0]]), np.array([-30.0, 0, 0, 0]))
    out = tagged(docs, field).withColumn("held_out", held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans")
