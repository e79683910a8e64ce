"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary: all words of the
corpus and the end of a text.  Both are smoothed alike, towards their unigrams:

    p(word | before) = (c(before, word) + MU * p(word)) / (c(before) + MU)
    p(word) = (c(word) + 1) / (words + vocabulary)

As every word is followed by another or by the end, c(before) is the word's own
count, so a document's loss is a sum of terms that need only a bigram's and its
second word's counts.  The tokens of blocks of documents are therefore dealt
once, by word, to groups that count and price them in one place; the sums of
each document go back to its block.  Nothing is cut off: counts grow with the
corpus, and every document counts for the background.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .jaccard import FILTER_SLOTS, _needed
from .textvec import Words, mix, runs

#: Occurrences that the unigram weighs in a bigram's smoothing.
MU = 100.0
#: A document is scored by the target model of the other folds, so never by its own counts.
FOLDS = 2
#: Words of a block of documents, and of a group of words: what one Python worker holds.
BLOCK_WORDS, GROUP_WORDS = 1 << 21, 1 << 21
#: Documents of a block that a bigram's group hears of one by one; of more it hears their sum.
LISTED = 256
#: The "word" after a text's last and before its first.
END = np.uint64(0x9E3779B97F4A7C15)


def _likely(docs: DataFrame, needed) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that pass the filter: all that are meant, and few others."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(needed.value).astype(bool)
        for batch in batches:
            some = pa.array(wanted[batch.column(2).to_numpy(zero_copy_only=False)])
            yield batch.select(["doc_id", "text"]).filter(some)

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_SLOTS)).cast("int").alias("slot")
    return docs.select("doc_id", "text", slot).mapInArrow(run, f"doc_id {kind}, text string")


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, hash of what stands before, and text, of every word and end of the texts that have words."""
    some = np.flatnonzero(words.count)
    ends = words.first[some + 1]
    word = np.insert(words.hash, ends, END)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    if len(before):
        before[0] = END
    return word, before, np.insert(words.text, ends, some)


_MODELS = ["n", *(f"n{k}" for k in range(FOLDS))]


def _word_counts(rows: DataFrame) -> DataFrame:
    """word, n (in rows of fold -1), n0.. (in those of each other fold); rows: text, fold."""

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        word, fold = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(word)
        word, fold = word[order], fold[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        counts = [np.add.reduceat((fold == k).astype(np.int64), first) for k in range(-1, FOLDS)]
        for i in range(0, len(first), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in (word[first].view(np.int64), *counts)], names=["word", *_MODELS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            fold = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            for i, j, data, offsets in runs(batch.column(0)):
                word, _, text = _tokens(Words(data, offsets, True))
                held.append((word, fold[i:j][text]))
                count += len(word)
                if count >= BLOCK_WORDS:
                    yield from counted(held)
                    held, count = [], 0
        if count:
            yield from counted(held)

    counts = rows.select("text", "fold").mapInArrow(run, ", ".join(f"{n} long" for n in ("word", *_MODELS)))
    return counts.groupBy("word").agg(*[F.sum(n).alias(n) for n in _MODELS])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: like bytes of neighbouring numbers stand together."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.kind), a.itemsize, len(a)))], "<i8")
    body = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return head.tobytes() + (pa.Codec("zstd", compression_level=1).compress(body, asbytes=True) if body else b"")


def _unpack(data) -> list[np.ndarray]:
    buffer = memoryview(data)
    n = int(np.frombuffer(buffer[:8], "<i8")[0])
    head = np.frombuffer(buffer[8 : 8 + 24 * n], "<i8").reshape(n, 3)
    total = int((head[:, 1] * head[:, 2]).sum())
    body = np.frombuffer(pa.Codec("zstd").decompress(buffer[8 + 24 * n :], decompressed_size=total), np.uint8) if total else np.zeros(0, np.uint8)
    out, at = [], 0
    for kind, width, count in head.tolist():
        part = body[at : at + width * count].reshape(width, count).T
        out.append(np.ascontiguousarray(part).view(f"{chr(kind)}{width}").reshape(count))
        at += width * count
    return out


class Hot:
    """Words too frequent for one group: each is dealt to several by what stands before it.

    At most two words for each group of the corpus, so the table is bounded by
    its size divided by GROUP_WORDS.  ``keys`` stand for (word, part).
    """

    def __init__(self, word: np.ndarray, counts: np.ndarray):
        order = np.argsort(word)
        self.word, counts = word[order], counts[order]
        self.parts = -(-counts.sum(axis=1) // (GROUP_WORDS // 2))
        owner = np.repeat(np.arange(len(word)), self.parts)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(self.parts) - self.parts, self.parts)
        keys = self.key(self.word[owner], part)
        by = np.argsort(keys)
        self.keys, self.counts = keys[by], counts[owner][by]

    @staticmethod
    def key(word: np.ndarray, part: np.ndarray) -> np.ndarray:
        return mix(word + np.uint64(0xD6E8FEB86659FD93) * (part.astype(np.uint64) + np.uint64(1)))

    def deal(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The word's own hash, or for a hot word that of its part."""
        if not len(self.word):
            return word
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        hot = np.flatnonzero(self.word[at] == word)
        out = word.copy()
        out[hot] = self.key(word[hot], mix(before[hot]) % self.parts[at[hot]].astype(np.uint64))
        return out

    def whole(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Counts of whole words where ``keys`` are parts of hot ones, else as they are."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hot = self.keys[at] == keys
            counts[hot] = self.counts[at[hot]]
        return counts


_DEALT = "group int, block long, kind int, data binary"


def _dealt(rows: DataFrame, groups: int, hot) -> DataFrame:
    """What each block asks of each group (kind 1), and what each block holds (kind 0).

    rows: doc_id, text, fold (-1: asks and counts for the background; else that
    of a target row), own (the fold of an asking row).  The documents that share
    one bigram more than LISTED times in a block are listed with the block, and
    asked for as one document of each fold, so that no bigram makes a group grow
    with the number of documents.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    step = 2.0**64 / groups

    def block(held: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
        word, before, code = (np.concatenate([h[k] for h in held]) for k in range(3))
        ids = pa.chunked_array([h[3] for h in held]).combine_chunks()
        sizes = np.concatenate([h[4] for h in held])
        here = (TaskContext.get().partitionId() << 32) + number
        key = hot.value.deal(word, before)
        # one number for a bigram of a word and the document: 40 bits of the context's hash, 24 of the code
        tail = (before >> np.uint64(24) << np.uint64(24)) | code.astype(np.uint64)
        order = np.lexsort((tail, key))
        key, tail = key[order], tail[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (tail[1:] != tail[:-1])]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(key)))
        key, tail = key[first], tail[first]
        pair = tail >> np.uint64(24)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]) if len(key) else new[first]
        starts = np.flatnonzero(new)
        entries = np.diff(np.append(starts, len(key)))
        code = (tail & np.uint64((1 << 24) - 1)).astype(np.int64)
        listed, docs = [], len(sizes)
        if (entries > LISTED).any():
            keep, more = np.ones(len(key), bool), []
            for s in np.flatnonzero(entries > LISTED):
                at = np.arange(starts[s], starts[s] + entries[s])
                at = at[code[at] >= FOLDS]
                for f in range(FOLDS):
                    mine = at[code[at] % FOLDS == f]
                    if len(mine):
                        keep[mine] = False
                        more.append((mine[0], FOLDS * (1 + docs + len(listed)) + f, times[mine].sum()))
                        listed.append((code[mine] // FOLDS - 1, times[mine]))
            place, codes, sums = (np.array(x) for x in zip(*more)) if more else (np.zeros(0, np.int64),) * 3
            kept = np.flatnonzero(keep)
            by = np.argsort(np.concatenate([kept, place]), kind="stable")
            where = np.concatenate([kept, place])[by]
            code, times = np.concatenate([code[kept], codes])[by], np.concatenate([times[kept], sums])[by]
            key, pair = key[where], pair[where]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
            starts = np.flatnonzero(new)
            entries = np.diff(np.append(starts, len(key)))
        group = np.minimum((key[starts] / step).astype(np.int64), groups - 1)
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        found, numbers = [], []
        upto = np.append(starts, len(key))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)]):
            words = key[starts[a:b]]
            w = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            x, y = upto[a], upto[b]
            context = pair[starts[a:b]]
            found.append(_pack(words[w], np.diff(np.append(w, b - a)).astype("<u4"), (context >> np.uint64(8)).astype("<u4"), (context & np.uint64(255)).astype("u1"), entries[a:b].astype("<u2"), code[x:y].astype("<u4"), times[x:y].astype("<u4")))
            numbers.append(int(group[a]))
        which = np.repeat(np.arange(len(listed)), [len(d) for d, _ in listed]) if listed else np.zeros(0, np.int64)
        lists = [np.concatenate([x[k] for x in listed]) if listed else np.zeros(0, np.int64) for k in (0, 1)]
        for i, data in enumerate(found):
            yield row(numbers[i], here, 1, data)
        if docs:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
            said = sink.getvalue().to_pybytes()
            yield row(here % groups, here, 0, _pack(sizes.astype("<i8"), which.astype("<u4"), lists[0].astype("<u4"), lists[1].astype("<u4"), np.frombuffer(said, np.uint8)))

    def row(group: int, here: int, kind: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([here], pa.int64()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["group", "block", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, docs, number = [], 0, 0, 0
        for batch in batches:
            fold, own = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            for i, j, data, offsets in runs(batch.column(1)):
                words = Words(data, offsets, True)
                word, before, text = _tokens(words)
                asks = fold[i:j] < 0
                place = docs + np.cumsum(asks) - 1
                code = np.where(asks, FOLDS * (1 + place) + own[i:j], fold[i:j])
                held.append((word, before, code[text], batch.column(0)[i:j].filter(pa.array(asks)), words.count[asks]))
                count += len(word)
                docs += int(asks.sum())
                if count >= BLOCK_WORDS or docs >= 1 << 20:
                    yield from block(held, number)
                    held, count, docs, number = [], 0, 0, number + 1
        if held:
            yield from block(held, number)

    return rows.select(F.col("doc_id").cast(kind), "text", "fold", "own").mapInArrow(run, _DEALT)


def term_losses(pair: np.ndarray, word: np.ndarray, total: int, size: int, mu: float = MU) -> np.ndarray:
    """What an occurrence adds to its text's loss, in bits, by its bigram's and its word's count.

    Of -log2 p it holds the numerator for the word itself and the denominator
    for the word as the context of what follows.
    """
    return np.log2(word + mu) - np.log2(pair + mu * (word + 1.0) / (total + size))


def _priced(dealt: DataFrame, hot, totals: list[int], size: int, mu: float) -> DataFrame:
    """Of each block and group, the sums of the documents' terms (kind 1); what blocks hold passes through (kind 0)."""

    def priced(blocks: list[int], asked: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        words, n_pairs, high, low, entries, code, times = ([a[k] for a in asked] for k in range(7))
        key = np.concatenate([np.repeat(w, n) for w, n in zip(words, n_pairs)])
        pair = np.concatenate([(h.astype(np.uint64) << np.uint64(8)) | x for h, x in zip(high, low)])
        order = np.lexsort((pair, key))
        key, pair = key[order], pair[order]
        new_word = np.concatenate([[True], key[1:] != key[:-1]])
        new = new_word | np.concatenate([[True], pair[1:] != pair[:-1]])
        owner = np.empty(len(order), np.int64)
        owner[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        of_word = (np.cumsum(new_word) - 1)[first]
        owner = np.repeat(owner, np.concatenate(entries))
        code, times = np.concatenate(code).astype(np.int64), np.concatenate(times).astype(np.int64)
        count = lambda some: np.bincount(owner[some], weights=times[some], minlength=len(first))
        fold = [count(code == k) for k in range(FOLDS)]
        pairs = np.stack([count(code >= FOLDS), *fold], axis=1)
        whole = np.stack([np.bincount(of_word, weights=pairs[:, k]) for k in range(FOLDS + 1)], axis=1)
        whole = hot.value.whole(key[new_word], whole)
        back = term_losses(pairs[:, 0], whole[of_word, 0], totals[0], size, mu)
        near = np.empty((len(first), FOLDS))
        for f in range(FOLDS):
            others = [1 + k for k in range(FOLDS) if k != f]
            near[:, f] = term_losses(pairs[:, others].sum(axis=1), whole[:, others].sum(axis=1)[of_word], sum(totals[k] for k in others), size, mu)
        b, t = times * back[owner], times * near[owner, code % FOLDS]
        at = 0
        for block, a in zip(blocks, asked):
            n = len(a[5])
            c = code[at : at + n]
            doc, where = np.unique(c[c >= FOLDS] // FOLDS - 1, return_inverse=True)
            sums = [np.bincount(where, weights=x[at : at + n][c >= FOLDS], minlength=len(doc)).astype("<f4") for x in (t, b)]
            at += n
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([1], pa.int32()), pa.array([_pack(doc.astype("<u4"), *sums)], pa.binary())], names=["block", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, asked = None, [], []
        for batch in batches:
            for group, block, kind, data in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if kind == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([0], pa.int32()), pa.array([data.as_py()], pa.binary())], names=["block", "kind", "data"])
                    continue
                if group != now and asked:
                    yield from priced(blocks, asked)
                    blocks, asked = [], []
                now = group
                blocks.append(block)
                asked.append(_unpack(data.as_buffer()))
        if asked:
            yield from priced(blocks, asked)

    return dealt.mapInArrow(run, "block long, kind int, data binary")


def _collected(rows: DataFrame, kind: str) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background of every asking row; rows: those of a block follow each other, kind 0 first."""

    def result(ids, sizes, sums, lists) -> pa.RecordBatch:
        docs = len(sizes)
        which, doc, times = lists
        if len(which):
            total = np.bincount(which, weights=times, minlength=len(sums[0]) - docs)
            for s in sums:
                s[:docs] += np.bincount(doc, weights=times * (s[docs:] / np.maximum(total, 1))[which], minlength=docs)
        none = sizes == 0
        out = [pa.array(s[:docs] / (sizes + 1), mask=none) for s in sums]
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes), *out], names=["doc_id", "n_tokens", "ce_target", "ce_background"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for what, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                found = _unpack(data.as_buffer())
                if what == 0:
                    if held:
                        yield result(*held)
                    sizes, which, doc, times, said = found
                    with pa.ipc.open_stream(pa.py_buffer(said.tobytes())) as stream:
                        ids = stream.read_all().column(0).combine_chunks()
                    n = len(sizes) + (int(which.max()) + 1 if len(which) else 0)
                    held = ids, sizes.astype(np.int64), [np.zeros(n), np.zeros(n)], (which.astype(np.int64), doc.astype(np.int64), times.astype(np.int64))
                else:
                    for s, x in zip(held[2], found[1:]):
                        s[found[0]] += x
        if held:
            yield result(*held)

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ce_target double, ce_background double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, mu: float = MU, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background (bits a token) and score, their difference: lower is nearer the target.

    The target is what is labelled of quality and not toxic, in the folds other
    than the row's own; every row of ``docs`` counts for the background.  Null
    and empty texts, and texts without words, have no tokens and null losses;
    texts of any length are counted and scored whole; repeated rows count each
    and score alike; rows of null id are scored and never target; without labels
    the target model is uniform over all words; an empty table gives an empty
    result; columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    marked = good.select(F.col("doc_id").cast(kind).alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    # a fixed-size filter takes most other texts out before the exact join, which shuffles at every size
    needed = spark.sparkContext.broadcast(_needed(marked))
    own = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    aimed = _likely(docs, needed).hint("merge").join(marked.hint("merge"), "doc_id", "left_semi")
    aimed = scratch.save(aimed.select("doc_id", "text", own.alias("fold")), "target")
    rows = docs.select("doc_id", "text", F.lit(-1).alias("fold"), own.alias("own")).unionByName(aimed.withColumn("own", F.lit(0)))

    words = scratch.save(_word_counts(rows), "words")
    sums = words.agg(F.count("*"), *[F.coalesce(F.sum(m), F.lit(0)) for m in _MODELS]).first()
    size, totals = sums[0], list(sums[1:])
    groups = max(1, -(-sum(totals) // GROUP_WORDS))
    frequent = words.where(sum((F.col(m) for m in _MODELS), F.lit(0)) > GROUP_WORDS // 2).collect()  # at most two a group
    hot = Hot(np.array([r["word"] for r in frequent], np.int64).view(np.uint64), np.array([[r[m] for m in _MODELS] for r in frequent], np.int64).reshape(-1, len(_MODELS)))
    scratch.drop("words")
    hot = spark.sparkContext.broadcast(hot)

    dealt = _dealt(rows, groups, hot).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "block")
    priced = _priced(dealt.select("group", "block", "kind", "data"), hot, totals, size, mu)
    back = scratch.save(priced, "sums")
    scratch.drop("target")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = back.repartition(parts, "block").sortWithinPartitions("block", "kind")
    return _collected(back, kind).withColumn("score", F.col("ce_target") - F.col("ce_background"))
