"""Best-fit packing by a configuration linear program over the length histogram.

Documents are cut into pieces of at most one sequence; only the histogram of
piece lengths (at most ``capacity`` numbers) reaches the driver.  There the
fractional covering program over configurations (multisets of lengths that fit
one sequence) is solved by multiplicative weights, each step pricing the best
configuration with a knapsack dynamic program; the solution is rounded down and
what is left is packed best fit, longest first, again on the histogram.  The
executors then look up each piece by its length and its rank within the length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

CAPACITY = 2048
#: Ranks within a length are counted in hash buckets of about so many pieces of all lengths, so that a hot length has no single task.
BUCKET_PIECES, MAX_BUCKETS = 50_000, 4096
#: Steps of multiplicative weights.
STEPS = 100

PIECES = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How the byte-level splitter cuts a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts as little-endian bytes, equal to the tokenizer's own.

    Where the file is a plain byte-level merge list in order of id, a second
    library that merges several times as fast encodes with the same ranks;
    otherwise, and where a text holds an added token or a run of white space
    longer than that library's splitter can take, the file's own library does.
    """

    def __init__(self, path: str, plain: bool = False):
        """plain: the strings of added tokens in a text are ordinary text."""
        import json

        self.path, self.own, self.plain = path, None, plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [] if plain else [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._ranked(spec)

    @property
    def tokenizer(self):
        """The file's own library, loaded when a text first needs it."""
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
            self.own.encode_special_tokens = self.plain
        return self.own

    @staticmethod
    def _ranked(spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
        if not plain:
            return None
        vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [vocabulary.get(a + b) for a, b in merges]
        if None in ids or any(x >= y for x, y in zip(ids, ids[1:])):
            return None
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        added = {t["content"] for t in spec.get("added_tokens") or []}
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if word not in added}
        if sum(len(w) == 1 for w in ranks) != 256 or (ids and max(i for w, i in ranks.items() if len(w) == 1) >= ids[0]):
            return None
        import tiktoken

        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(t in text for t in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # its regular expression ran out of stack
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


    def decode(self, ids: np.ndarray) -> str:
        """The text of whole encodings, one after another."""
        if self.fast is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return self.fast.decode_bytes(ids.tolist()).decode("utf-8")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each row's ids and ``end_id``."""
    end = np.asarray([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(tokenizer)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        column.append(value)
            types = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=PIECES.names)

    schema = T.StructType([T.StructField("doc_id", kind), *PIECES.fields[1:]])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_configuration(prices: np.ndarray, capacity: int) -> dict[int, int]:
    """Lengths (by index + 1) and counts of the multiset of greatest price that fits the capacity."""
    lengths = np.flatnonzero(prices > 0) + 1
    value = prices[lengths - 1]
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    stop = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := stop[c]:
            total = best[c - lengths[:n]] + value[:n]
            k = int(total.argmax())
            if total[k] > best[c]:
                best[c], taken[c] = total[k], lengths[k]
    found: dict[int, int] = {}
    c = capacity
    while c > 0:
        if taken[c] == 0 or best[c] == best[c - 1]:
            c -= 1
        else:
            found[int(taken[c])] = found.get(int(taken[c]), 0) + 1
            c -= int(taken[c])
    return found


def fractional(counts: np.ndarray, capacity: int, steps: int = STEPS, rate: float = 0.1) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often each is used, in a fractional cover of ``counts`` (by length - 1).

    Multiplicative weights: a length's price falls as it is covered ahead of
    the others; each step adds the configuration of greatest price.
    """
    need = counts.astype(float)
    have = need > 0
    if not have.any():
        return []
    lengths = np.arange(1, len(counts) + 1)
    covered, logs = np.zeros(len(counts)), np.zeros(len(counts))
    # a share of the ideal number of sequences a step; the last steps are scaled back below
    unit = max(1.0, (need * lengths).sum() / capacity / steps)
    used: dict[tuple, float] = {}
    for _ in range(3 * steps):
        prices = np.where(have, np.exp(np.clip(logs - logs[have].max(), -60, 0)) / np.maximum(need, 1) , 0.0)
        config = best_configuration(prices, capacity)
        items = np.array(list(config)), np.array(list(config.values()))
        amount = min(unit, float((np.maximum(need[items[0] - 1] - covered[items[0] - 1], need[items[0] - 1] / steps) / items[1]).min()))
        key = tuple(sorted(config.items()))
        used[key] = used.get(key, 0.0) + amount
        covered[items[0] - 1] += amount * items[1]
        logs = -covered / np.maximum(need, 1) / rate
        if (covered[have] >= need[have] * (1 - 1e-9)).all():
            break
    return [(dict(k), v) for k, v in used.items()]


def pack_plan(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[list[tuple[int, int]], int]]:
    """(configuration, number of sequences): every length exactly as often as counted.

    Rounding down loses little where sequences hold many pieces; where they hold
    two of many different lengths it may lose more than best fit alone does.  The
    plan of fewer sequences is taken.
    """
    left = counts.astype(np.int64).copy()
    plan: list[tuple[list[tuple[int, int]], int]] = []
    if left[capacity - 1]:  # a full piece fills a sequence
        plan.append(([(capacity, 1)], int(left[capacity - 1])))
        left[capacity - 1] = 0
    for config, amount in sorted(fractional(left, capacity, steps), key=lambda x: -x[1]):
        times = min([int(amount), *(int(left[n - 1]) // k for n, k in config.items())])
        if times > 0:
            plan.append((sorted(config.items(), reverse=True), times))
            for n, k in config.items():
                left[n - 1] -= k * times
    rounded, plain = plan + best_fit(left, capacity), best_fit(counts.astype(np.int64), capacity)
    return min(rounded, plain, key=lambda p: sum(times for _, times in p))


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Longest first; each next piece is the longest that still fits (the fullest gap on the histogram)."""
    left, plan = left.copy(), []
    lengths = np.flatnonzero(left)[::-1] + 1
    while len(lengths):
        config: list[tuple[int, int]] = []
        room = capacity
        for n in lengths:
            if n <= room and (k := min(int(left[n - 1]), room // int(n))):
                config.append((int(n), k))
                room -= k * int(n)
        times = min(int(left[n - 1]) // k for n, k in config)
        plan.append((config, times))
        for n, k in config:
            left[n - 1] -= k * times
        lengths = lengths[left[lengths - 1] > 0]
    return plan


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> pd.DataFrame:
    """Per length and plan entry: first rank, first sequence, pieces a sequence, offset of the first one."""
    rows, seen, sequence = [], {}, 0
    for config, times in plan:
        offset = 0
        for n, k in config:
            first = seen.get(n, 0)
            rows.append((n, first, sequence, k, offset))
            seen[n] = first + k * times
            offset += n * k
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "each", "offset"]).sort_values(["length", "rank"], kind="stable").reset_index(drop=True)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, steps: int = STEPS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the place of each piece.

    Null and empty texts are packed as their end id alone; rows with equal ids
    are packed each; texts of any length are cut, never shortened; an empty
    table gives an empty result; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pack")
    cut_up = scratch.save(pieces(docs, tokenizer or tokenizer_path(), capacity, end_id), "pieces")
    buckets = min(MAX_BUCKETS, 16 + cut_up.count() // BUCKET_PIECES)
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    cut_up = cut_up.withColumn("_bucket", bucket)
    counts = scratch.save(cut_up.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "histogram")
    histogram = np.zeros(capacity, np.int64)
    # at most ``capacity`` rows, however many documents there are
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        histogram[r["length"] - 1] = r["n"]
    plan = slots(pack_plan(histogram, capacity, steps))

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("length", "_bucket", "_base")
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut_up.withColumn("_row", F.row_number().over(within) - 1).join(base, ["length", "_bucket"]).withColumn("_rank", (F.col("_base") + F.col("_row")).cast("long")).drop("_bucket", "_base", "_row")

    length, rank, sequence, each, offset = (plan[c].to_numpy(np.int64) for c in ("length", "rank", "sequence", "each", "offset"))
    most = int(histogram.sum()) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = length * most + rank
        for batch in batches:
            n, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, n * most + r, side="right") - 1
            k = r - rank[at]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[at] + k // each[at]), pa.array(offset[at] + k % each[at] * n)], names=[*names, "sequence_id", "offset"])

    names = PIECES.names
    schema = T.StructType([*(cut_up.schema[n] for n in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*names, "_rank").mapInArrow(place, schema)
