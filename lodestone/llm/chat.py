"""Chat formatting as packed prefix trees.

Conversations are range-sorted by the hashes of their turns, so that
those sharing initial turns follow each other in depth-first order.  Each task
merges its stretch into prefix trees of bounded size: a shared turn's tokens
are emitted once, with position ids that continue its parent's, and each node
carries the token intervals of its ancestors, which are all that it attends to
besides itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .packing import Encoder, tokenizer_path

#: Control strings of the template: assistant turns and all others, and the end of a role.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SAYS]")
_ESCAPE = re.compile(r"([<\[])(\\*/?(?:s>|INST\]|SAYS\]))")
_UNESCAPE = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]|SAYS\]))")
_TURN = re.compile(r"(?:<s>|\[INST\])(.*?)\[SAYS\](.*?)(?:</s>|\[/INST\])", re.DOTALL)
#: A pack is closed once it holds so many tokens (a longer conversation makes a pack of its own).
PACK_TOKENS = 1 << 16

SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])
NODE = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("attends", T.ArrayType(SPAN))])
LEAF = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("node", T.IntegerType()), T.StructField("n_turns", T.IntegerType())])
PACK = T.StructType([T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("loss", T.ArrayType(SPAN)), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("conversations", T.ArrayType(LEAF))])
_SPAN = pa.struct([("first", pa.int32()), ("end", pa.int32())])
_PACK = pa.schema([("tokens", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("loss", pa.list_(_SPAN)), ("nodes", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("attends", pa.list_(_SPAN))]))), ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32()), ("n_turns", pa.int32())])))])

#: A conversation whose texts hold the control strings themselves.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(text: str) -> str:
    """A backslash after the bracket of every control string; ``unescape`` takes it out again."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text, and what ends the turn, all escaped."""
    ours = role == "assistant"
    return ("<s>" if ours else "[INST]") + escape(role) + "[SAYS]", escape(text), "</s>" if ours else "[/INST]"


class _Pack:
    """One prefix tree, grown in depth-first order."""

    def __init__(self):
        self.size, self.tokens, self.positions, self.loss, self.nodes, self.leaves = 0, [], [], [], [], []
        #: (turn, node) of the path to the last conversation.
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id, turns: list[tuple[str, str]], encode) -> None:
        depth = 0
        while depth < min(len(self.path), len(turns)) and self.path[depth][0] == turns[depth]:
            depth += 1
        del self.path[depth:]
        for turn in turns[depth:]:
            parent = self.path[-1][1] if self.path else -1
            attends: list[tuple[int, int]] = []
            if parent >= 0:
                first, end, _, before, _ = self.nodes[parent]
                attends = [*before[:-1], (before[-1][0], end)] if before and before[-1][1] == first else [*before, (first, end)]
            at = self.nodes[parent][4] if parent >= 0 else 0
            head, body, tail = (np.frombuffer(encode(x), "<u4") for x in turn_parts(*turn))
            first, count = self.size, len(head) + len(body) + len(tail)
            self.tokens += [head, body, tail]
            self.positions.append(np.arange(at, at + count))
            if turn[0] == "assistant" and len(body):
                self.loss.append((first + len(head), first + len(head) + len(body)))
            self.size += count
            self.nodes.append((first, self.size, parent, attends, at + count))
            self.path.append((turn, len(self.nodes) - 1))
        self.leaves.append((conv_id, self.path[-1][1], len(turns)))

    def row(self) -> pa.RecordBatch:
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        span = lambda s: {"first": s[0], "end": s[1]}
        nodes = [{"first": f, "end": e, "parent": p, "attends": [span(s) for s in a]} for f, e, p, a, _ in self.nodes]
        leaves = [dict(zip(("conv_id", "node", "n_turns"), x)) for x in self.leaves]
        kinds = [_PACK.field(k).type.value_type for k in range(5)]
        columns = (np.concatenate(self.tokens).astype(np.int32), np.concatenate(self.positions).astype(np.int32), [span(s) for s in self.loss], nodes, leaves)
        return pa.RecordBatch.from_arrays([one(c, k) for c, k in zip(columns, kinds)], names=_PACK.names)


def gather(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text in order of turn) and path (the turns' hashes).

    Rows of equal turn stand in order of role and text; nulls of turn first.
    """
    part = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(part)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = rows.groupBy("conv_id").agg(turns.alias("turns"))
    return out.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))


def format_packs(rows: DataFrame, tokenizer: str | None = None, pack_tokens: int = PACK_TOKENS, partitions: int | None = None) -> DataFrame:
    """conv_id, turn, role, text -> packs: tokens, positions, loss spans, nodes, conversations.

    Null roles and texts are empty; equal rows are all turns; rows of null
    conv_id make one conversation; conversations that are equal share all their
    nodes; texts of any length are one turn.  A first turn shared by very many
    conversations is emitted once a pack.  A conversation is one path of one
    tree, so its turns must fit a task.  An empty table gives no pack; other
    columns are not read.
    """
    spark, path = rows.sparkSession, tokenizer or tokenizer_path()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = gather(rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"))
    # by all turns and then the id, so that neither a hot first turn nor a hot conversation stays whole
    ordered = ordered.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, plain=True)  # control strings in a text are ordinary text
        pack = _Pack()
        for batch in batches:
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
                pack.add(conv, [(x["role"], x["text"]) for x in turns.as_py()], encode)
                if pack.size + len(pack.leaves) >= pack_tokens:
                    yield pack.row()
                    pack = _Pack()
        if pack.leaves:
            yield pack.row()

    return ordered.mapInArrow(run, PACK)


DIGEST = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])


def read_packs(packs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per conversation, what its tokens say: turns, loss text and formatted text, as digests.

    Each node is decoded once; a digest goes on from that of the node's parent.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Encoder(path, plain=True).decode
        for batch in batches:
            for tokens, loss, nodes, leaves in zip(*(batch.column(k) for k in (0, 2, 3, 4))):
                tokens, loss = tokens.values.to_numpy(), [loss.values.field(f).to_numpy() for f in ("first", "end")]
                # of each node: turns, their digest so far, learned code points, their digest so far, code points in all
                said: list[tuple] = []
                for first, end, parent in zip(*(nodes.values.field(f).to_pylist() for f in ("first", "end", "parent"))):
                    turns, all_, learned, of_learned, chars = said[parent] if parent >= 0 else (0, hashlib.sha256(), 0, hashlib.sha256(), 0)
                    text = decode(tokens[first:end])
                    all_, of_learned = all_.copy(), of_learned.copy()
                    for role, x in _TURN.findall(text):
                        turns += 1
                        all_.update(f"{unescape(role)}\n{unescape(x)}\n".encode())
                    for k in range(*np.searchsorted(loss[0], [first, end])):
                        part = unescape(decode(tokens[loss[0][k] : loss[1][k]]))
                        learned += len(part)
                        of_learned.update(part.encode())
                    said.append((turns, all_, learned, of_learned, chars + len(text)))
                out = [(c, *(x.hexdigest() if hasattr(x, "hexdigest") else x for x in said[n])) for c, n in zip(*(leaves.values.field(f).to_pylist() for f in ("conv_id", "node")))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=DIGEST.names)

    return packs.mapInArrow(run, DIGEST)


def formatted_conversations(conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Format every conversation and the probe, write the packs, and read them back; odd rows as in ``format_packs``."""
    scratch = scratch or Scratch(conversations.sparkSession, "chat")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    return read_packs(scratch.save(format_packs(rows), "packs"))


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]|SAYS\]))', '\1\\\2', 'g') AS r,
         regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]|SAYS\]))', '\1\\\2', 'g') AS x FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(x) + CASE WHEN role = 'assistant' THEN 13 ELSE 19 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
