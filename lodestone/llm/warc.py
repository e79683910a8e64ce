"""Deterministic sharded WARC writer and reader.

Records are range-sorted by key into shards whose bounds come from an exact
byte histogram, refined where a bucket is heavier than a shard, so they do not
depend on sampling or on the cluster.  Each shard writes gzip members into files
that roll by compressed size, under temporary names; the table ``pending``,
committed by Spark with the winning task attempts only, says which temporary
file becomes which archive, and the table ``manifest`` is written last: a folder
without it holds no committed archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Payloads below this many bytes are never written as revisits.
REVISIT_BYTES = 1000
#: A file is closed once it holds so many compressed bytes.
ROLL_BYTES = 256 << 20
#: Payload bytes that one shard (one task) should get, and shards at most (beyond it they grow).
SHARD_BYTES, MAX_SHARDS = 32 << 20, 1 << 14
#: Bits of a level of buckets: of the whole range, and of each bucket that is too heavy for a shard.
FIRST_BITS, MORE_BITS = 14, 8
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "shard int, file string, written string, records long, bytes long, sha1 string"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, scratch: Scratch, key: str = "page_id", payload: str = "html", url: str = "url", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Rows to write (kind 1) and, as rows of kind 0, which of them are revisits and of what.

    ``refers_to`` is the largest key among rows of equal payload; rows with that
    key, and payloads below ``revisit_bytes``, are responses; a null key is
    smaller than any.  The two kinds meet at the writer, so that payloads are
    moved once.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("html"), F.sha1(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"))
    light = scratch.save(rows.select("page_id", "payload_digest", "payload_bytes"), "digests").where(F.col("payload_bytes") >= revisit_bytes)
    groups = light.groupBy("payload_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # from a table, both sides of the join below are plain exchanges, whose hot keys Spark can split
    groups = scratch.save(groups, "groups")
    revisits = light.join(groups, "payload_digest").where(F.coalesce(F.col("page_id") < F.col("_last"), F.col("_last").isNotNull()))
    revisits = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "payload_digest", "payload_bytes", F.col("_last").alias("refers_to"), F.lit(0).alias("kind"))
    return rows.unionByName(revisits)


#: The key's bits in ascending order as unsigned numbers.
_ORDERED = "(coalesce(page_id, -9223372036854775807L - 1L) ^ (-9223372036854775807L - 1L))"


class Shards:
    """Which shard each record belongs to, as a column and as a number of shards.

    Payload bytes are summed in buckets of equal key width; a bucket that alone
    is heavier than a shard is cut into finer ones between its own smallest and
    largest key, and one that holds a single key by its payloads' digests.  What
    neither parts (equal key and payload) makes one longer shard, which rolls
    into more files.  The driver gets the sums of one level at a time: 16,384,
    then 256 of each heavy bucket, of which there are fewer than shards.
    """

    def __init__(self, rows: DataFrame, shard_bytes: int = SHARD_BYTES):
        low, high, total = rows.agg(*self._edges()[:2], F.sum(self._bytes())).first()
        #: Of each level: shift, mask and digit of the digest by parent, bits; and what each cell holds.
        self.tables: list[tuple[list[int], list[int], list[int], int]] = []
        self.found: list[np.ndarray] = []
        self.count = 1
        if total is None:
            return
        shard_bytes = max(shard_bytes, -(-total // MAX_SHARDS))
        leaves: list[tuple[tuple[int, ...], int, int, int]] = []  # place, bytes, level, cell
        heavy = [((), int(low, 16), int(high, 16), 0)]  # place, smallest and largest key, digits of the digest in use
        bits = FIRST_BITS
        while heavy:
            widths = [(low ^ high).bit_length() for _, low, high, _ in heavy]
            digits = [0 if w else 1 + used for w, (*_, used) in zip(widths, heavy)]
            level, cells = len(self.tables), 1 << bits
            self.tables.append(([max(0, w - bits) for w in widths], [cells - 1 if w else 0 for w in widths], digits, bits))
            sums = rows.groupBy(self._cell(level).alias("cell")).agg(F.sum(self._bytes()).alias("n"), *[e.alias(n) for n, e in zip(("low", "high", "one", "other"), self._edges())])
            sums = sums.select("cell", "n", *[F.when(F.col("n") > shard_bytes, F.col(c)).alias(c) for c in ("low", "high", "one", "other")])
            heavier = []
            self.found.append(np.zeros(len(heavy) * cells, np.int64))
            for r in sums.where(F.col("cell").isNotNull()).orderBy("cell").collect():
                parent, digit = divmod(r["cell"], cells)
                place, used = (*heavy[parent][0], digit), heavy[parent][3] + (bits // 4 if digits[parent] else 0)
                if r["n"] > shard_bytes and (r["low"] != r["high"] or (r["one"] != r["other"] and used < 36)):
                    # read as: the k-th cell that the next level cuts
                    self.found[level][r["cell"]] = -1 - len(heavier)
                    heavier.append((place, int(r["low"], 16), int(r["high"], 16), used))
                else:
                    leaves.append((place, r["n"], level, r["cell"]))
            heavy, bits = heavier, MORE_BITS
        upto = 0
        for place, n, level, cell in sorted(leaves):
            self.found[level][cell] = upto // shard_bytes
            upto += n
        used = np.unique(np.concatenate([f[f >= 0] for f in self.found]))
        for f in self.found:
            f[f >= 0] = np.searchsorted(used, f[f >= 0])
        self.count = max(1, len(used))

    @staticmethod
    def _bytes() -> Column:
        return F.col("payload_bytes") + 600  # with headers

    @staticmethod
    def _edges() -> list[Column]:
        """Smallest and largest key, as 16 hexadecimal digits; smallest and largest digest."""
        key = F.expr(f"lpad(hex({_ORDERED}), 16, '0')")
        return [F.min(key), F.max(key), F.min("payload_digest"), F.max("payload_digest")]

    @staticmethod
    def _lookup(values, at: Column) -> Column:
        """values[at], as one folded literal."""
        return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), at + 1)

    def _cell(self, level: int) -> Column:
        """The cell of a level in which a record falls; null if an earlier level places it."""
        shifts, masks, digits, bits = self.tables[level]
        parent = F.lit(0) if level == 0 else -1 - self._lookup(self.found[level - 1], self._cell(level - 1))
        if level:
            parent = F.when(parent >= 0, parent)
        shift, mask, digit = (self._lookup(x, parent) for x in (shifts, masks, digits))
        by_key = F.call_function("shiftrightunsigned", F.expr(_ORDERED), shift).bitwiseAND(mask.cast("long")).cast("int")
        by_digest = F.conv(F.substring(F.col("payload_digest"), F.greatest(digit, F.lit(1)), F.lit(bits // 4)), 16, 10).cast("int")
        return (parent * (1 << bits) + F.when(digit > 0, by_digest).otherwise(by_key)).cast("int")

    def column(self) -> Column:
        """The shard of a row with page_id and payload_digest."""
        if not self.tables:
            return F.lit(0)
        out = [self._lookup(f, self._cell(k)) for k, f in enumerate(self.found)]
        return F.coalesce(*[F.when(x >= 0, x) for x in out], F.lit(0)).cast("int")


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def record(page_id, url: str | None, html: str | None, payload_bytes: int, sha1_hex: str, refers_to, place: int = 0) -> bytes:
    """One record, uncompressed; html None: a revisit.  All headers and digests are made anew.

    ``place`` parts the ids of records of equal key and payload; a revisit names the first response.
    """
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    known = "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    body = b"" if html is None else html.encode("utf-8")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + body
    fields = [
        ("WARC-Type", "revisit" if html is None else "response"), ("WARC-Record-ID", _id("record", page_id, sha1_hex, place)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", known), ("WARC-Block-Digest", _digest(block)), ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(payload_bytes)),
    ]
    if html is None:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _id("record", refers_to, sha1_hex, 0)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without time stamp, so that equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Roller:
    """Writes one shard's members under temporary names, rolling by compressed size."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.fs, self.path = _filesystem(folder)
        self.shard, self.roll, self.file, self.count = shard, roll_bytes, None, 0

    def add(self, data: bytes) -> dict | None:
        """The manifest row of the file that this record closed, if it did."""
        if self.file is None:
            self.name = f"part-{self.shard:06d}-{self.count:05d}.warc.gz"
            self.written = f"tmp/{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.path}/tmp", recursive=True)
            self.file, self.hash, self.bytes, self.records = self.fs.open_output_stream(f"{self.path}/{self.written}", compression=None), hashlib.sha1(), 0, 0
            info = f"software: lodestone\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self._put(_member(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id("info", self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("WARC-Block-Digest", _digest(info)), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n"))
        self._put(_member(data))
        self.records += 1
        return self.close() if self.bytes >= self.roll else None

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def close(self) -> dict | None:
        if self.file is None:
            return None
        self.file.close()
        self.file, self.count = None, self.count + 1
        return {"shard": self.shard, "file": self.name, "written": self.written, "records": self.records, "bytes": self.bytes, "sha1": self.hash.hexdigest()}


def write_archives(records: DataFrame, folder: str, scratch: Scratch, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the planned records below ``folder``; gives back the manifest.

    Rerun tasks write other temporary files with the same bytes; only files in
    the committed table ``pending`` are renamed.  Then what earlier runs or lost
    tasks left is deleted, and ``manifest`` is written last.
    """
    for name in ("manifest", "pending", "tmp"):  # from here on the folder is not committed
        scratch._delete(f"{folder}/{name}")
    shards = Shards(scratch.spark.read.parquet(scratch.path("digests")), shard_bytes)
    dealt = records.withColumn("shard", shards.column())
    dealt = dealt.repartitionById(shards.count, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "payload_digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, done, revisit, at, place = None, [], (None, None, None), None, 0
        for batch in batches:
            for r in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("kind", "shard", "page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to"))):
                kind, s, page_id, url, html, size, digest, refers = (x.as_py() for x in r)
                if kind == 0:
                    revisit = (page_id, digest, refers)
                    continue
                refers = revisit[2] if revisit[:2] == (page_id, digest) else None
                html = html if refers is None else None
                at, place = (page_id, digest), place + 1 if at == (page_id, digest) else 0
                if roller is None or roller.shard != s:
                    done += [roller and roller.close()]
                    roller = _Roller(folder, s, roll_bytes)
                done.append(roller.add(record(page_id, url, html, size, digest, refers, place)))
        done += [roller and roller.close()]
        done = [d for d in done if d]
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done).astype({"shard": "int32"}), preserve_index=False)

    def commit(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return scratch.spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    pending = commit(dealt.mapInArrow(run, _MANIFEST), "pending")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        for batch in batches:
            for name, written in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                # after a lost executor a rename may already have been done
                if files.get_file_info(f"{path}/{written}").type.name != "NotFound":
                    files.move(f"{path}/{written}", f"{path}/{name}")
            yield batch

    renamed = scratch.save(pending.mapInArrow(rename, _MANIFEST), "renamed")
    _drop_stale(folder, {r["file"] for r in renamed.select("file").toLocalIterator()})
    manifest = commit(renamed, "manifest")
    for name in ("pending", "tmp"):
        scratch._delete(f"{folder}/{name}")
    return manifest


def _drop_stale(folder: str, names: set[str]) -> None:
    """Delete archives that are not named."""
    from pyarrow import fs

    files, path = _filesystem(folder)
    for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.base_name.endswith(".warc.gz") and info.base_name not in names:
            files.delete_file(info.path)


def _members(stream, most: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], stream.read(most)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data or stream.read(most), zlib.decompressobj(31), []
        else:
            data = stream.read(most)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:]))
    return fields, rest[: int(fields["content-length"])]


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest (hex), record_type, refers_to of every record.

    Digests and lengths of responses are counted from the payload read; a
    mismatch with the headers is an error.  A revisit has no html.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        names = ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        f, block = parse(data)
                        if f["warc-type"] == "warcinfo":
                            continue
                        if _digest(block) != f["warc-block-digest"]:
                            raise ValueError(f"block digest of {f['warc-record-id']} in {name}")
                        page, sha1 = (int(f["x-page-id"]) if f["x-page-id"] else None), base64.b32decode(f["warc-payload-digest"][5:]).hex()
                        if f["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size, found = len(payload), hashlib.sha1(payload).hexdigest()
                            if found != sha1:
                                raise ValueError(f"payload digest of {f['warc-record-id']} in {name}")
                            rows.append((page, f["warc-target-uri"], payload.decode("utf-8"), size, found, "response", None))
                        else:
                            rows.append((page, f["warc-target-uri"], None, int(f["x-payload-length"]), sha1, "revisit", int(f["x-refers-to-page-id"])))
                        held += len(data)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    # about one file a task: the manifest is spread before it is read
    spread = manifest.select("file").repartition(max(1, min(10_000, manifest.count())))
    return spread.mapInArrow(run, "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, scratch: Scratch | None = None, **options) -> tuple[DataFrame, str]:
    """Write every row of ``pages`` (page_id, url, html) as a record; (manifest, folder).

    Null html is an empty payload, a null url is written as about:blank, a null
    page_id as an empty identifier in the first shards; repeated rows are all
    written, and of rows that tie for the largest key of a payload all are
    responses; pages of any length are one record; an empty table writes no
    file.  Other columns are not read.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    folder = folder or scratch.path("archives")
    records = plan_records(pages, scratch)
    return write_archives(records, folder, scratch, **options), folder


def archived_pages(pages: DataFrame) -> DataFrame:
    """The rows that ``archive`` wrote, read back: digests and record types, without payloads.

    Nulls, empty and very long pages, ties, repeated rows and empty tables as in ``archive``.
    """
    manifest, folder = archive(pages)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND coalesce(page_id < last, last IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND coalesce(page_id < last, last IS NOT NULL) THEN last END AS refers_to
FROM m
"""
