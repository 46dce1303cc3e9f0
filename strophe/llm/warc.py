"""WARC records in seekable Zstandard bundles: written by tasks into the shared folder and read back.

Records are gathered in independent frames; a bundle ends with a map from record identifiers to
(frame, offset in frame, length) in a skippable frame and with the seek table of the seekable
format, so that any Zstandard tool reads the whole and one record costs one frame. A bundle has
a name of its own for every attempt and is listed only by the attempt that Spark accepts, so
lost tasks leave no trace in the index. Needs a folder that workers can open with pyarrow.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import same, written

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 128 << 20
#: Packed bytes a task reads, about.
READ_BYTES = 4 << 20
# Fixed values of the Zstandard frame formats and of WARC 1.1.
SEEK_MAGIC, SEEK_FOOTER, MAP_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "record_id string, bundle string, frame long, frame_start long, frame_bytes long, offset long, length long"
RECORD_SCHEMA = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def record_id(page_id: str | None, digest: str) -> str:
    return f"urn:nopage:{digest}" if page_id is None else "urn:page:" + urllib.parse.quote(page_id, safe="")


def page_of(identifier: str) -> str | None:
    return urllib.parse.unquote(identifier[9:]) if identifier.startswith("urn:page:") else None


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit holds the HTTP header without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "urn:nourl")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>",
            f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> Iterator[dict]:
    """The records of a frame. A response whose payload does not have its digest is an error."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        block = data[end + 4:end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block) + 4
        cut = block.index(b"\r\n\r\n") + 4
        size = int(re.search(rb"Content-Length: (\d+)", block[:cut])[1])
        revisit, payload, digest = head["WARC-Type"] == "revisit", block[cut:], head["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
        yield {"page_id": page_of(head["WARC-Record-ID"][1:-1]), "url": head["WARC-Target-URI"], "payload": None if revisit else payload,
               "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"],
               "refers_to": page_of(head["WARC-Refers-To"][1:-1]) if revisit else None}


class Bundle:
    """A bundle being written; ``close`` returns its index rows."""

    def __init__(self, root: str, frame_bytes: int):
        import zstandard
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(root)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/{uuid.uuid4().hex}.warc.zst"
        self.out, self.zstd, self.frame_bytes = self.fs.open_output_stream(self.path + ".part"), zstandard.ZstdCompressor(level=3), frame_bytes
        self.frames, self.start, self.buffer, self.held, self.rows = [], 0, io.BytesIO(), [], []

    def add(self, identifier: str, data: bytes) -> None:
        self.held.append((identifier, self.buffer.tell(), len(data)))
        self.buffer.write(data)
        if self.buffer.tell() >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(self.buffer.getbuffer())
            self.out.write(packed)
            self.rows += [(i, len(self.frames), self.start, len(packed), o, n) for i, o, n in self.held]
            self.frames.append((len(packed), self.buffer.tell()))
            self.start += len(packed)
            self.buffer, self.held = io.BytesIO(), []

    def close(self) -> list[tuple]:
        self.flush()
        packed = self.zstd.compress(json.dumps([[r[0], r[1], r[4], r[5]] for r in self.rows]).encode())
        self.out.write(struct.pack("<II", MAP_MAGIC, len(packed)) + packed)
        table = b"".join(struct.pack("<II", *x) for x in [*self.frames, (8 + len(packed), 0)]) + struct.pack("<IBI", len(self.frames) + 1, 0, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return [(r[0], self.path.rpartition("/")[2], *r[1:]) for r in self.rows]


def seek_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, plain bytes) of every frame of an open bundle."""
    size = f.size()
    count, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEK_FOOTER:
        raise ValueError("no seek table")
    raw, start, found = f.read_at(8 * count, size - 9 - 8 * count), 0, []
    for packed, plain in struct.iter_unpack("<II", raw):
        found.append((start, packed, plain))
        start += packed
    return found


def read_record(root: str, bundle: str, identifier: str) -> dict:
    """One record by its identifier: seek table, record map, one frame."""
    import zstandard
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(root)
    with where.open_input_file(f"{base}/{bundle}") as f:
        frames = seek_table(f)
        start, packed, _ = frames[-1]
        entries = json.loads(zstandard.ZstdDecompressor().decompress(f.read_at(packed, start)[8:]))
        _, k, offset, length = next(e for e in entries if e[0] == identifier)
        start, packed, plain = frames[k]
        data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, start), max_output_size=max(plain, 1))
    return next(parsed(data[offset:offset + length]))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (binary), sha1, revisit, refers_to; a payload is shuffled once, by page.

    Groups of equal payloads are pre-aggregated; rows of one payload meet only as slim rows.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    p = pages.select("page_id", "url", html.alias("html")).withColumn("_sha", F.sha1("html"))
    slim = written(p.select("page_id", "_sha", F.length("html").alias("_n")).where(F.col("_n") >= min_bytes), "payloads")
    groups = slim.groupBy("_sha", "_n").agg(F.min("page_id").alias("_owner"), F.count(F.lit(1)).alias("_k"))
    groups = written(groups.where("_k > 1").select("_sha", "_owner"), "copies")
    revisits = slim.join(groups, "_sha").where(~F.col("page_id").eqNullSafe(F.col("_owner"))).select("page_id", "_sha", "_owner").distinct()
    joined = p.alias("p").join(revisits.alias("r"), same(p, revisits, "page_id", "_sha"), "left")
    return joined.select("p.page_id", "p.url", "p.html", F.col("p._sha").alias("sha1"), F.col("r._sha").isNotNull().alias("revisit"),
                         F.col("r._owner").alias("refers_to"))


def write_bundles(pages: DataFrame, root: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) and return the index, one row per record.

    Of equal payloads of at least ``min_bytes`` bytes the record of the smallest page_id is the
    response, the others revisit it; rows that repeat this page_id are responses too. A null html
    is an empty payload. A row with a null page_id revisits a copy that has an id, else it is a
    response. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*bundle.close(), strict=True)], names)

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, html, sha, revisit, owner = (c[row].as_py() for c in batch.columns)
                bundle = bundle or Bundle(root, frame_bytes)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                bundle.add(record_id(page, digest), record(page, url, html, digest, owner, revisit, date))
                if bundle.start >= bundle_bytes:
                    yield closed()
                    bundle = None
        if bundle:
            yield closed()

    rows = with_revisits(pages, min_bytes)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return written(rows.mapInArrow(run, INDEX_SCHEMA), "index")


def read_bundles(spark: SparkSession, index: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """All records that ``index`` lists, frame by frame; frames, not bundles, are dealt to tasks. A revisit has a null payload."""
    keep = [x.split()[0] for x in RECORD_SCHEMA.split(", ") if with_payload or not x.startswith("payload binary")]
    types = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string()) for n in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(root)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, own in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: r[0]):
                with where.open_input_file(f"{base}/{name}") as f:
                    plain = {start: size for start, _, size in seek_table(f)}
                    for _, start, packed in own:
                        rows = list(parsed(unpack.decompress(f.read_at(packed, start), max_output_size=max(plain[start], 1))))
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.field(n).type) for n in keep], names=keep)

    # a table of its own, so that no earlier shuffle stands in for this one: tasks follow the bytes to read
    frames = written(index.select("bundle", "frame", "frame_start", "frame_bytes").distinct(), "frames")
    size = frames.agg(F.sum("frame_bytes")).first()[0] or 0
    many = max(1, min(-(-size // READ_BYTES), 100_000))
    schema = ", ".join(x for x in RECORD_SCHEMA.split(", ") if x.split()[0] in keep)
    dealt = frames.repartition(many, "bundle", "frame").sortWithinPartitions("bundle", "frame_start")
    return dealt.select("bundle", "frame_start", "frame_bytes").mapInArrow(run, schema)
