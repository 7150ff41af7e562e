"""WARC archives in Zstandard: a writer, and a reader that validates what it reads.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record is one
Zstandard frame. Archives lie in the shared folder; writer and reader stream, so a task holds one
record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashstore
from .common import checkpoint, filesystem, shared_dir

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: The dictionary is trained on at most this many payloads of at most SAMPLE_BYTES; it affects the size only.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 512, 65536, 65536
#: Uncompressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A frame, header or length that doesn't hold."""


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, date: str) -> bytes:
    """The bytes of one record: a response, or a revisit of page `refers_to` that keeps only the HTTP head."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, sha1_hex)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, sha1_hex)), ("X-Refers-To-Page", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers, HTTP length and payload of one record; raises WarcError where anything doesn't fit."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        raise WarcError("not a WARC record")
    headers = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"bad header line {line[:40]!r}")
        headers[name.decode().lower()] = value.strip().decode()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise WarcError(f"no {need}")
    block = data[end + 4 : -4]
    if data[-4:] != b"\r\n\r\n" or not headers["content-length"].isdigit() or len(block) != int(headers["content-length"]):
        raise WarcError(f"block of {len(block)} bytes, not {headers['content-length']}")
    http, gap, payload = block.partition(b"\r\n\r\n")
    lengths = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not http.startswith(b"HTTP/") or not gap or len(lengths) != 1 or not lengths[0].isdigit():
        raise WarcError("bad HTTP head")
    digest = headers.get("warc-payload-digest", "")
    if not digest.startswith("sha1:"):
        raise WarcError("no payload digest")
    sha1 = base64.b32decode(digest[5:]).hex()
    if headers["warc-type"] == "response":
        if len(payload) != int(lengths[0]):
            raise WarcError(f"payload of {len(payload)} bytes, not {lengths[0].decode()}")
        if hashlib.sha1(payload).hexdigest() != sha1:
            raise WarcError("payload digest doesn't match")
    elif headers["warc-type"] != "revisit" or payload or headers.get("warc-profile") != PROFILE:
        raise WarcError(f"bad {headers['warc-type']} record")
    return {"headers": headers, "length": int(lengths[0]), "sha1": sha1, "payload": payload}


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary, or none where there is too little to learn from."""
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstd.ZstdError:
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    packed = zstd.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", DICT_MAGIC, len(packed)) + packed


def read_archive(stream) -> iter:
    """Yield the uncompressed bytes of each record of a binary stream."""
    head = stream.read(8)
    dictionary, rest = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_MAGIC:
        size = struct.unpack("<I", head[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise WarcError("the dictionary frame is cut short")
        if len(raw) >= 4 and struct.unpack("<I", raw[:4])[0] == FRAME_MAGIC:
            raw = zstd.ZstdDecompressor().decompress(raw)
        dictionary, rest = zstd.ZstdCompressionDict(raw), b""
    decoder = zstd.ZstdDecompressor(dict_data=dictionary) if dictionary else zstd.ZstdDecompressor()
    one, parts = None, []
    while True:
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                if one is not None:
                    raise WarcError("the last frame is cut short")
                return
        if one is None:
            one, parts = decoder.decompressobj(), []
        try:
            parts.append(one.decompress(rest))
        except zstd.ZstdError as e:
            raise WarcError(f"bad frame: {e}") from e
        rest = one.unused_data
        if one.eof:
            yield b"".join(parts)
            one = None


def winners(pages: DataFrame, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """(h, best): of the payloads of REVISIT_BYTES or more that several pages have, a hash of the digest and the largest page_id.

    A map-side-combined aggregate over digests; no payload is shuffled.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    large = pages.where(F.octet_length(body) >= REVISIT_BYTES)
    groups = large.groupBy(F.xxhash64(F.sha1(body.cast("binary"))).alias("h")).agg(F.max(F.col(id_col).cast("long")).alias("best"), F.count("*").alias("n"))
    return groups.where("n > 1 AND best IS NOT NULL").select("h", "best")


def write(pages: DataFrame, folder: str | None = None, date: str = "2026-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write every page to archives below a shared folder; returns the manifest (path, records, bytes), checkpointed.

    Tasks look the responses of repeated payloads up in a store of sorted hashes, so that pages are written where they are
    read. Repeated rows of a response's id are responses too. A null html is an empty payload; null ids and urls are allowed. A task that is run again writes archives of
    its own, and only those of the attempt that succeeded are in the manifest.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    body = body_col
    every = max(1, pages.count() // (2 * SAMPLE_ROWS))
    sample = pages.where(F.octet_length(F.col(body)).between(1, SAMPLE_BYTES) & (F.pmod(F.xxhash64(body), F.lit(every)) == 0)).limit(SAMPLE_ROWS).select(body)
    dictionary = train_dictionary([r[0].encode() for r in sample.collect()])
    bits = max(4, min(16, pages.rdd.getNumPartitions().bit_length()))
    known = hashstore.build(winners(pages, id_col, body_col), shared_dir(spark), bits, ["best"], ["<i8"])

    def save(batches):
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        packer = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(dictionary)) if dictionary else zstd.ZstdCompressor(level=3)
        out, name, n, size, done = None, "", 0, 0, []

        def close():
            out.close()
            done.append((f"{root}/{name}", n, size))

        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            order = np.argsort(h)
            found, (best,) = known.lookup(h[order])
            other: list[int | None] = [None] * len(h)
            for i, ok, k in zip(order.tolist(), found.tolist(), best.tolist(), strict=True):
                other[i] = k if ok else None
            for r, response in zip(b.to_pylist(), other, strict=True):
                refers_to = None if len(r["payload"]) < REVISIT_BYTES or response == r["page_id"] else response
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(f"{root}/{name}")
                    if dictionary:
                        out.write(leading_frame(dictionary))
                data = record(r["page_id"], r["url"], r["payload"], r["payload_digest"], refers_to, date)
                out.write(packer.compress(data))
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    digest = F.sha1(payload)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), digest.alias("payload_digest"), F.xxhash64(digest).alias("h"))
    manifest = rows.mapInArrow(save, "path string, records long, bytes long")
    return checkpoint(manifest.withColumn("folder", F.lit(folder)))


def read(manifest: DataFrame) -> DataFrame:
    """Read archives back, a task for each: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    One row for each record, repeated ones too; an empty payload has 0 bytes, a null id stays null, a null url reads about:blank; an
    empty manifest gives no rows. What is cut short or doesn't fit its lengths and digests raises WarcError.
    """

    def load(batches):
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for r in b.to_pylist():
                store, _ = filesystem(r["folder"])
                with store.open_input_stream(r["path"]) as f:
                    rows, size, n = [], 0, 0
                    for data in read_archive(f):
                        x, n = parse(data), n + 1
                        h = x["headers"]
                        whole = x["payload"].decode() if h["warc-type"] == "response" else None
                        page, other = h.get("x-page-id"), h.get("x-refers-to-page")
                        rows.append((int(page) if page else None, h.get("warc-target-uri"), whole, x["length"], x["sha1"], h["warc-type"], int(other) if other else None))
                        size += len(data)
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)
                    if n != r["records"]:
                        raise WarcError(f"{r['path']} has {n} records, not {r['records']}")

    dealt = manifest.repartition(max(1, manifest.count()))
    return dealt.mapInArrow(load, "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long")
