"""WARC archives in zstd with a dictionary of their own records.

An archive starts with a skippable frame that holds the dictionary, built from the archive's first records; each record
after it is a frame by itself.  Records of equal payload are written once: the one with the largest page_id is the
response, the others are revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, filesystem, new_path, ship

SKIPPABLE = 0x184D2A5D
SALTS = 64
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP head alone, with length and digest of the full payload."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {date}",
        "WARC-Payload-Digest: sha1:" + base32_sha1(payload),
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(body: bytes) -> dict:
    """Header fields (lower case), the page's number, and the payload (None for a revisit)."""
    head, _, rest = body.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    got: dict = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(got["content-length"])]
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    got["page"], got["refers"] = number(got["warc-record-id"]), number(got.get("warc-refers-to"))
    got["payload"] = block.partition(b"\r\n\r\n")[2] if got["warc-type"] == "response" else None
    return got


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or where there is too little to train on, the samples' own bytes."""
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive: holds back about ``sample`` bytes of records to build the dictionary from."""

    def __init__(self, path: str, level: int = 3, sample: int = 1 << 20, size: int = 32 << 10):
        fs, at = filesystem(path)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self._out, self._level, self._sample, self._size = fs.open_output_stream(at, compression=None), level, sample, size
        self._held, self._bytes, self._press, self.records = [], 0, None, 0

    def add(self, body: bytes) -> None:
        self.records += 1
        if self._press:
            self._out.write(self._press.compress(body))
            return
        self._held.append(body)
        self._bytes += len(body)
        if self._bytes >= self._sample:
            self._start()

    def _start(self) -> None:
        made = dictionary([x[i : i + 4096] for x in self._held for i in range(0, min(len(x), 65536), 4096)], self._size)
        body = made.as_bytes()
        self._out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self._press = zstandard.ZstdCompressor(level=self._level, dict_data=made)
        for x in self._held:
            self._out.write(self._press.compress(x))
        self._held = []

    def close(self) -> None:
        if not self._press:
            self._start()
        self._out.close()


def read_archive(path: str, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    fs, at = filesystem(path)
    with fs.open_input_stream(at, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} has no dictionary frame")
        body = f.read(size)
        kind = zstandard.DICT_TYPE_AUTO if body[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        open_frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind))
        rest, parts, frame = b"", [], None
        while True:
            if not rest and not (rest := f.read(chunk)):
                break
            frame = frame or open_frame.decompressobj()
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                yield b"".join(parts)
                parts, frame = [], None
            else:
                rest = b""
        if frame:
            raise ValueError(f"{path} ends within a record")


def classify(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to (null for responses).

    Only digests are grouped (with partial aggregation).  Payloads move once, to the row of their digest; digests that more than
    one in a thousand rows have (there can't be over a thousand such, so they are broadcast) are split over many tasks.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    last = rows.groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    last = Scratch(pages.sparkSession).keep(last, "digests")
    total = last.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(total / 1000, 100)
    rows = rows.join(F.broadcast(last.filter(hot).select("key", F.lit(True).alias("hot"))), "key", "left")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(0))
    last = last.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(hot, F.lit(SALTS - 1)).otherwise(0).cast("long"))))
    old = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last"))) & (F.octet_length("payload") >= least)
    return rows.join(last, ["key", "salt"]).select("page_id", "url", "payload", F.when(old, F.col("last")).alias("refers_to"))


def write(rows: DataFrame, folder: str, *, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> list[tuple[str, int]]:
    """One archive a partition; (path, records) of each.  What a lost executor left behind is in no such list."""
    ship(rows.sparkSession)

    def run(batches):
        out, path = None, f"{folder}/{uuid.uuid4().hex}.warc.zst"
        for b in batches:
            for page, url, payload, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                out = out or Archive(path, level)
                out.add(record(page, url, payload, refers, date))
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([path] if out else [], pa.string()), pa.array([out.records] if out else [], pa.int64())], names=["path", "records"])

    return sorted(tuple(r) for r in rows.mapInArrow(run, "path string, records long").collect())  # one row a file


def read(spark: SparkSession, files: list[tuple[str, int]], with_payload: bool = False) -> DataFrame:
    """A row a record, from the archives."""
    ship(spark)
    paths = spark.createDataFrame([(f[0],) for f in files], "path string").repartition(max(1, min(len(files), 4096)))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                for x in map(parse, read_archive(path)):
                    if x["payload"] is not None and (len(x["payload"]) != int(x["warc-payload-length"]) or "sha1:" + base32_sha1(x["payload"]) != x["warc-payload-digest"]):
                        raise ValueError(f"{path}: a payload isn't what was written")
                    rows.append((x["page"], x.get("warc-target-uri"), int(x["warc-payload-length"]), x["warc-payload-digest"][5:], x["warc-type"], x["refers"], x["payload"] if with_payload else None))
                    if len(rows) >= (200 if with_payload else 5000):
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return paths.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, *, least: int = 0, level: int = 3, with_payload: bool = False, **columns: str) -> DataFrame:
    """Write all pages to archives in the shared folder and give what is read back from them.

    A null html is an empty payload.  A payload shorter than ``least`` bytes is always a response.  Rows that share the
    largest page_id of a payload are all responses, of one record id; a null page_id revisits any that is not null.  Very
    long payloads are written whole, each held once.  An empty table writes no archive.
    """
    spark = pages.sparkSession
    return read(spark, write(classify(pages, least=least, **columns), new_path(spark, "warc"), level=level), with_payload)
