"""Token ids in files of fixed-width bit packing.

Each id takes the fewest bits that hold the vocabulary.  A file is: a 16-byte head (mark, width, ids a block), blocks of
packed ids, an index (doc_id, whether it is null, first id of each document; byte offset of each block) and a 24-byte foot.
Groups of 64 ids fill ``width`` 64-bit words, so packing and unpacking are a few vector operations a group, and ids can be
read from any place of a file by its block offsets.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, filesystem, new_path, ship, spans, with_docs
from .tokens import TextEncoder, encoder

MARK = b"FOLDPCK1"
BLOCK = 1 << 14
#: Bytes of texts to encode together: the more, the less often a part is looked up, or learned again.
SLICE = 4 << 20
#: Parts that a worker remembers here, where little else needs its executor's memory.
KEEP = 1_200_000
MANIFEST = "part int, path string, docs long, ids long"


_WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids, padded with zeros to groups of 64, as little-endian 64-bit words."""
    n = -(-len(ids) // 64)
    if width in _WHOLE:  # the same layout, made by a cast
        out = np.zeros(n * 64, _WHOLE[width])
        out[: len(ids)] = ids
        return out.tobytes()
    grid = np.zeros((n, 64), np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    words = np.zeros((n, width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[:, word] |= grid[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= grid[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack_bits(body: bytes, width: int) -> np.ndarray:
    """All ids of packed groups, the padding too, as 32-bit integers."""
    if width in _WHOLE:
        return np.frombuffer(body, _WHOLE[width]).astype(np.uint32)
    words = np.frombuffer(body, "<u8").reshape(-1, width)
    grid = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        grid[:, j] = x & mask
    return grid.reshape(-1)


class Writer:
    """Writes documents in the order given, holding one block and the index."""

    def __init__(self, path: str, width: int, block: int = BLOCK):
        self._fs, at = filesystem(path)
        self._fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self._out = self._fs.open_output_stream(at, compression=None)
        self._width, self._block, self._rest, self._held = width, block, [], 0
        self._docs, self._null, self._starts, self._offsets, self.ids = [], [], [], [], 0
        self._at = self._out.write(MARK + struct.pack("<II", width, block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append(doc_id or 0)
        self._null.append(doc_id is None)
        self._starts.append(self.ids)
        self.ids += len(ids)
        self._rest.append(ids)
        self._held += len(ids)
        if self._held >= 16 * self._block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        have = np.concatenate(self._rest) if self._rest else np.zeros(0, np.uint32)
        full = len(have) if last else len(have) // self._block * self._block
        for i in range(0, full, self._block):
            self._offsets.append(self._at)
            self._at += self._out.write(pack_bits(have[i : min(i + self._block, full)], self._width))
        self._rest, self._held = [have[full:]], len(have) - full

    def close(self) -> None:
        self._flush(True)
        index = b"".join(
            np.asarray(x, kind).tobytes()
            for x, kind in ((self._docs, "<i8"), (self._null, "u1"), ([*self._starts, self.ids], "<i8"), ([*self._offsets, self._at], "<i8"))
        )
        self._out.write(index + struct.pack("<qq", len(self._docs), len(self._offsets)) + MARK)
        self._out.close()


class Reader:
    """Random access to one file: ``ids(lo, hi)`` reads only the blocks it needs."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self._in = fs.open_input_file(at)
        size = self._in.size()
        foot = self._in.read_at(24, size - 24)
        if foot[16:] != MARK:
            raise ValueError(f"{path} is not whole")
        docs, blocks = struct.unpack("<qq", foot[:16])
        mark, self.width, self.block = struct.unpack("<8sII", self._in.read_at(16, 0))
        length = docs * 9 + (docs + 1) * 8 + (blocks + 1) * 8
        index = self._in.read_at(length, size - 24 - length)
        self.doc_ids = np.frombuffer(index, "<i8", docs)
        self.null = np.frombuffer(index, "u1", docs, docs * 8).astype(bool)
        self.starts = np.frombuffer(index, "<i8", docs + 1, docs * 9)
        self.offsets = np.frombuffer(index, "<i8", blocks + 1, docs * 9 + (docs + 1) * 8)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        if hi <= lo:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block, -(-hi // self.block)
        body = self._in.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        return unpack_bits(body, self.width)[lo - a * self.block : hi - a * self.block]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id in this file, ids), reading about ``most`` ids at once."""
        at, n = 0, len(self.doc_ids)
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + most, "right")) - 1)
            base = int(self.starts[at])
            some = self.ids(base, int(self.starts[to]))
            for i in range(at, to):
                a, b = int(self.starts[i]), int(self.starts[i + 1])
                yield (None if self.null[i] else int(self.doc_ids[i])), a, some[a - base : b - base]
            at = to


def encoded(enc: TextEncoder, texts: pa.Array, end_id: int, kind: str) -> list[bytes]:
    """The ids of each text and ``end_id``, as numbers of ``kind``."""
    end, got = np.array([end_id], "<u4").tobytes(), []
    for at, to in spans(texts, SLICE):
        got += [np.frombuffer(b + end, "<u4").astype(kind).tobytes() for b in enc.encode(texts.slice(at, to - at))]
    return got


def write_ids(
    docs: DataFrame, tokenizer: str, folder: str, *, vocabulary: int, end_id: int, parts: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> list[tuple[int, str, int, int]]:
    """Encode whole texts, end each with ``end_id`` and write one file a range of doc_id; the manifest is returned.

    Ids lie in ascending doc_id order, null first, repeated rows beside each other; a null or empty text is its end id
    alone; an empty table writes no file.  Ranges follow the quantiles of doc_id, so a hot source or a group of copies
    spreads like all else.  Whole texts are encoded however long they are; their strings of special tokens are these tokens.  A file that a lost executor left behind is in no manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = with_docs(docs, doc_id, text)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [], np.float64)
    width = bits_for(vocabulary)
    kind = "<u2" if width <= 16 else "<u4"

    def encode(_: dict, batch) -> dict:
        got = encoded(encoder(tokenizer, KEEP), batch.column(1), end_id, kind)
        names = batch.column(0)
        number = np.asarray(names.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), np.float64)
        return {"part": pa.array(np.searchsorted(bounds, number, "left").astype(np.int32)), "doc_id": names, "ids": pa.array(got, pa.binary())}

    coded = arrow_map(docs, encode, "part int, doc_id long, ids binary")

    def write(batches):
        import pyarrow as pa

        out, part, path, count, last = None, None, None, 0, []
        for b in batches:
            for p, name, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    if out:
                        out.close()
                        last.append((part, path, count, out.ids))
                    part, count, path = p, 0, f"{folder}/ids-{p:06d}-{uuid.uuid4().hex[:8]}.bin"
                    out = Writer(path, width)
                out.add(name, np.frombuffer(body, kind).astype(np.uint32))
                count += 1
        if out:
            out.close()
            last.append((part, path, count, out.ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in last], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "path", "docs", "ids"]
        )

    ordered = coded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    return sorted(tuple(r) for r in ordered.mapInArrow(write, MANIFEST).collect())  # one row a file


def read_ids(spark: SparkSession, manifest: list[tuple[int, str, int, int]], with_ids: bool = False) -> DataFrame:
    """A row a document, read back from the files: doc_id, ids before it, how many it has, their crc32 and if wished the ids."""
    ship(spark)
    starts = np.cumsum([0, *(m[3] for m in manifest)]).tolist()
    files = spark.createDataFrame([(m[1], s) for m, s in zip(manifest, starts, strict=False)], "path string, base long")

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for name, start, ids in Reader(path).documents():
                    body = ids.astype("<u4").tobytes()
                    rows.append((name, base + start, len(ids), zlib.crc32(body), body if with_ids else None))
                    if len(rows) >= (500 if with_ids else 10000):
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]):
        import pyarrow as pa

        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return files.repartition(max(1, min(len(manifest), 4096))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def encode_to_files(docs: DataFrame, tokenizer: str, *, vocabulary: int, end_id: int, **options) -> DataFrame:
    """Write the files in the shared folder and give what is read back from them."""
    folder = new_path(docs.sparkSession, "token-ids")
    return read_ids(docs.sparkSession, write_ids(docs, tokenizer, folder, vocabulary=vocabulary, end_id=end_id, **options))
