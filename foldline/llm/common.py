"""What the operators of this package share: shipping code, the shared folder, Arrow streams, word hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])

#: ASCII lower case for byte strings; ``bytes.lower`` touches A-Z alone.
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
#: Keeps digits, a-z (A-Z lowered) and every byte from 0x80; all else becomes a space.
ALNUM = bytes(
    (b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32
    for b in range(256)
)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the cluster shares its install path."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or on a local master, where unset, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="foldline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: What this process has made in the shared folder and not deleted.
_MADE: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Delete the tables, archives and token files that operators' results still read, once these results are no longer needed;
    how many there were.  Operators delete by themselves what only they read."""
    paths = sorted(_MADE)
    delete(spark, *paths)
    return len(paths)


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _MADE.discard(path)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """Tables written in the shared folder: each cuts its lineage and survives the loss of an executor.

    While one is written, Python gets batches of about ``batch_bytes`` if given: texts lie in a batch several times over, in the JVM
    and in Python.
    """

    def __init__(self, spark: SparkSession, batch_bytes: int | None = None):
        self.spark, self.paths, self.labels, self.batch_bytes = spark, {}, "", batch_bytes

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path, conf = new_path(self.spark, name), self.spark.conf
        before = conf.get(_BATCH, None)
        try:
            if self.batch_bytes:
                conf.set(_BATCH, str(self.batch_bytes))
            df.write.parquet(path)
        finally:
            if self.batch_bytes:
                conf.unset(_BATCH) if before is None else conf.set(_BATCH, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        delete(self.spark, *(self.paths.pop(n) for n in names if n in self.paths))


    def few(self, df: DataFrame, most: int = 50_000) -> bool:
        """Whether so small a table may be broadcast."""
        return df.limit(most + 1).count() <= most

    def collect_garbage(self) -> None:
        """Let the driver drop plans that have run, and with them their shuffle files."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def sieve(rows: DataFrame, column: str, ids: DataFrame, words: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``column`` may be among ``ids`` (of one column), and those whose is not, which need no shuffle.

    A bit for each hash of an id, in at most ``words`` words of 64, is broadcast.  All rows of such ids are in the first part;
    how many others are there with them depends on ``words``, so a join must follow.
    """

    def place(c: Column) -> tuple[Column, Column]:
        h = F.xxhash64(c.cast("long"))
        return F.pmod(h, F.lit(words)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")

    word, bit = place(F.col(ids.columns[0]))
    bits = ids.select(word.alias("_sieve_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_sieve_bits"))
    bits = bits.groupBy("_sieve_word").agg(F.bit_or("_sieve_bits").alias("_sieve_bits"))
    word, bit = place(rows[column])
    hit = (word == bits["_sieve_word"]) & (F.call_function("shiftrightunsigned", bits["_sieve_bits"], bit).bitwiseAND(F.lit(1)) == 1)
    return rows.join(F.broadcast(bits), hit, "left_semi"), rows.join(F.broadcast(bits), hit, "left_anti")


def filesystem(uri: str):
    """(file system, path) of a URI or a plain path, for Python code on any machine."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def arrow_map(df: DataFrame, fn: Callable[[dict, pa.RecordBatch], dict | pa.RecordBatch | None], schema: str, setup: Callable | None = None, lean: bool = False) -> DataFrame:
    """``mapInArrow`` with state: ``setup()`` runs once a task, ``fn(state, batch)`` gives the columns of one batch.

    Empty batches and empty partitions are passed over.  A ``lean`` one gives back at the end of each task what it held.
    """
    ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema)) if isinstance(schema, str) else to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else {}
        for b in batches:
            if b.num_rows and (cols := fn(state, b)) is not None:
                yield cols if isinstance(cols, pa.RecordBatch) else record_batch(cols, out)

    return df.mapInArrow(tidy(run) if lean else run, schema)


def give_back() -> None:
    """Return to the system what this worker's allocators hold free, as a worker waits for its next task with all it ever took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidy(run: Callable) -> Callable:
    """``run`` of ``mapInArrow``, giving back at the end of each task what it held."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def record_batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        x = cols[f.name]
        if isinstance(x, pa.ChunkedArray):
            x = x.combine_chunks()
        arrays.append(x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts(column: pa.Array) -> list[str]:
    """Strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty, without making Python strings."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def spans(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of neighbours of about ``limit`` bytes together; a longer text is its own range."""
    n = len(column)
    if not n:
        return
    sizes = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield at, to
        at = to


def pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of neighbours of about ``limit`` bytes together, so that few texts are held twice."""
    for at, to in spans(column, limit):
        yield at, raw(column.slice(at, to - at))


def with_docs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Just the two columns an operator reads, under fixed names, so that no other column can clash."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


# -- word hashing ------------------------------------------------------------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit finisher (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in ((0, _BASE), (1, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array; words are runs without ASCII white space."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _IS_SPACE[data], [True])).view(np.int8)))
    return edge[0::2], edge[1::2]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of a byte array: a polynomial of random letter values, finished by a strong mix."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = _powers(1 << max(16, (n + 1).bit_length()))
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * p[:n], out=acc[1:])
    return mix64((acc[ends] - acc[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def doc_groups(bodies: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbours of about ``limit`` bytes together; a longer text is its own range."""
    first, size = 0, 0
    for i, b in enumerate(bodies):
        if i > first and size + len(b) > limit:
            yield first, i
            first, size = i, 0
        size += len(b) + 1
    if first < len(bodies):
        yield first, len(bodies)


def group_words(bodies: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts taken together: bytes, word starts, word ends, word hashes, and the first word of each text (with an end mark)."""
    joined = b"\n".join(bodies)
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    starts, ends = word_spans(data)
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    at = np.concatenate(([0], np.cumsum(lengths + 1)))
    return data, starts, ends, hash_words(data, starts, ends), np.searchsorted(starts, at)
