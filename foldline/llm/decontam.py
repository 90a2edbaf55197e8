"""Benchmark decontamination: an FM-index for each shard of training text, searched for every test phrase.

A shard's words become symbols of the test vocabulary.  Words outside it can be in no phrase, so they only part the text
into segments; segments shorter than the shortest phrase hold no occurrence and aren't indexed.  The rest gets a suffix
array (prefix doubling), its Burrows-Wheeler transform as a wavelet matrix, and sampled suffix positions.  Phrases are
found by backward search over all of them at once, located by walking to a sampled position, and their spans merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, raw, ship, tidy, with_docs

FOUND = "n_words long, n_hit long, items array<long>, spans array<struct<start:int,words:int>>"


def words_of(body: bytes) -> list[bytes]:
    """Words as runs of digits, letters (A-Z lowered) and all that isn't ASCII."""
    return body.translate(ALNUM).split()


class WaveletMatrix:
    """Rank over a sequence of small integers, one bit plane a level, vectorised over many queries."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.n = levels, len(seq)
        self._words, self._before, self._zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self._words.append(words)
            self._before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
            self._zeros.append(self.n - int(bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self._before[k][w] + np.bitwise_count(self._words[k][w] & mask).astype(np.int64)

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` goes on the path of ``symbol``; the difference of two places is a count of the symbol."""
        for k in range(self.levels):
            ones = self._ones(k, at)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self._zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self.place(symbol, at) - self.place(symbol, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        got = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit = (self._words[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(k, at)
            got = got << 1 | bit
            at = np.where(bit, self._zeros[k] + ones, at - ones)
        return got


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; every 0 is an end mark of its own, ordered by place."""
    ends = symbols == 0
    rank = symbols.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    n, step = len(rank), 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (n + int(rank.max()) + 2) + nxt if step == 1 else rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1 or step > n:
            return order
        step *= 2


class FMIndex:
    """Counts and locates phrases in ``symbols``; 0 ends a segment and is in no phrase."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 32):
        order = suffix_array(symbols)
        before = symbols[order - 1]
        before[order == 0] = 0
        self.wavelet = WaveletMatrix(before.astype(np.int64), max(1, int(alphabet).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))))
        marked = (order % sample == 0) | (before == 0)  # a walk never passes an end mark
        self._marked, self._where = marked, np.cumsum(marked) - 1
        self._positions = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases of one length: which occur, and their rows from and to."""
        live = np.arange(len(phrases))
        last = phrases[:, -1]
        lo, hi = self.first[last], self.first[last + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            on = hi > lo
            live, lo, hi = live[on], lo[on], hi[on]
            c = phrases[live, j]
            lo, hi = self.first[c] + self.wavelet.rank(c, lo), self.first[c] + self.wavelet.rank(c, hi)
        on = hi > lo
        return live[on], lo[on], hi[on]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, steps, left = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(left):
            done = self._marked[rows]
            out[left[done]] = self._positions[self._where[rows[done]]] + steps[left[done]]
            left, rows = left[~done], rows[~done]
            c = self.wavelet.access(rows)
            rows = self.first[c] + self.wavelet.rank(c, rows)
            steps[left] += 1
        return out


class Phrases:
    """The distinct windows of test items, by length, and the items each is from."""

    def __init__(self, items: Iterable[tuple[int | None, bytes]], window: int = 10):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, body in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(body)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.by_length = {}
        for n in sorted({len(w) for w in found}):
            some = [w for w in found if len(w) == n]
            self.by_length[n] = (np.array(some, np.int64), [sorted(x for x in found[w] if x is not None) for w in some])
        self.shortest = min(self.by_length, default=0)

    def scan(self, bodies: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[list[int]]]:
        """Of a shard's documents: words, which words are hit, and the items that occur."""
        get, lengths, parts = self.vocabulary.get, [], []
        for b in bodies:
            ws = words_of(b)
            lengths.append(len(ws))
            parts.append(np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws)))
            parts.append(np.zeros(1, np.int32))
        at = np.cumsum([0, *(n + 1 for n in lengths)])
        items: list[set] = [set() for _ in bodies]
        edges = np.zeros(int(at[-1]) + 1, np.int64)
        if self.by_length:
            seq = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            known = np.concatenate(([False], seq > 0, [False])).view(np.int8)
            turn = np.flatnonzero(np.diff(known))
            begin, end = turn[0::2], turn[1::2]
            long_enough = end - begin >= self.shortest
            begin, end = begin[long_enough], end[long_enough]
            if len(begin):
                size = end - begin + 1
                start = np.cumsum(size) - size
                source = np.repeat(begin - start, size) + np.arange(int(size.sum()))
                symbols = seq[source].astype(np.int64)
                symbols[start + size - 1] = 0
                index = FMIndex(symbols, len(self.vocabulary))
                for n, (phrases, of) in self.by_length.items():
                    which, lo, hi = index.search(phrases)
                    count = hi - lo
                    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    where = source[index.locate(rows)]
                    edges[where] += 1
                    edges[where + n] -= 1
                    docs = np.searchsorted(at, where, "right") - 1
                    for d, p in np.unique(np.stack((docs, np.repeat(which, count)), 1), axis=0).tolist():
                        items[d].update(of[p])
        hit = np.cumsum(edges) > 0
        return np.array(lengths, np.int64), [hit[a : a + n] for a, n in zip(at.tolist(), lengths, strict=False)], [sorted(x) for x in items]


def spans_of(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"start": a, "words": b - a} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, most: int) -> Iterator[Phrases]:
    """Phrases of at most about ``most`` bytes of items together, so that what is broadcast has a bound."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("string")).toLocalIterator():
        body = (r[1] or "").encode()
        if held and size + len(body) > most:
            yield Phrases(held, window)
            held, size = [], 0
        held.append((r[0], body))
        size += len(body)
    yield Phrases(held, window)


def shards(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``most`` bytes of text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t.combine_chunks().to_batches()[0]


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shard_bytes: int = 24 << 20,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """A row a document: words, words hit, items whose windows occur, and the merged spans of hit words.

    Nothing is shuffled: each partition indexes its own shards.  A benchmark above ``block_bytes`` is searched in blocks,
    one pass after another, spans and items being merged.  A null or empty text has no words and no hits; an item without
    words has no window; an item of null id marks words but isn't counted; repeated rows each get their row; an empty
    benchmark hits nothing.
    """
    ship(docs.sparkSession)
    df = with_docs(docs, doc_id, text)
    for k, phrases in enumerate(blocks(benchmark, item_id, item_text, window, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(phrases)

        def run(batches, shared=shared, k=k):
            for b in shards(batches, "text", shard_bytes):
                lengths, hits, items = shared.value.scan(raw(b.column(1)))
                if k:
                    for i, (old, spans) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                        items[i] = sorted({*items[i], *old})
                        for s in spans:
                            hits[i][s["start"] : s["start"] + s["words"]] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        b.column(1),
                        pa.array(lengths),
                        pa.array([int(h.sum()) for h in hits], pa.int64()),
                        pa.array(items, pa.list_(pa.int64())),
                        pa.array([spans_of(h) for h in hits], pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))),
                    ],
                    names=["doc_id", "text", "n_words", "n_hit", "items", "spans"],
                )

        df = df.mapInArrow(run, f"doc_id long, text string, {FOUND}")
    return df


def without(body: bytes, hit: np.ndarray) -> bytes:
    """A text without its hit words and what lies between two of one span."""
    data = np.frombuffer(body.translate(ALNUM), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], data == 32, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    out, at = [], 0
    for s in spans_of(hit):
        out.append(body[at : starts[s["start"]]])
        at = int(ends[s["start"] + s["words"] - 1])
    return b"".join([*out, body[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", n_chars: str = "n_chars", shard_bytes: int = 24 << 20, block_bytes: int = 8 << 20) -> DataFrame:
    """All columns of ``docs``, with the merged spans cut from the text and ``n_chars`` (where there is one) set anew.

    Cutting is repeated until nothing occurs any more, since what lay around a span may itself form a window.  Each time, what
    all blocks of the benchmark hit in a text is cut together, so that neither their bounds nor their order count.  A document
    that loses all its words is left out; untouched rows pass as they are, null and empty texts, repeated rows and null ids too;
    very long texts are searched whole; an empty table gives no rows, an empty benchmark touches none.
    """
    ship(docs.sparkSession)
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in blocks(benchmark, "item_id", "text", window, block_bytes)]

    def scan(bodies: list[bytes]) -> list[np.ndarray]:
        _, hits, _ = shared[0].value.scan(bodies)
        for more in shared[1:]:
            _, found, _ = more.value.scan(bodies)
            hits = [a | b for a, b in zip(hits, found, strict=True)]
        return hits

    def run(batches):
        for b in shards(batches, text, shard_bytes):
            at = b.schema.get_field_index(text)
            bodies = raw(b.column(at))
            hits = scan(bodies)
            touched = [i for i, h in enumerate(hits) if h.any()]
            if touched:
                todo, new = touched, b.column(at).to_pylist()
                while todo:
                    some = [without(bodies[i], hits[i]) for i in todo]
                    for i, body, h in zip(todo, some, scan(some), strict=True):
                        bodies[i], hits[i], new[i] = body, h, body.decode()
                    todo = [i for i in todo if hits[i].any()]
                cols = list(b.columns)
                cols[at] = pa.array(new, b.schema.field(at).type)
                if (n := b.schema.get_field_index(n_chars)) >= 0:
                    counts = cols[n].to_pylist()
                    for i in touched:
                        counts[i] = len(new[i])
                    cols[n] = pa.array(counts, b.schema.field(n).type)
                keep = np.ones(b.num_rows, bool)
                keep[[i for i in touched if not words_of(bodies[i])]] = False
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(keep))
            yield b

    return docs.mapInArrow(tidy(run), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what ``find`` gives."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
