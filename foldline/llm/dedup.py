"""Near duplicates by b-bit MinHash.

Texts of one shingle set are one class from the start, so copies never meet each other.  Of each class, minima of 100 hash
functions are taken; 20 bands of five give candidate buckets, and the minima's low four bits, packed into words, estimate a
pair's similarity by bit counts, corrected for chance collisions.  Pairs that may reach the threshold (five standard
deviations are allowed for) are confirmed on the full shingle sets.  A link at exactly 0.85 shares no band with probability
8.1e-6 and is under the estimate's bound with 1.3e-6; links above it are missed more rarely, and only where no other link
joins the same documents does a missed one change the result.

Buckets of up to ``small`` classes are compared in memory.  In larger ones every class meets a pivot; then the classes
outside the bucket's main component meet all of it where they are few.  Where they are many, the bucket's classes are
bucketed anew by their rarest shingles, so many of each that two sets of the threshold share one: what much of the bucket
has in common brings nothing together any more.  What is large even then are classes that are alike, or nearly so; buckets
that share classes are one group, whose classes outside its main component meet all of it in blocks of bounded size, each
pair once, in one round however large the group is.  No pair of a bucket is left out.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, doc_groups, group_words, mix64, raw, ship, sieve, tidy, with_docs

BANDS, ROWS, BITS = 20, 5, 4
HASHES = BANDS * ROWS
SIG_WORDS = -(-HASHES * BITS // 64)
_rng = np.random.default_rng(85)
_MUL = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_A, _B, _C = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shingles(words: np.ndarray, width: int = 3) -> np.ndarray:
    """Hashes of the distinct runs of ``width`` words, sorted; of a shorter text, of the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, width)
    acc = np.full(n - k + 1, k if n < width else 0, np.uint64)
    for j in range(k):
        acc = (acc + words[j : n - k + 1 + j]) * (_A, _B, _C)[j % 3] + np.uint64(j + 1)
        acc ^= acc >> np.uint64(29)
    return np.unique(mix64(acc))


def minima(items: np.ndarray) -> np.ndarray:
    x = (items >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (((x[i : i + 2048])[None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for col in low.reshape(BANDS, ROWS).T.astype(np.uint64):
        acc = mix64(acc * _A + col)
    return acc.view(np.int64)


def pack_low(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 16 to a 64-bit word."""
    nibbles = np.zeros(SIG_WORDS * 16, np.uint64)
    nibbles[:HASHES] = low & np.uint32(15)
    return np.bitwise_or.reduce(nibbles.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64)


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal low-bit groups of signatures (last axis: words)."""
    x = (a ^ b).view(np.uint64)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return HASHES - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)


def estimate(equal: np.ndarray | float) -> np.ndarray | float:
    """Similarity from equal groups: chance makes one in ``2**BITS`` of the others equal."""
    chance = 1 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


def least_matches(percent: int, deviations: float = 5.0) -> int:
    """Equal groups below which a pair of similarity ``percent`` falls by that many standard deviations only."""
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * percent / 100
    return int(HASHES * p - deviations * (HASHES * p * (1 - p)) ** 0.5)


def set_key(items: np.ndarray) -> bytes:
    """128 bits of a whole shingle set."""
    return np.array([np.add.reduce(mix64(items + _B)), np.bitwise_xor.reduce(mix64(items * _A)) + np.uint64(len(items))], np.uint64).tobytes()


#: Bytes of texts that are hashed together, and bytes in a batch for Python; they bound what a worker holds besides its result.
TOGETHER, BATCH = 1 << 18, 4 << 20


def shingle_sets(bodies: list[bytes], width: int = 3):
    for lo, hi in doc_groups(bodies, TOGETHER):
        _, _, _, words, first = group_words(bodies[lo:hi])
        for k in range(hi - lo):
            yield shingles(words[first[k] : first[k + 1]], width)


SIGNATURES = "doc_id long, n_shingles long, node binary, bands array<long>, sig array<long>"


def signatures(docs: DataFrame, width: int = 3) -> DataFrame:
    def run(_: dict, b: pa.RecordBatch) -> dict:
        count, node, bands, sig = [], [], [], []
        for items in shingle_sets(raw(b.column(1)), width):
            count.append(len(items))
            if len(items):
                low = minima(items)
                node.append(set_key(items))
                bands.append(band_keys(low))
                sig.append(pack_low(low))
            else:
                node.append(None)
                bands.append(None)
                sig.append(None)
        return {"doc_id": b.column(0), "n_shingles": count, "node": node, "bands": bands, "sig": sig}

    return arrow_map(docs, run, SIGNATURES, lean=True)


def _close(a: str, b: str, least: int):
    """Column: the signatures in columns ``a`` and ``b`` have at least ``least`` equal groups."""
    total = None
    for i in range(SIG_WORDS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = F.bit_count(x) if total is None else total + F.bit_count(x)
    return total <= HASHES - least


def _pair(x: str = "x", y: str = "y") -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


PAIRS = "a binary, b binary, g long"


def small_pairs(rows: DataFrame, least: int) -> DataFrame:
    """Pairs of classes of bounded buckets (key, node, sig) whose low bits agree enough; ``g`` is the bucket."""

    def run(_: dict, batch: pa.RecordBatch) -> dict:
        left, right, group = [], [], []
        for key, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sig = np.array([m["sig"] for m in members], np.int64)
            names = [m["node"] for m in members]
            for i in range(len(names) - 1):
                for j in (np.flatnonzero(matches(sig[i], sig[i + 1 :]) >= least) + i + 1).tolist():
                    a, b = names[i], names[j]
                    left.append(min(a, b))
                    right.append(max(a, b))
                    group.append(key)
        return {"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary()), "g": group}

    return arrow_map(rows.groupBy("key").agg(F.collect_list(F.struct("node", "sig")).alias("m")), run, PAIRS)


def once(pairs: DataFrame) -> DataFrame:
    """Each pair in one group."""
    return pairs.groupBy("a", "b").agg(F.min("g").alias("g"))


def in_bundles(pairs: DataFrame, chunk: int = 64) -> DataFrame:
    """Pairs grouped by their left class, about ``chunk`` partners to a group, so that a class with many partners spreads."""
    degree = pairs.groupBy("a").count()
    return pairs.join(degree, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / chunk))).alias("g"))


def confirm(pairs: DataFrame, bodies: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b, g) that reach the threshold on their full sets.

    The text of a class goes once to each group it has a pair in; groups are bounded, and so is what a task holds.  A pair
    of which a text is missing is not confirmed.
    """
    ship(pairs.sparkSession)
    sides = pairs.select("g", F.col("b").alias("node"), F.col("a").alias("other")).unionByName(pairs.select("g", F.col("a").alias("node"), F.lit(None).cast("binary").alias("other")))
    rows = sides.groupBy("g", "node").agg(F.collect_list("other").alias("others")).join(bodies, "node").select("g", "node", "others", "body")

    def run(batches):
        now, sets, asked = None, {}, []
        left, right = [], []

        def close() -> None:
            for node, others in asked:
                own = sets[node]
                for other in others:
                    items = sets.get(other)
                    if items is None or 100 * min(len(own), len(items)) < percent * max(len(own), len(items)):
                        continue
                    both = np.count_nonzero(own[np.minimum(np.searchsorted(own, items), len(own) - 1)] == items)
                    if 100 * both >= percent * (len(own) + len(items) - both):
                        left.append(other)
                        right.append(node)

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])
            left.clear()
            right.clear()
            return out

        unpress = zstandard.ZstdDecompressor()
        for b in batches:
            texts = [unpress.decompress(x) for x in b.column(3).to_pylist()]
            for g, node, others, items in zip(*(b.column(i).to_pylist() for i in range(3)), shingle_sets(texts, width), strict=True):
                if g != now:
                    close()
                    now, sets, asked = g, {}, []
                sets[node] = items
                if others:
                    asked.append((node, others))
            if len(left) > 10_000:
                yield table()
        close()
        if left:
            yield table()

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(run), "a binary, b binary")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of all nodes in ``links``, the label being the least node of the component.

    Every node takes the least label around it and then its label's label, until nothing changes.
    """
    both = scratch.keep(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        stepped = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("next"))
        up = stepped.select(F.col("node").alias("next"), F.col("next").alias("up"))
        jumped = stepped.join(up, "next").select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved"))
        k += 1
        new = scratch.keep(jumped, f"{name}-{k}")
        moved = new.filter("moved").limit(1).count()
        scratch.drop(f"{name}-{k - 1}")
        labels = new.select("node", "label")
        if not moved:
            scratch.drop(f"{name}-edges")
            scratch.labels = f"{name}-{k}"
            return labels


SUBSETS, SUBSET = 96, 12
_PICKS = np.stack([np.random.default_rng(1200 + t).choice(HASHES, SUBSET, replace=False) for t in range(SUBSETS)])


def sampled_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): of each class (node, sig), a key for each of ``SUBSETS`` samples of its low-bit groups.

    ``Linker`` doesn't use them: where texts share a long passage without being alike, most samples bring most of them together.
    """

    def run(_: dict, b: pa.RecordBatch) -> dict:
        sig = np.array(b.column(1).to_pylist(), np.int64).reshape(-1, SIG_WORDS).view(np.uint64)
        nibbles = (sig[:, :, None] >> (np.arange(16, dtype=np.uint64) * np.uint64(4)) & np.uint64(15)).reshape(len(sig), -1)
        picked = nibbles[:, _PICKS] << (np.arange(SUBSET, dtype=np.uint64) * np.uint64(4))
        keys = mix64(np.bitwise_or.reduce(picked, axis=2) * _A + np.arange(1, SUBSETS + 1, dtype=np.uint64))
        return {"keys": list(keys.view(np.int64)), "node": b.column(0)}

    return arrow_map(nodes.select("node", "sig"), run, "keys array<long>, node binary").select(F.explode("keys").alias("key"), "node")


CELLS = 1 << 20


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many of the rarest of ``n`` shingles a set of at least this size, or of at most this size, has one of if it is alike.

    Sets x and y, y not the larger, that reach the threshold t share t |x| and 2 t / (1 + t) |y| shingles at least.  In any
    one order, what is left of either set after that many less one is without a shared shingle only if fewer are shared.
    """
    return n + (-2 * percent * n) // (100 + percent) + 1, n + (-percent * n) // 100 + 1


def shingle_counts(texts: DataFrame, width: int) -> np.ndarray:
    """In how many texts (node, body) the shingles of each of ``CELLS`` cells of hashes occur; bounded whatever the texts."""

    def run(batches):
        unpress, acc = zstandard.ZstdDecompressor(), np.zeros(CELLS, np.int64)
        for b in batches:
            for body in b.column(1).to_pylist():
                for items in shingle_sets([unpress.decompress(body)], width):
                    np.add.at(acc, (items & np.uint64(CELLS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(acc[at])], names=["cell", "n"])

    ship(texts.sparkSession)
    got = texts.select("node", "body").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.uint32)
    out[got["cell"].to_numpy()] = np.minimum(got["n"].to_numpy(), 0xFFFFFFFF)
    return out


def prefix_keys(texts: DataFrame, counts: np.ndarray, percent: int, width: int, most: int = 1 << 18) -> DataFrame:
    """(key, node, own): the rarest shingles of each text (node, body).

    Of two alike texts, the one of fewer shingles has ``own`` at a key that the other has too.  By any ``counts`` no pair is
    lost; by good ones few others meet.
    """
    spark = texts.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(counts)

    def run(batches):
        unpress, known = zstandard.ZstdDecompressor(), shared.value
        keys, nodes, sizes, owns, held = [], [], [], [], 0

        def table() -> pa.RecordBatch:
            at = np.repeat(np.arange(len(nodes)), sizes)
            own = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(owns, sizes)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(nodes, pa.binary()).take(pa.array(at)), pa.array(own)], names=["key", "node", "own"])

        for b in batches:
            for node, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for items in shingle_sets([unpress.decompress(body)], width):
                    few, many = prefix_lengths(len(items), percent)
                    ranked = items[np.lexsort((items, known[(items & np.uint64(CELLS - 1)).astype(np.int64)]))]
                    keys.append(ranked[:many])
                    nodes.append(node)
                    sizes.append(many)
                    owns.append(few)
                    held += many
                if held >= most:
                    yield table()
                    keys, nodes, sizes, owns, held = [], [], [], [], 0
        if nodes:
            yield table()

    return texts.select("node", "body").mapInArrow(run, "key long, node binary, own boolean")


def _ceil(size, each: int):
    """Column: how many parts of ``each`` there are in ``size``."""
    return F.ceil((F.col(size) if isinstance(size, str) else size) / each)


def met_blocks(rows: DataFrame, percent: int, width: int, least: int) -> DataFrame:
    """Links (a, b) of two blocks of classes (g, asks, node, label, sig, body, out): those that ask meet the others of their ``g``.

    Shared shingles are counted by the block's postings, for all its classes at once, where low bits agree enough with any.  Two
    that both ask meet once, by their order; classes of one label don't meet, nor are links given between what links already join.
    """
    ship(rows.sparkSession)

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        now, held = None, {True: [], False: []}
        left, right = [], []

        def close() -> None:
            asking, asked = held[True], held[False]
            if not asking or not asked:
                return
            sizes = np.array([len(m[3]) for m in asked])
            items, owner = np.concatenate([m[3] for m in asked]), np.repeat(np.arange(len(asked)), sizes)
            order = np.argsort(items, kind="stable")
            items, owner = items[order], owner[order]
            sigs = np.array([m[2] for m in asked], np.int64)
            number: dict[bytes, int] = {}
            label = np.array([number.setdefault(m[1], len(number)) for m in asked])
            rank = np.empty(len(asked), np.int64)
            rank[sorted(range(len(asked)), key=lambda i: asked[i][0])] = np.arange(len(asked))
            names, free = sorted(m[0] for m in asked), np.array([not m[4] for m in asked])
            for node, own, sig, mine, _ in asking:
                own = number.setdefault(own, len(number))
                may = (matches(np.array(sig, np.int64), sigs) >= least) & (label != own) & (free | (rank >= bisect_right(names, node)))
                may &= 100 * np.minimum(sizes, len(mine)) >= percent * np.maximum(sizes, len(mine))
                if not may.any():
                    continue
                lo, hi = np.searchsorted(items, mine, "left"), np.searchsorted(items, mine, "right")
                n = hi - lo
                at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
                both = np.bincount(owner[at], minlength=len(asked))
                for k in np.flatnonzero(may & (100 * both >= percent * (len(mine) + sizes - both))).tolist():
                    if label[k] != own:
                        left.append(min(node, asked[k][0]))
                        right.append(max(node, asked[k][0]))
                        gone = int(label[k])
                        label[label == gone] = own
                        for x, v in number.items():
                            if v == gone:
                                number[x] = own

        for b in batches:
            texts = [unpress.decompress(x) for x in b.column("body").to_pylist()]
            columns = (b.column(c).to_pylist() for c in ("g", "asks", "node", "label", "sig", "out"))
            for g, asks, node, label, sig, out, items in zip(*columns, shingle_sets(texts, width), strict=True):
                if g != now:
                    close()
                    now, held = g, {True: [], False: []}
                held[asks].append((node, label, sig, items, out))
            if len(left) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])
                left, right = [], []
        close()
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    # By number, as joining small partitions would leave this work to a few tasks.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(tidy(run), "a binary, b binary")


class Linker:
    """The links of classes (node, first, sig), found level by level; ``labels`` has the components so far."""

    def __init__(self, scratch: Scratch, classes: DataFrame, docs: DataFrame, percent: int, width: int, small: int):
        self.scratch, self.classes, self.docs = scratch, classes, docs
        self.percent, self.width, self.small, self.least = percent, width, small, least_matches(percent)
        self.labels = self.bodies = self.tested = None
        self.step = 0

    def candidates(self, rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Of buckets (key, node): pairs whose low bits agree enough, and the rows of buckets above ``small`` with size and signature.

        Where there is a column ``own``, a link has it on one side; of large buckets with few such rows, these meet all others
        at once, and the buckets aren't among those given.
        """
        split = "own" in rows.columns
        shared = rows.groupBy("key").agg(F.count("*").alias("size"), *([F.count_if("own").alias("owns")] if split else []))
        shared = shared.filter("size > 1 AND owns > 0" if split else "size > 1")
        live = self.scratch.keep(rows.join(shared, "key"), f"{name}-live")
        sigs = live.select("node").distinct().join(self.classes.select("node", "sig"), "node")
        live_sigs = self.scratch.keep(live.join(sigs, "node").select("key", "node", "size", "sig", *(["own", "owns"] if split else [])), f"{name}-buckets")
        self.scratch.drop(f"{name}-live")
        hot = live_sigs.filter(F.col("size") > self.small)
        pairs = small_pairs(live_sigs.filter(F.col("size") <= self.small), self.least)
        if split:
            few = hot.filter(F.col("owns") <= self.small)
            pairs = pairs.unionByName(self.meet(few.drop("own", "owns"), few.filter("own").select("key", "size", F.col("node").alias("pivot"), F.col("sig").alias("pivot_sig"))))
            hot = hot.filter(F.col("owns") > self.small).drop("own", "owns")
        pivots = hot.groupBy("key").agg(F.min(F.struct("node", "sig")).alias("p"), F.max("size").alias("size"))
        pairs = once(pairs.unionByName(self.meet(hot, pivots.select("key", "size", F.col("p.node").alias("pivot"), F.col("p.sig").alias("pivot_sig")))))
        return self.scratch.keep(pairs, f"{name}-pairs"), hot

    @staticmethod
    def spread(members: DataFrame, ones: DataFrame, each: int = 4096) -> DataFrame:
        """Join bucket members (key, node, size) with few rows a bucket (key, size), a large bucket being split over many tasks."""
        parts = F.greatest(F.ceil(F.col("size") / each), F.lit(1))
        members = members.withColumn("salt", F.pmod(F.xxhash64("node"), parts))
        ones = ones.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("size")
        return members.join(ones, ["key", "salt"]).drop("salt")

    def meet(self, hot: DataFrame, pivots: DataFrame, chunk: int = 256) -> DataFrame:
        """Pairs of bucket members and pivots of the same bucket whose low bits agree enough, about ``chunk`` members to a group."""
        met = self.spread(hot, pivots).filter((F.col("node") != F.col("pivot")) & _close("sig", "pivot_sig", self.least))
        group = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / chunk)))
        return met.select(*_pair("node", "pivot"), group.alias("g"))

    def fetch(self, nodes: DataFrame) -> None:
        """Texts, compressed, of classes (node, crowded); of rows of one doc_id only that of the class.

        Classes in pairs are mostly few among all, so other texts are sieved out before any is shuffled.
        """
        at, width = nodes.groupBy("node").agg(F.max("crowded").alias("crowded")).join(self.classes.select("node", F.col("first").alias("doc_id")), "node"), self.width
        at = self.scratch.keep(at, "wanted")

        def own(_: dict, b: pa.RecordBatch) -> dict:
            press, names, texts = zstandard.ZstdCompressor(), b.column(0).to_pylist(), raw(b.column(1))
            good = [k for k, (n, s) in enumerate(zip(names, shingle_sets(texts, width), strict=True)) if len(s) and set_key(s) == n]
            return {"node": [names[k] for k in good], "body": [press.compress(texts[k]) for k in good], "crowded": b.column(2).take(pa.array(good, pa.int64()))}

        # Repeated rows have one doc_id, by which the join has brought them together.
        asked, _ = sieve(self.docs, "doc_id", at.select("doc_id"))
        met = asked.join(at, "doc_id").dropDuplicates(["doc_id", "node", "text"])
        self.bodies = self.scratch.keep(arrow_map(met.select("node", "text", "crowded"), own, "node binary, body binary, crowded boolean", lean=True), "bodies")
        self.scratch.drop("wanted")
        self.texts = self.bodies.drop("crowded")

    def named(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` with their labels; a class without links is its own."""
        return nodes.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def apart(self, pairs: DataFrame) -> DataFrame:
        la = self.labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = self.labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        return pairs.join(la, "a", "left").join(lb, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).drop("la", "lb")

    def link(self, links: DataFrame) -> None:
        """Merge components: links between labels give the labels' own components."""
        self.step += 1
        scratch, name = self.scratch, f"labels-{self.step}"
        new = scratch.keep(links, f"links-{self.step}")
        if new.limit(1).count():
            if self.labels is None:
                self.labels = components(new, scratch, name)
            else:
                old, was = self.labels, scratch.labels
                la, lb = (self.labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
                between = new.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a != b")
                between = scratch.keep(between.distinct(), f"between-{self.step}")
                if between.limit(1).count():
                    top = components(between, scratch, name)
                    up = top.select(F.col("node").alias("label"), F.col("label").alias("up"))
                    merged = old.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
                    merged = merged.unionByName(top.join(old, "node", "left_anti"))
                    self.labels = scratch.keep(merged, f"{name}-all")
                    scratch.drop(scratch.labels, was)
                    scratch.labels = f"{name}-all"
                scratch.drop(f"between-{self.step}")
        elif self.labels is None:
            self.labels = new.select(F.col("a").alias("node"), F.col("b").alias("label"))
            scratch.labels = f"links-{self.step}"
            return
        scratch.drop(f"links-{self.step}")

    def test(self, pairs: DataFrame) -> None:
        """Confirm the pairs that are still in different components and were not confirmed before."""
        rest = self.apart(pairs)
        if self.tested is not None:
            rest = rest.join(self.tested, ["a", "b"], "left_anti")
        rest = self.scratch.keep(rest, f"tested-{self.step}")
        self.tested = rest.select("a", "b") if self.tested is None else self.tested.unionByName(rest.select("a", "b"))
        if rest.limit(1).count():
            self.link(confirm(rest, self.texts, self.percent, self.width))
        self.scratch.collect_garbage()

    def outside(self, hot: DataFrame) -> DataFrame:
        """Rows of hot buckets whose class is not of the bucket's main component, with their number there."""
        named = self.named(hot)
        counted = named.groupBy("key", "label").agg(F.count("*").alias("n"), F.max("size").alias("size"))
        main = counted.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all"), F.max("size").alias("size"))
        main = main.filter(F.col("all") > F.col("m.n")).select("key", "size", F.col("m.label").alias("main"))
        out = self.spread(named, main).filter("label != main").drop("label", "main")
        left = out.groupBy("key").agg(F.count("*").alias("outside"), F.max("size").alias("size"))
        return self.spread(out, left)

    def blocks(self, deep: DataFrame, block_bytes: int = 1 << 20) -> None:
        """Link what large buckets (key, node, sig) leave apart, at once: buckets that share classes are one group, and the classes
        outside a group's main component meet all of it, by blocks of about ``block_bytes`` of compressed texts, theirs half as large.
        """
        least = deep.groupBy("key").agg(F.min("node").alias("b"))
        edges = deep.select("key", F.col("node").alias("a")).join(least, "key").select("a", "b").distinct()
        before = self.scratch.labels
        groups = components(edges, self.scratch, "groups")
        groups_at, self.scratch.labels = self.scratch.labels, before
        rows = self.named(groups.withColumnRenamed("label", "top")).join(self.texts, "node").join(self.classes.select("node", "sig"), "node")
        rows = self.scratch.keep(rows.select("top", "node", "label", "sig", "body"), "grouped")
        self.scratch.drop(groups_at)
        counted = rows.groupBy("top", "label").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("bytes"))
        main = counted.groupBy("top").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all"), F.sum("bytes").alias("bytes"), F.max_by("bytes", F.struct("n", "label")).alias("main_bytes"))
        main = main.filter(F.col("all") > F.col("m.n")).select("top", F.col("m.label").alias("main"), _ceil("bytes", block_bytes).alias("ys"), _ceil(F.col("bytes") - F.col("main_bytes"), block_bytes // 2).alias("xs"))
        met = rows.join(main, "top").withColumn("out", F.col("label") != F.col("main"))
        cut = lambda n: F.pmod(F.xxhash64("node"), n)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        take = [F.col(c) for c in ("node", "label", "sig", "body", "out")]
        asking = met.filter("out").select(F.col("top"), cut(F.col("xs")).alias("x"), every("ys").alias("y"), F.lit(True).alias("asks"), *take)
        asked = met.select(F.col("top"), every("xs").alias("x"), cut(F.col("ys")).alias("y"), F.lit(False).alias("asks"), *take)
        pairs = asking.unionByName(asked).select(F.xxhash64("top", "x", "y").alias("g"), "asks", *take)
        self.link(met_blocks(pairs, self.percent, self.width, self.least))
        self.scratch.drop("grouped")

    def level(self, rows: DataFrame, name: str) -> DataFrame:
        """Links of buckets: one a class first, as it mostly joins a group, then what is still apart.  Gives the hot rows."""
        pairs, hot = self.candidates(rows, name)
        if self.bodies is None:
            calm, crowded = F.lit(False).alias("crowded"), F.lit(True).alias("crowded")
            self.fetch(pairs.select(F.col("a").alias("node"), calm).union(pairs.select("b", calm)).union(hot.select("node", crowded)))
        if self.labels is None:
            stars = self.scratch.keep(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "stars")
            self.link(confirm(in_bundles(stars), self.texts, self.percent, self.width).unionByName(self.same_ids))
            self.tested = stars
        self.test(pairs)
        self.scratch.drop(f"{name}-pairs")
        return hot

    def run(self, rows: DataFrame, same_ids: DataFrame) -> None:
        self.same_ids = same_ids
        asked = [F.col("node").alias("pivot"), F.col("sig").alias("pivot_sig")]
        hot = self.level(rows, "bands")
        self.texts = self.bodies.filter("crowded").drop("crowded")  # all that is asked for from here on
        if hot.limit(1).count():
            out = self.scratch.keep(self.outside(hot), "outside")
            few = out.filter(F.col("outside") <= self.small)
            if few.limit(1).count():
                self.test(once(self.meet(hot, few.select("key", "size", *asked))))
            many = out.filter(F.col("outside") > self.small).select("key").distinct()
            if many.limit(1).count():
                nodes = hot.join(F.broadcast(many) if self.scratch.few(many) else many, "key", "left_semi").select("node")
                crowded = self.scratch.keep(self.texts.join(nodes, "node", "left_semi"), "crowded")
                deep = self.level(prefix_keys(crowded, shingle_counts(crowded, self.width), self.percent, self.width), "prefixes")
                if deep.limit(1).count():
                    self.blocks(deep)


def near_duplicates(docs: DataFrame, *, percent: int = 85, width: int = 3, small: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_size (documents of the same shingle set), one row a row of ``docs``.

    A null or empty text has no shingles, is linked with nothing and is kept; a row of null doc_id has a null component and
    is kept; rows of one doc_id are one component whatever their texts; very long texts are taken whole; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, BATCH)
    docs = with_docs(docs, doc_id, text)
    sigs = scratch.keep(signatures(docs, width), "signatures")
    rows = sigs.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("class_size"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = scratch.keep(classes, "classes")
    ids = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z").select("doc_id", "a")
    same_ids = rows.select("doc_id", F.col("node").alias("b")).join(ids, "doc_id").filter("a != b").select("a", "b").distinct()
    found = Linker(scratch, classes, docs, percent, width, small)
    found.run(classes.select(F.explode("bands").alias("key"), "node"), same_ids)
    scratch.drop(*(n for n in list(scratch.paths) if n not in ("signatures", "classes", scratch.labels)))
    named = found.named(classes.select("node", "first", "class_size"))
    least_id = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(least_id, "label").select("node", "component_id", "class_size")
    out = sigs.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    alone = F.col("doc_id").isNull() | F.col("node").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", (alone | (F.col("doc_id") == F.col("component_id"))).alias("kept"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of near duplicates does, all columns as they are.

    Of rows with one doc_id the least stays (by text, then by all columns as JSON); rows without a
    doc_id, and texts without words, all stay, as long as no other row has their doc_id.  An empty table gives no rows.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, **settings)
    ids = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    ids = Scratch(docs.sparkSession).keep(ids.filter("NOT stays OR n > 1"), "not-as-they-are")
    asked, clear = sieve(docs.filter(F.col(doc_id).isNotNull()), doc_id, ids.select("doc_id"))
    name = F.col("doc_id").alias(doc_id)
    rank = "_n"
    while rank in {c.lower() for c in docs.columns}:
        rank = "_" + rank
    w = Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_last(), F.to_json(F.struct(*docs.columns)))
    # Where ``docs`` is a union, the join goes under it, and Spark may then take rows of one id for being together when they aren't.
    some = asked.join(ids.filter("stays").select(name), doc_id, "left_semi").repartition(doc_id)
    one = some.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).select(*docs.columns)
    rest = asked.join(ids.select(name), doc_id, "left_anti").select(*docs.columns)
    return clear.select(*docs.columns).unionByName(rest).unionByName(one).unionByName(docs.filter(F.col(doc_id).isNull()))
