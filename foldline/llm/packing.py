"""Packing documents into fixed windows by multiway number differencing (Karmarkar-Karp).

Whole windows are cut from long documents; what is left is cut into pieces and divided over ``k`` windows by differencing:
each piece starts as a partial partition with one filled place, the two partitions of the largest imbalance are merged
with their places in opposing order, until one is left.  ``k`` starts at the least count that could hold the tokens and
rises whenever a window would exceed the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame

from .common import ship, spans, tidy, with_docs
from .tokens import encoder

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each piece, windows having nearly equal sums."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, np.int64)
    pieces = sizes.tolist()
    sums: dict[int, list[int]] = {}
    heap = [(-v, i) for i, v in enumerate(pieces)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, int | np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        if a >= n and b < n:
            joint, one = sums.pop(a), b
        elif b >= n and a < n:
            joint, one, a, b = sums.pop(b), a, b, a
        elif a < n:
            joint, one = [0] * (k - 1) + [pieces[a]], b
        else:
            joint, one = sums.pop(a), -1
        if one >= 0:  # a single piece goes to the emptiest place, which moves up
            v = joint.pop(0) + pieces[one]
            at = bisect_left(joint, v)
            joint.insert(at, v)
            merges.append((a, b, at))
        else:
            both = np.array(joint) + np.array(sums.pop(b))[::-1]
            order = both.argsort(kind="stable")
            joint = both[order].tolist()
            merges.append((a, b, order))
        node = n + len(merges) - 1
        sums[node] = joint
        heapq.heappush(heap, (joint[0] - joint[-1], node))
    slot: dict[int, list[int]] = {n + len(merges) - 1: list(range(k))}
    window = np.zeros(n, np.int64)
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        own = slot.pop(n + i)
        if isinstance(order, int):
            window[b] = x = own.pop(order)
            own.insert(0, x)
            if a < n:
                window[a] = own[-1]
            else:
                slot[a] = own
        else:
            for child, places in ((a, order), (b, k - 1 - order)):
                of = np.empty(k, np.int64)
                of[places] = own
                slot[child] = of.tolist()
    if not merges:
        window[0] = k - 1
    return window


def divide(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of the pieces and how many windows there are; none holds more than ``capacity``."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return window, k
        k += 1


def cut(length: int, capacity: int, piece: int) -> tuple[int, list[int]]:
    """Whole windows of a document and the sizes of the pieces of what is left, nearly equal and at most ``piece`` long."""
    whole, rest = divmod(length, capacity)
    if not rest:
        return whole, []
    parts = -(-rest // piece)
    return whole, [rest * (i + 1) // parts - rest * i // parts for i in range(parts)]


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = 2048,
    end_id: int = 1,
    piece: int = 384,
    group: int = 256,
    slack: float = 0.004,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
    keep: int = 1_200_000,
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """One row a piece: which ids of which document lie where in which sequence, with the ids as 32-bit integers.

    Each partition packs its own documents, about ``group`` windows together (the share ``slack`` of their capacity is left
    free, for windows come out nearly, not wholly, equal), so nothing is shuffled and no task holds more than a group and
    one document.  A null or empty text is its end id alone; repeated rows are packed as often as they occur;
    a null doc_id stays null; an empty table gives no rows; other columns are not looked at; strings of special tokens
    in a text are these tokens, as the library has it.  A worker encodes ``slice_bytes`` of texts at once and remembers ``keep``
    parts: less of either takes less memory and more time, and changes no ids.
    """

    def setup() -> dict:
        from pyspark import TaskContext

        return {"next": TaskContext.get().partitionId() << 40}

    def close(waiting: list[tuple], state: dict) -> list[tuple]:
        sizes = np.array([len(p[2]) // 4 for p in waiting], np.int64)
        window, k = divide(sizes, capacity)
        filled, out = np.zeros(k, np.int64), []
        for p, w, size in zip(waiting, window.tolist(), sizes.tolist(), strict=True):
            out.append((*p, state["next"] + w, int(filled[w]), size))
            filled[w] += size
        state["next"] += k
        return out

    def run(batches):
        import pyarrow as pa

        state, enc = setup(), encoder(tokenizer, keep)
        tail = np.array([end_id], "<u4").tobytes()
        waiting, held = [], 0

        def table(rows: list[tuple]) -> pa.RecordBatch:
            ids, start, body, total, seq, off, size = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array([zlib.crc32(b) for b in body], pa.int64()),
                    pa.array(total, pa.int64()),
                    pa.array(seq, pa.int64()),
                    pa.array(off, pa.int64()),
                    pa.array(body if with_ids else [None] * len(body), pa.binary()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for batch in batches:
            names, bodies = batch.column(0).to_pylist(), batch.column(1)
            for at, to in spans(bodies, slice_bytes):
                rows = []
                for name, ids in zip(names[at:to], enc.encode(bodies.slice(at, to - at)), strict=True):
                    ids += tail
                    total, start = len(ids) // 4, 0
                    whole, rest = cut(total, capacity, piece)
                    for size in [capacity] * whole:
                        rows.append((name, start, ids[start * 4 : (start + size) * 4], total, state["next"], 0, size))
                        state["next"] += 1
                        start += size
                    for size in rest:
                        waiting.append((name, start, ids[start * 4 : (start + size) * 4], total))
                        held, start = held + size, start + size
                        if held >= group * capacity * (1 - slack):
                            rows += close(waiting, state)
                            waiting, held = [], 0
                if rows:
                    yield table(rows)
        if waiting:
            yield table(close(waiting, state))

    ship(docs.sparkSession)
    return with_docs(docs, doc_id, text).mapInArrow(tidy(run), PIECES)
