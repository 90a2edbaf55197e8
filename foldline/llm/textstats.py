"""Statistics of whole texts, vectorised over neighbouring documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, doc_groups, group_words, mix64, with_docs

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"#*$%&|<>")] |= 1
_CLASS[65:91] |= 2
_CLASS[97:123] |= 4
_CLASS[48:58] |= 8
_CLASS[list(b"!\"'()+,-./:;=?@[\\]^_`{}~")] |= 16
_CLASS[list(SPACES)] |= 32
_CLASS[0x80:0xC0] |= 64
_CLASS[0xC0:] |= 128

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What models see: shares and means, so that a text's length matters only as its logarithm.
FEATURES = ("log_words", "word_length", "symbol_share", "upper_share", "digit_share", "punct_share", "accent_share", "distinct_share", "adjacent_share", "repeat_share", "dup_line_share", "one_char_share", "line_words")


def _repeated(words: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a run of ``width`` words found twice or more in its text."""
    n = len(words) - width + 1
    cover = np.zeros(len(words) + 1, np.int32)
    if n > 0:
        acc = np.zeros(n, np.uint64)
        for j in range(width):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
            acc ^= acc >> np.uint64(32)
        at = np.flatnonzero(doc[:n] == doc[width - 1 :])
        acc = mix64(acc[at] + doc[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        order = np.argsort(acc)
        ranked = acc[order]
        same = np.concatenate(([False], ranked[1:] == ranked[:-1], [False]))
        twice = at[order[same[1:] | same[:-1]]]
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + width, -1)
    return np.cumsum(cover[:-1]) > 0


def _dup_lines(body: bytes) -> tuple[int, int]:
    """Lines equal to an earlier one, and lines, of those that have a word."""
    if b"\n" not in body:
        return 0, int(bool(body.strip(SPACES)))
    lines = [x for x in body.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines)), len(lines)


def statistics(bodies: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts of each text and its feature matrix.  An empty text has zeros throughout."""
    counts = {k: np.zeros(len(bodies), np.int64) for k in COUNTS}
    rows = np.zeros((len(bodies), len(FEATURES)), np.float64)
    for lo, hi in doc_groups(bodies):
        some = bodies[lo:hi]
        data, starts, ends, words, first = group_words(some, lower=False)
        offset = np.concatenate(([0], np.cumsum([len(b) + 1 for b in some])))[:-1]
        stop = offset + [len(b) for b in some]
        kinds = _CLASS[data]

        def total(flags: np.ndarray, a=offset, b=stop) -> np.ndarray:
            acc = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
            return acc[b] - acc[a]

        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        per_word = lambda flags: total(flags, first[:-1], first[1:])
        n = np.diff(first)
        chars = total((kinds & 96) == 0)
        symbols, upper, lower = total((kinds & 1) != 0), total((kinds & 2) != 0), total((kinds & 4) != 0)
        repeat = per_word(_repeated(words, doc, 5))
        lines = np.array([_dup_lines(b) for b in some], np.int64).reshape(-1, 2)
        tag = mix64(words + doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        order = np.argsort(tag)
        again = order[1:][tag[order[1:]] == tag[order[:-1]]]
        not_new = np.bincount(doc[again], minlength=hi - lo)
        adjacent = np.zeros(len(words), bool)
        if len(words) > 1:
            adjacent[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        for k, v in zip(COUNTS, (n, chars, symbols, lines[:, 0], repeat), strict=True):
            counts[k][lo:hi] = v
        w, c, letters = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(upper + lower, 1)
        rows[lo:hi] = np.stack(
            [
                np.log1p(n),
                chars / w,
                symbols / c,
                upper / letters,
                total((kinds & 8) != 0) / c,
                total((kinds & 16) != 0) / c,
                total((kinds & 128) != 0) / c,
                (n - not_new) / w,
                per_word(adjacent) / w,
                repeat / w,
                lines[:, 0] / np.maximum(lines[:, 1], 1),
                per_word(ends - starts == 1) / w,
                np.log1p(n / np.maximum(lines[:, 1], 1)),
            ],
            1,
        )
    return counts, rows


def labelled(docs: DataFrame, labels: DataFrame, *, label: str = "quality", most: int = 12_000, fold: int = 5, held_out: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled documents, chosen by a hash of their ids outside the held-out fold.

    The sample is bounded, so its ids may be broadcast and its rows collected; a null label or id is left out, as is an id with
    two labels; of several documents of one id, the least text stands.  Without any, both are empty.
    """
    from .common import arrow_map, raw

    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    ids = ids.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != held_out))
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = with_docs(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(_: dict, b) -> dict:
        _, rows = statistics(raw(b.column(2)))
        return {"doc_id": b.column(0), "y": b.column(1), "x": list(rows)}

    got = arrow_map(joined, run, "doc_id long, y int, x array<double>").toArrow()
    order = np.argsort(got["doc_id"].to_numpy())
    x = np.array(got["x"].combine_chunks().flatten().to_numpy()).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    return x[order], got["y"].to_numpy()[order].astype(np.float64)
