import subprocess
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import AddedToken, Tokenizer

from foldline.llm import binary, packing
from foldline.llm.tokens import TextEncoder

ODD = ["", " ", "  a  b ", "a \n b\n\n c  ", "<|endoftext|> x <|endoftext|>y", "é ́a b́", "it's 'll we've", "\tfoo bar ", "日本 ½ x1y2", "\x1c a\x1f b", "<|endoftext|>", "a <|endoftext|> b", "in<|endoftext|>side <|startoftext|>", "x <|endoftext|>  y<|ENDOFTEXT|>", "x.*** y!! c.\nd.\ne,,", "a​ b ﻿ c", "İx İ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_give_the_ids_of_whole_texts(name, texts):
    some = [*list(texts.values())[:120], *ODD]
    for special in (True, False):
        plain = Tokenizer.from_file(P.path(name))
        plain.encode_special_tokens = not special
        want = [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]
        for enc in (TextEncoder(P.path(name), special=special), TextEncoder(P.path(name), keep=40, special=special)):
            assert enc._cuts
            for _ in range(2):
                assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(some)] == want
            assert [np.frombuffer(b, "<u4").tolist() for t in some for b in enc.encode([t])] == want


def test_other_vocabularies_are_asked_for_whole_texts(tmp_path):
    spec = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    spec.add_tokens([AddedToken("cat", single_word=True, lstrip=True)])
    spec.save(f"{tmp_path}/x.json")
    enc, some = TextEncoder(f"{tmp_path}/x.json"), ["a cat sat", "concat", "", "the  cat"]
    assert not enc._cuts
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(some)] == [e.ids for e in Tokenizer.from_file(f"{tmp_path}/x.json").encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
    assert (binary.unpack_bits(binary.pack_bits(ids, width), width)[:1000] == ids).all()


def test_file_random_access(tmp_path):
    rng = np.random.default_rng(0)
    w = binary.Writer(f"{tmp_path}/x.bin", 16, block=64)
    parts = [rng.integers(0, 50257, n).astype(np.uint32) for n in (0, 5, 700, 64, 1)]
    for i, p in enumerate(parts):
        w.add(None if i == 0 else i, p)
    w.close()
    r, all_ = binary.Reader(f"{tmp_path}/x.bin"), np.concatenate(parts)
    for lo, hi in ((0, 770), (3, 9), (63, 65), (700, 770), (5, 5)):
        assert (r.ids(lo, hi) == all_[lo:hi]).all()
    assert [d[0] for d in r.documents(10)] == [None, 1, 2, 3, 4]


def reference_ids(name, text, end):
    t = Tokenizer.from_file(P.path(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


def test_short_texts_are_encoded_together_for_token_files(texts):
    class Counted(TextEncoder):
        calls = 0

        def encode(self, some):
            self.calls += 1
            return super().encode(some)

    some = [*ODD, None, *list(texts.values())[:40], *(f"short {i}." for i in range(3000))]
    enc = Counted(P.path("byte_bpe_50k.json"))
    got = binary.encoded(enc, pa.array(some, pa.string()), 2, "<u2")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in some]
    assert enc.calls == 1


def test_token_files(spark, edge):
    got = binary.encode_to_files(edge, P.path("byte_bpe_50k.json"), vocabulary=50257, end_id=2, parts=3).orderBy("start").collect()
    rows = sorted(edge.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g["doc_id"] for g in got] == [r[0] for r in rows]
    at = 0
    for g, r in zip(got, rows, strict=True):
        want = reference_ids("byte_bpe_50k.json", r[1], 2)
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(want) // 4, zlib.crc32(want))
        at += g["n_tokens"]
    assert binary.encode_to_files(edge.limit(0), P.path("byte_bpe_50k.json"), vocabulary=50257, end_id=2).count() == 0


def test_packing_covers_every_id_once(spark, edge, docs):
    both = edge.select("doc_id", "text").unionByName(docs.selectExpr("doc_id + 1000 AS doc_id", "text"))
    rows = packing.pack(both, P.path("word_bpe_49k.json")).toPandas()
    whole = {(r[0], r[1]): None for r in both.collect()}
    seqs = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, s in seqs:
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert 1 - rows.length.sum() / (2048 * seqs.ngroups) < 0.03
    assert (rows.ids_crc32 == [zlib.crc32(b) for b in rows.ids]).all()
    for doc_id, text in list(whole)[:60]:
        if doc_id in (2, None):
            continue
        own = rows[rows.doc_id == doc_id].sort_values("start")
        want = reference_ids("word_bpe_49k.json", text, 1)
        assert b"".join(own.ids) == want and (own.doc_tokens == len(want) // 4).all()
    assert rows[rows.doc_id == 2].length.sum() == 2 * rows[rows.doc_id == 1].length.sum()
    assert packing.pack(edge.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_differencing_is_near_even():
    sizes = np.random.default_rng(1).integers(1, 384, 1500)
    window = packing.differencing(sizes, 128)
    sums = np.bincount(window, sizes, 128)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 64
    w, k = packing.divide(np.array([2048, 2048, 1]), 2048)
    assert k == 3 and np.bincount(w, [2048, 2048, 1]).max() <= 2048
    assert packing.divide(np.array([7]), 10) [1] == 1


def slow_differencing(sizes, k):
    """Sums of the windows, every partition being sorted anew at each merge."""
    heap = [(-v, i, [0] * (k - 1) + [v]) for i, v in enumerate(sizes)]
    while len(heap) > 1:
        heap.sort(key=lambda x: x[:2])
        (_, _, a), (_, _, b), *heap = heap
        joint = sorted(x + y for x, y in zip(a, b[::-1], strict=True))
        sizes = [*sizes, 0]
        heap.append((joint[0] - joint[-1], len(sizes) - 1, [x - joint[0] for x in joint]))
    return heap[0][2]


def test_differencing_has_the_sums_of_a_slow_one_and_is_cheap():
    rng = np.random.default_rng(4)
    for n, k in ((2, 2), (3, 2), (2, 7), (40, 3), (60, 16), (300, 64)):
        sizes = rng.integers(1, 385, n)
        sums = np.sort(np.bincount(packing.differencing(sizes, k), weights=sizes, minlength=k)).astype(int)
        assert (sums - sums[0]).tolist() == slow_differencing(sizes.tolist(), k)

    def least(fn):
        took = []
        for _ in range(5):
            t = time.thread_time()
            fn()
            took.append(time.thread_time() - t)
        return min(took)

    one = rng.integers(0, 2048, 256)
    sizes = rng.integers(1, 385, 1800)
    assert least(lambda: packing.differencing(sizes, 256)) < 0.6 * least(lambda: [one.argsort(kind="stable") for _ in range(3600)])


WORKER = """
import re, threading, time
import corpus_pipeline, numpy as np, pyarrow as pa, pyspark
from pathlib import Path
from types import SimpleNamespace as N
from foldline.llm import packing

held = lambda: sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
pyspark.TaskContext = N(get=lambda: N(partitionId=lambda: 0))
docs = N(sparkSession=N(sparkContext=N(environment={})), mapInArrow=lambda run, _: run)
packing.with_docs = lambda *_: docs
run = corpus_pipeline.pack(None, docs, "")

def batches():
    rng = np.random.default_rng(3)
    for _ in range(2):
        words = [bytes(w).decode() for w in rng.integers(97, 123, (600_000, 9), np.uint8)]
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(150)), "text": [" ".join(words[i::150]) for i in range(150)]})

some = list(batches())
list(run([some[0].slice(0, 1)]))
began, most, on = held(), [0], [True]
def watch():
    while on:
        most[0] = max(most[0], held())
        time.sleep(0.01)
threading.Thread(target=watch, daemon=True).start()
for b in some:
    for _ in run([b]):
        pass
on.clear()
print(most[0] - began, held() - began)
"""


def test_a_worker_holds_little_while_it_packs_long_texts_and_less_when_it_waits():
    got = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    most, idle = map(float, got.stdout.split())
    assert most < 200 and idle < 130
