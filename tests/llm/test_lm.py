import math
import zlib
from collections import Counter

import numpy as np

from foldline.llm import lm
from foldline.llm.common import Scratch


def words(t):
    return (t or "").encode().lower().split()


def check(rows, got):
    c = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            c.update(words(t))
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        w = [*words(t), b""]
        want.append((d if d is not None else -1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)))
    have = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got]
    assert len(have) == len(want)
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-3


SMALL = {"own": 60, "shared": 20, "known": 200, "width": 8, "batch": 64}


def slow_score(text, lex, model, c):
    """log10 of a text, a softmax over all classes at every token, and a word's smoothed share of its class."""
    own, near = set(lex.index) and {w for w, i in lex.index.items() if lex.within[lex.classes[i]] == 0}, lm.told_apart(lex.k)
    mass, types = np.zeros(lex.k), np.zeros(lex.k)
    kind = lambda w: int(lex.classes[lex.index[w]]) if w in own else lex.class_of_rare(w.decode())
    for w, n in c.items():
        if w and w not in own:
            mass[kind(w)] += n
            types[kind(w)] += 1
    total, before = 0.0, [0, 0, 0]
    for w in [*words(text), b""]:
        t = 0 if not w else kind(w)
        h = sum(model["R"][near[i][before[i]]].astype(float) * model["C"][i] for i in range(3))
        s = model["Q"].astype(float) @ h + model["b"]
        total += (s[t] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10)
        if w and w not in own:
            total += math.log10((c[w] + 0.5) / (mass[t] + 0.5 * (types[t] + 1)))
        before = [t, *before[:2]]
    return total


def test_scores(spark, edge, docs):
    both = edge.select("doc_id", "text").unionByName(docs.selectExpr("doc_id + 100 AS doc_id", "text")).coalesce(1)
    rows = [tuple(r) for r in both.collect()]
    got = lm.score(both, **SMALL).collect()
    check(rows, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    inside = both.filter(~lm.held_out(5, 1))
    _, lex, model, z = lm.fit(inside, Scratch(spark), **SMALL)
    c = Counter()
    for _, t in inside.collect():
        c.update(words(t))
        c[b""] += 1
    short = sorted(((d if d is not None else -1, t) for d, t in rows if len(t or "") < 3000), key=str)[:120]
    have = {}
    for r in got:
        have.setdefault(r["doc_id"] if r["doc_id"] is not None else -1, []).append(r["score"])
    for d, t in short:
        want = slow_score(t, lex, model, c)
        assert min(abs(x - want) for x in have[d]) < 2e-3 * (1 + abs(want) / 100)
    assert lm.score(edge.limit(0), **SMALL).count() == 0


def test_normalisers_and_gain():
    rng = np.random.default_rng(0)
    jump = rng.dirichlet(np.full(30, 0.05), 30)
    kinds = []
    for _ in range(200):
        x = [0]
        for _ in range(60):
            x.append(1 + int(rng.choice(29, p=jump[x[-1]][1:] / jump[x[-1]][1:].sum())))
        kinds.append(np.array(x[1:], np.int32))
    part = lm.grams(kinds)
    assert part.shape == (4, 200 * 61) and part[:, 0].tolist() == [kinds[0][0], 0, 0, 0] and part[:, 60].tolist() == [0, *kinds[0][:-4:-1]]
    assert lm.grams([np.zeros(0, np.int32)] * 3).tolist() == [[0, 0, 0]] * 4
    noise = np.bincount(part[0], minlength=30) + 0.5
    noise /= noise.sum()
    model = lm.start(noise, 8)
    z = lm.normalisers(model, np.arange(30))
    flat = lm.log_probabilities(model, z, part).mean()
    for _ in range(5):
        lm.train([part], model, noise, samples=20, batch=64)
    z = lm.normalisers(model, np.arange(30))
    assert lm.log_probabilities(model, z, part).mean() > flat + 0.3
    for context in ((3, 1, 0), (29, 28, 27), (0, 0, 0)):
        every = np.stack([np.arange(30), *(np.full(30, c) for c in context)])
        assert abs((10.0 ** lm.log_probabilities(model, z, every).astype(float)).sum() - 1) < 1e-4
