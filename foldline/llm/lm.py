"""A log-bilinear language model, trained in numpy by noise-contrastive estimation, and the unigram base.

Words are counted over all training texts.  The commonest are outputs of their own; the others share classes by their last
two letters, within which a word has its smoothed share of the class's count.  The model predicts a token's class from the
three tokens before it: h = R[c1] * C1 + R[c2] * C2 + R[c3] * C3 (diagonal C), score(next) = h . Q[next] + b[next].  The token before
is told apart by its class, those farther off by fewer words, so that the contexts are few enough for one batched matrix
product to give the normaliser of each of them.

Every task trains on all tokens of its partition against noise sampled from the classes' unigram; the tasks' parameters are
then averaged by their tokens, so the whole training corpus is learned from and nothing grows with it but time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pieces, ship, with_docs

END = ""  # ends every text; no word is empty
#: How many classes are told apart at the second and third token before (the commonest, and one for all others).
FAR = (24, 4)
BLOCK = 256


def _words(body: bytes) -> list[bytes]:
    return body.lower().split()


def count_words(docs: DataFrame, flush: int = 150_000) -> DataFrame:
    """(word, c): how often each word, and the end, occurs; counted within tasks before anything is sent."""
    ship(docs.sparkSession)

    def run(batches):
        def table(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])

        count: Counter = Counter()
        for b in batches:
            for _, bodies in pieces(b.column(0)):
                for body in bodies:
                    count.update(_words(body))
                    count[b""] += 1
                    if len(count) > flush:
                        yield table(count)
                        count = Counter()
        if count:
            yield table(count)

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def suffix(word: str) -> str:
    return word[-2:]


@dataclass
class Lexicon:
    """The commonest words with their counts, and the classes: 0 the end, then words, then suffixes, then the rest."""

    index: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    suffixes: dict[str, int]
    within: np.ndarray  # log10 of a class's count with its smoothing, 0 where the class is one word
    noise: np.ndarray
    total: int
    distinct: int

    @property
    def k(self) -> int:
        return len(self.within)

    def class_of_rare(self, word: str) -> int:
        return self.suffixes.get(suffix(word), self.k - 1)


def lexicon(counts: DataFrame, own: int, shared: int, known: int) -> Lexicon:
    """From the counts of all words: ``own`` words are classes, ``shared`` suffixes are, and of at most ``known`` words the counts
    are kept at hand: of those that occur at least as often as leaves no more."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    steps = counts.groupBy(F.least("c", F.lit(100_000)).alias("c")).count().collect()  # one row a count, 100,000 at most
    least, above = 1 << 60, 0
    for r in sorted(steps, key=lambda r: -r["c"]):
        above += r["count"]
        if above > known:
            break
        least = r["c"]
    top = sorted(counts.filter(F.col("c") >= least).collect(), key=lambda r: (-r["c"], r["word"]))  # bounded by ``known``
    words = [r["word"] for r in top]
    single = [END] + [w for w in words if w != END][:own]
    spark = counts.sparkSession
    singles = spark.createDataFrame([(w,) for w in single], "word string")
    rest = counts.join(F.broadcast(singles), "word", "left_anti").withColumn("suffix", F.substring("word", -2, 2))
    groups = rest.groupBy("suffix").agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    all_rest = groups.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    kept = groups.orderBy(F.desc("c"), "suffix").limit(shared).collect()  # bounded by ``shared``
    class_of = {w: i for i, w in enumerate(single)}
    suffixes = {r["suffix"]: len(single) + i for i, r in enumerate(kept)}
    mass = [*(r["c"] for r in kept), all_rest[0] - sum(r["c"] for r in kept)]
    types = [*(r["v"] for r in kept), all_rest[1] - sum(r["v"] for r in kept)]
    within = np.concatenate((np.zeros(len(single)), np.log10(np.array(mass, float) + 0.5 * (np.array(types, float) + 1))))
    by_word = {r["word"]: r["c"] for r in top}
    unigram = np.array([*(by_word.get(w, 0) for w in single), *mass], float) + 0.5
    other = len(single) + len(kept)
    classes = [class_of.get(w, suffixes.get(suffix(w), other)) for w in words]
    return Lexicon({w.encode(): i for i, w in enumerate(words)}, np.array([r["c"] for r in top], np.int64), np.array(classes, np.int32), suffixes, within, unigram / unigram.sum(), int(total), int(distinct))


def sequence(words: list[bytes], lex: Lexicon) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Index in the lexicon (-1: not there), class of each word, and the places of words that aren't there."""
    at = np.fromiter(map(lex.index.get, words, repeat(-1)), np.int64, len(words))
    kind = lex.classes[at] if len(lex.classes) else np.zeros(len(at), np.int32)
    away = np.flatnonzero(at < 0).tolist()
    for i in away:
        kind[i] = lex.class_of_rare(words[i].decode())
    return at, kind, away


LEAD = np.zeros(3, np.int32)
LAST = np.zeros(1, np.int32)


def grams(kinds: list[np.ndarray]) -> np.ndarray:
    """(next, before, second before, third before) of every token of some texts, each behind three ends and with its own."""
    chain = np.concatenate([x for kind in kinds for x in (LEAD, kind, LAST)])
    size = np.fromiter(map(len, kinds), np.int64, len(kinds)) + 4
    first = np.cumsum(size) - size
    token = np.ones(len(chain), bool)
    for k in range(3):
        token[first + k] = False
    at = np.flatnonzero(token)
    return np.stack([chain[at - k] for k in range(4)])


def training_parts(docs: Iterator[pa.RecordBatch], lex: Lexicon) -> Iterator[np.ndarray]:
    """``grams`` of about a megabyte of text at once."""
    for b in docs:
        for _, bodies in pieces(b.column(0)):
            yield grams([sequence(_words(x), lex)[1] for x in bodies])


def start(noise: np.ndarray, width: int, seed: int = 6) -> dict[str, np.ndarray]:
    """Parameters that give the classes' unigram."""
    rng, k, f = np.random.default_rng(seed), len(noise), np.float32
    return {"R": rng.normal(0, 0.3, (k, width)).astype(f), "C": np.ones((3, width), f), "Q": rng.normal(0, 0.05, (k, width)).astype(f), "b": np.log(noise).astype(f)}


def told_apart(k: int) -> list[np.ndarray]:
    """The class that stands for each class at each of the three places before."""
    return [np.arange(k), *(np.where(np.arange(k) < m - 1, np.arange(k), k - 1) for m in FAR)]


def train(parts: Iterable[np.ndarray], model: dict[str, np.ndarray], noise: np.ndarray, *, samples: int = 96, batch: int = 512, rate: float = 0.15, seed: int = 6) -> int:
    """Noise-contrastive estimation over all ``parts`` (of ``grams``), in place: each batch against ``samples`` draws from ``noise``.

    Steps are scaled for each row by the root of its summed squared gradients.  Gives the number of tokens.
    """
    rng, total = np.random.default_rng(seed), 0
    near, cum = told_apart(len(noise)), np.cumsum(noise)
    shift = np.log(samples * noise).astype(np.float32)
    R, C, Q, b = (model[n] for n in "RCQb")
    sums = {"R": np.full(len(R), 1e-2, np.float32), "Q": np.full(len(Q), 1e-2, np.float32), "b": np.full(len(b), 1e-2, np.float32), "C": np.full(C.shape, 1e-2, np.float32)}

    def step(name: str, rows: np.ndarray, grads: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        ranked = rows[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        g, at = np.add.reduceat(grads[order], first, axis=0), ranked[first]
        square = (g * g).mean(1) if g.ndim == 2 else g * g
        sums[name][at] += square
        size = rate / np.sqrt(sums[name][at])
        model[name][at] += g * (size[:, None] if g.ndim == 2 else size)

    for part in parts:
        part = part[:, rng.permutation(part.shape[1])]
        total += part.shape[1]
        for i in range(0, part.shape[1], batch):
            t, *context = part[:, i : i + batch]
            context = [m[c] for m, c in zip(near, context, strict=True)]
            drawn = np.minimum(np.searchsorted(cum, rng.random(samples) * cum[-1], "right"), len(noise) - 1)
            rows = [R[c] for c in context]
            h = rows[0] * C[0] + rows[1] * C[1] + rows[2] * C[2]
            q, qn = Q[t], Q[drawn]
            good = (h * q).sum(1)
            good += b[t] - shift[t]
            bad = h @ qn.T
            bad += b[drawn] - shift[drawn]
            good = 1 / (1 + np.exp(np.clip(good, -30, 30)))  # chance that data is taken for noise
            bad = -1 / (1 + np.exp(-np.clip(bad, -30, 30)))  # less the chance that noise is taken for data
            dh = good[:, None] * q + bad @ qn
            scale = np.float32(1 / len(t) ** 0.5)
            dh *= scale
            good *= scale
            bad *= scale
            step("Q", np.concatenate((t, drawn)), np.concatenate((good[:, None] * h, bad.T @ h)))
            step("b", np.concatenate((t, drawn)), np.concatenate((good, bad.sum(0))))
            dC = np.stack([(dh * r).sum(0) for r in rows])
            step("R", np.concatenate(context), np.concatenate([dh * c for c in C]))
            sums["C"] += dC * dC
            C += 0.1 * rate * dC / np.sqrt(sums["C"])
    return total


def learn(docs: DataFrame, lex: Lexicon, *, width: int = 24, **training) -> dict[str, np.ndarray]:
    """The average, by tokens, of what each task learns from all its texts from one common start."""
    spark = docs.sparkSession
    ship(spark)
    shared, model = spark.sparkContext.broadcast(lex), start(lex.noise, width)

    def flat(m: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([m[n].ravel() for n in "RCQb"])

    def run(batches):
        lex = shared.value
        m = start(lex.noise, width)
        n = train(training_parts(batches, lex), m, lex.noise, **training)
        if n:
            values = flat(m)
            for k in range(0, len(values), BLOCK * 64):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([values[k : k + BLOCK * 64].tobytes()], pa.binary())], names=["at", "n", "v"])

    def merge(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for k, n, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(v, np.float32) * float(n)
                if k in sums:
                    sums[k][0] += n
                    sums[k][1] += x
                else:
                    sums[k] = [n, x.astype(np.float64)]
        for k, (n, x) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([(x / n).astype(np.float32).tobytes()], pa.binary())], names=["at", "n", "v"])

    kind = "at long, n long, v binary"
    parts = docs.select("text").mapInArrow(run, kind).repartition("at").mapInArrow(merge, kind).collect()  # the parameters, once
    if parts:
        values = np.concatenate([np.frombuffer(r["v"], np.float32) for r in sorted(parts, key=lambda r: r["at"])])
        at = 0
        for n in "RCQb":
            model[n] = values[at : at + model[n].size].reshape(model[n].shape)
            at += model[n].size
    return model


def places(model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """What each of the three places adds to the prediction, for the classes told apart there."""
    k = len(model["b"])
    return [model["R"] * model["C"][0], *(model["R"][[*range(min(m - 1, k)), *[k - 1] * max(1, m - k)]] * c for m, c in zip(FAR, model["C"][1:], strict=True))]


def normalisers(model: dict[str, np.ndarray], classes: np.ndarray) -> np.ndarray:
    """log of the summed exponentials of all outputs, for each class before with all that may lie before it."""
    one, two, three = places(model)
    far = (two[:, None] + three[None]).reshape(-1, two.shape[1]) @ model["Q"].T
    base, q = model["b"], model["Q"]
    out = np.empty((len(classes), len(far)), np.float32)
    for i, c in enumerate(classes):
        s = far + (one[c] @ q.T + base)
        top = s.max(1, keepdims=True)
        s -= top
        out[i] = np.log(np.exp(s, out=s).sum(1)) + top[:, 0]
    return out


def all_normalisers(spark: SparkSession, model: dict[str, np.ndarray]) -> np.ndarray:
    """Those of every context, computed by the cluster; their number is bounded by the classes."""
    ship(spark)
    shared, k = spark.sparkContext.broadcast(model), len(model["b"])

    def run(batches):
        for b in batches:
            if b.num_rows:
                at = b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in normalisers(shared.value, at)], pa.binary())], names=["id", "z"])

    got = spark.range(k, numPartitions=max(1, min(48, k // 64))).mapInArrow(run, "id long, z binary").collect()
    return np.stack([np.frombuffer(r["z"], np.float32) for r in sorted(got, key=lambda r: r["id"])])


def log_probabilities(model: dict[str, np.ndarray], z: np.ndarray, part: np.ndarray) -> np.ndarray:
    """log10 of each token's class, of ``grams``."""
    one, two, three = places(model)
    t, c1, c2, c3 = part
    d2, d3 = np.minimum(c2, len(two) - 1), np.minimum(c3, len(three) - 1)
    s = np.einsum("ij,ij->i", one[c1] + two[d2] + three[d3], model["Q"][t]) + model["b"][t]
    return (s - z[c1, d2 * len(three) + d3]) / np.float32(np.log(10))


PASSED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, word string, n long"


def held_out(fold: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == remainder, F.lit(False))


def fit(docs: DataFrame, scratch: Scratch, *, own: int = 3000, shared: int = 500, known: int = 100_000, **training) -> tuple[DataFrame, Lexicon, dict[str, np.ndarray], np.ndarray]:
    """Counts of all words, the lexicon, the model and its normalisers, from the texts in ``docs``."""
    counts = scratch.keep(count_words(docs), "counts")
    lex = lexicon(counts, own, shared, known)
    model = learn(docs, lex, **training)
    return counts, lex, model, all_normalisers(docs.sparkSession, model)


def score(docs: DataFrame, *, fold: int = 5, remainder: int = 1, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    A null or empty text is its end alone; a row of null doc_id is trained on; repeated rows each count and get their row;
    very long texts are scored whole; an empty table gives no rows.  Common words' counts are broadcast (a bounded lexicon);
    the others meet theirs in a join.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    docs = with_docs(docs, doc_id, text).withColumn("held_out", held_out(fold, remainder))
    counts, lex, model, z = fit(docs.filter("NOT held_out"), scratch, **settings)
    shared = spark.sparkContext.broadcast((lex, model, z))
    ends = int(lex.counts[lex.index[b""]]) if b"" in lex.index else 0
    base_total = float(np.log10(lex.total + 0.5 * (lex.distinct + 1)))

    def run(batches):
        from pyspark import TaskContext

        lex, model, z = shared.value
        row = TaskContext.get().partitionId() << 33
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "word", "n"]
        for b in batches:
            ids, held = b.column(0).to_pylist(), b.column(2).to_pylist()
            for first, bodies in pieces(b.column(1)):
                docs, rare, parts, lengths = [], ([], [], []), [], []
                for k, body in enumerate(bodies):
                    words = _words(body)
                    at, kind, away = sequence(words, lex)
                    here = at[at >= 0]
                    seen = np.log10(lex.counts[here] + 0.5)
                    parts.append(kind)
                    lengths.append(len(words) + 1)
                    # A word that shares its class has its count over the class's; the end and own words are their class.
                    inner = float(seen[lex.within[lex.classes[here]] != 0].sum()) - float(lex.within[kind].sum())
                    base = float(seen.sum()) + float(np.log10(ends + 0.5)) - base_total * (len(words) + 1)
                    docs.append((row, ids[first + k], held[first + k], len(words) + 1, len(here) + (ends > 0), base, inner))
                    for w, n in Counter(words[i] for i in away).items():
                        rare[0].append(row)
                        rare[1].append(w)
                        rare[2].append(n)
                    row += 1
                by_token = log_probabilities(model, z, grams(parts)).astype(np.float64)
                ends_at = np.cumsum(lengths)
                by_doc = np.add.reduceat(by_token, ends_at - lengths)
                cols = [pa.array([d[i] for d in docs], k) for i, k in enumerate(kinds[:-1])]
                cols.append(pa.array(by_doc + [d[6] for d in docs]))
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(docs), pa.string()), pa.nulls(len(docs), pa.int64())], names=names)
                if rare[0]:
                    n = len(rare[0])
                    empty = [pa.nulls(n, k) for k in kinds[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array(rare[0], pa.int64()), *empty, pa.array(rare[1], pa.binary()).cast(pa.string()), pa.array(rare[2], pa.int64())], names=names)

    passed = scratch.keep(docs.mapInArrow(run, PASSED), "passed")
    met = passed.filter("word IS NOT NULL").select("row", "word", "n").join(counts, "word", "left")
    extra = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("seen"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    out = passed.filter("word IS NULL").drop("word", "n").join(extra, "row", "left")
    more, known_too = F.coalesce("seen", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + known_too).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
