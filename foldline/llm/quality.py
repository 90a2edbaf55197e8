"""Quality by rules: a sparse rule ensemble as Spark columns, and boosted trees with base rules in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import trees
from .common import arrow_map, raw, ship, tidy, with_docs
from .textstats import COUNTS, FEATURES, labelled, statistics


@dataclass
class RuleModel:
    """Conjunctive rules over text statistics and their logistic weights."""

    rules: list[tuple[tuple[int, float, bool], ...]]
    weights: list[float]
    intercept: float

    def column(self, prefix: str = "") -> Column:
        """The score as a Spark expression over statistic columns."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            cond = None
            for f, t, at_most in rule:
                c = F.col(prefix + FEATURES[f])
                c = c <= t if at_most else c > t
                cond = c if cond is None else cond & c
            total = total + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(rule_matrix(self.rules, x) @ np.array(self.weights, float) + self.intercept)))


def rule_matrix(rules: list, x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, t, at_most in rule:
            out[:, j] *= x[:, f] <= t if at_most else x[:, f] > t
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient; the intercept is free."""
    n, m = z.shape
    a = np.hstack((z, np.ones((n, 1))))
    rate = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -40, 40))) - y) / n
        new = v - rate * grad
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - rate * penalty, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:m], float(w[m])


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4) -> RuleModel:
    """Rules from the paths of shallow boosted trees, thinned by the lasso.  Without two classes: the smoothed prior alone."""
    grown = trees.fit(x, y, trees=24, depth=3)
    rules = sorted({tuple(sorted(p)) for p in grown.paths()})
    if not rules:
        return RuleModel([], [], grown.base)
    z = rule_matrix(rules, x)
    keep, seen = [], set()
    for j in range(len(rules)):  # rules that hold on the same rows are one
        key = z[:, j].tobytes()
        if 0 < z[:, j].sum() < len(x) and key not in seen:
            seen.add(key)
            keep.append(j)
    z, rules = z[:, keep], [rules[j] for j in keep]
    w, b = lasso_logistic(z, y, penalty)
    chosen = np.flatnonzero(np.abs(w) > 1e-6).tolist()
    return RuleModel([rules[j] for j in chosen], [float(w[j]) for j in chosen], b)


def learn_rules(docs: DataFrame, labels: DataFrame, **sample) -> RuleModel:
    """Rules from at most 12,000 labelled documents (see ``textstats.labelled`` for nulls, repeats and empty tables).

    Without labels, or of one class, there are no rules, and every score is the smoothed share of good labels.
    """
    return fit_rules(*labelled(docs, labels, **sample))


_STATS = ", ".join(f"{f} double" for f in FEATURES)


def score(docs: DataFrame, model: RuleModel, *, threshold: float = 0.3, fold: int = 5, held_out: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the statistics of each row.

    A null or empty text has zero statistics and is scored from them; repeated rows each get their row; a null doc_id is
    not held out; very long texts are scored whole; an empty table gives no rows.
    """

    def run(_: dict, b: pa.RecordBatch) -> dict:
        _, rows = statistics(raw(b.column(1)))
        return {"doc_id": b.column(0), **{f: rows[:, j] for j, f in enumerate(FEATURES)}}

    found = arrow_map(with_docs(docs, doc_id, text), run, f"doc_id long, {_STATS}")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held_out, F.lit(False))
    found = found.select("doc_id", held.alias("held_out"), model.column().alias("score"), *FEATURES)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _with_new(docs: DataFrame, extra: list[tuple[str, str]], fn, text: str) -> tuple[DataFrame, list[str]]:
    """All columns of ``docs`` and new ones of names that don't clash; ``fn(bodies)`` gives the arrays."""
    ship(docs.sparkSession)
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    names = [prefix + n for n, _ in extra]
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, (_, kind) in zip(names, extra, strict=True))).fields])
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            if b.num_rows:
                new = fn(raw(b.column(at)))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in new)], names=[*b.schema.names, *names])

    return docs.mapInArrow(tidy(run), schema), names


def keep_good(docs: DataFrame, model: RuleModel, *, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules score at least ``threshold``, all columns as they are, whatever their names.

    A null or empty text is scored from zero statistics; ids aren't looked at, so null and repeated ones pass like others; very long
    texts are scored whole; an empty table gives no rows.
    """
    wide, names = _with_new(docs, [(f, "double") for f in FEATURES], lambda bodies: list(statistics(bodies)[1].T.copy()), text)
    prefix = names[0][: -len(FEATURES[0])]
    return wide.filter(model.column(prefix) >= threshold).select(*docs.columns)


# -- base rules and boosted trees --------------------------------------------------------------------------------------

#: Quality may only fall as these grow.
FALLING = ("symbol_share", "adjacent_share", "repeat_share", "dup_line_share")


def base_failed(counts: dict[str, np.ndarray], least_words: int = 10, repeat_percent: int = 20) -> np.ndarray:
    return (counts["n_words"] < least_words) | (100 * counts["n_repeat_words"] > repeat_percent * counts["n_words"])


def learn_trees(docs: DataFrame, labels: DataFrame, **sample) -> trees.Trees:
    """Boosted trees from the same bounded sample.  Without labels, or of one class, they give the smoothed share alone."""
    x, y = labelled(docs, labels, **sample)
    return trees.fit(x, y, trees=40, depth=3, monotone={FEATURES.index(f): -1 for f in FALLING})


def verdicts(docs: DataFrame, model: trees.Trees, *, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, probability and kept of each row.

    A null or empty text has no words and fails the base rules; repeated rows each get their row; very long texts are counted
    whole; an empty table gives none.
    """

    def run(_: dict, b: pa.RecordBatch) -> dict:
        counts, rows = statistics(raw(b.column(1)))
        failed, p = base_failed(counts), model.probability(rows)
        return {"doc_id": b.column(0), **counts, "base_failed": failed, "kept": ~failed & (p >= threshold), "probability": p}

    return arrow_map(with_docs(docs, doc_id, text), run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, probability double")


def keep_passing(docs: DataFrame, model: trees.Trees, *, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass base rules and trees, all columns as they are, whatever their names.

    A null or empty text has no words and fails; ids aren't looked at; very long texts are judged whole; an empty table gives no rows.
    """

    def judge(bodies: list[bytes]) -> list[np.ndarray]:
        counts, rows = statistics(bodies)
        return [~base_failed(counts) & (model.probability(rows) >= threshold)]

    wide, names = _with_new(docs, [("kept", "boolean")], judge, text)
    return wide.filter(F.col(names[0])).select(*docs.columns)
