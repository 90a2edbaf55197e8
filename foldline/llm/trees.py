"""Gradient-boosted trees for two classes in numpy: histograms, flat node arrays, monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Flat arrays over all nodes of all trees: ``feature`` is -1 at a leaf; a row goes left where ``x <= threshold``."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row, all trees stepping together over all rows."""
        out = np.full(len(x), self.base)
        if not len(self.roots) or not len(x):
            return out
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return out + self.value[at].sum(1)
            go = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, go, at)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))

    def paths(self) -> list[tuple[tuple[int, float, bool], ...]]:
        """Every path from a root to a node: (feature, threshold, whether at most)."""
        out = []

        def walk(node: int, path: tuple) -> None:
            if path:
                out.append(path)
            if self.feature[node] >= 0:
                f, t = int(self.feature[node]), float(self.threshold[node])
                walk(int(self.left[node]), (*path, (f, t, True)))
                walk(int(self.right[node]), (*path, (f, t, False)))

        for r in self.roots.tolist():
            walk(r, ())
        return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, ridge: float = 1.0, least: int = 8, monotone: dict[int, int] | None = None) -> Trees:
    """Boosted trees by second-order gain; ``monotone[f]`` is +1 or -1 where the margin may only rise or fall with feature f.

    A constrained split needs child values in that order, and both subtrees keep to their side of the values' middle.
    Without two classes the model is the (smoothed) prior alone.
    """
    monotone = monotone or {}
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    nodes: list[list] = []
    roots: list[int] = []
    if len(np.unique(y)) == 2:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)

            def grow(rows: np.ndarray, level: int, low: float, high: float, g=g, h=h) -> int:
                gs, hs = g[rows].sum(), h[rows].sum()
                me = len(nodes)
                nodes.append([-1, 0.0, -1, -1, float(np.clip(-gs / (hs + ridge), low, high)) * rate])
                if level == depth or len(rows) < 2 * least:
                    return me
                best = (1e-6, None)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, f]
                    size = len(c) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                    gr, hr, nr = gs - gl, hs - hl, len(rows) - nl
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
                    ok = (nl >= least) & (nr >= least)
                    if sign := monotone.get(f, 0):
                        ok &= sign * (np.clip(-gr / (hr + ridge), low, high) - np.clip(-gl / (hl + ridge), low, high)) >= 0
                    gain = np.where(ok, gain, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, float(np.clip(-gl[k] / (hl[k] + ridge), low, high)), float(np.clip(-gr[k] / (hr[k] + ridge), low, high))))
                if best[1] is None:
                    return me
                f, k, vl, vr = best[1]
                go = binned[rows, f] <= k
                left, right = (low, high), (low, high)
                if sign := monotone.get(f, 0):
                    mid = (vl + vr) / 2
                    left, right = ((low, mid), (mid, high)) if sign > 0 else ((mid, high), (low, mid))
                a = grow(rows[go], level + 1, *left)
                b = grow(rows[~go], level + 1, *right)
                nodes[me][:4] = [f, float(cuts[f][k]), a, b]
                return me

            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
            part = _flat(roots[-1:], nodes, 0.0)
            margin = margin + part.margins(x)
    return _flat(roots, nodes, base)


def _flat(roots: list[int], nodes: list[list], base: float) -> Trees:
    cols = list(zip(*nodes, strict=True)) if nodes else [()] * 5
    return Trees(np.array(roots, np.int32), np.array(cols[0], np.int32), np.array(cols[1], float), np.array(cols[2], np.int32), np.array(cols[3], np.int32), np.array(cols[4], float), base)
