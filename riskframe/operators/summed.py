"""Regression trees grown side by side from summed histograms, a pass a level for all of them.

Every task adds the rows of its blocks to the histograms of the nodes they are in. Few and small ones are summed by the driver,
which saves half the time of a small pass; else a shuffle sums them, and only cuts reach the driver. A node's cut is the one that
lowers the variance most, as in MLlib.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD

from .grown import BINS

#: Bytes of histograms that all tasks of a pass may send to the driver.
DIRECT = 32 << 20
#: A tree's view of a block: bins (features x rows), and per row how often it is drawn (None: all once), its mass and its target.
View = tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]


@dataclass
class Nodes:
    """Trees in one numbering. A second child follows the first; a leaf is its own child and cuts nothing off."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int = 0

    @classmethod
    def stumps(cls, trees: int) -> Nodes:
        return cls(np.arange(trees), np.zeros(trees, np.int64), np.full(trees, BINS, np.int64), np.arange(trees), np.zeros(trees))

    @classmethod
    def joined(cls, parts: Iterable[Nodes]) -> Nodes:
        parts = list(parts)
        base = np.cumsum([0, *[len(p.child) for p in parts[:-1]]])
        cells = [np.concatenate([getattr(p, k) for p in parts]) for k in ("feature", "cut", "value")]
        roots, child = (np.concatenate([getattr(p, k) + b for p, b in zip(parts, base, strict=True)]) for k in ("roots", "child"))
        return cls(roots, cells[0], cells[1], child, cells[2], max(p.depth for p in parts))

    def leaves(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The leaf of every row (``x`` is features x rows) in one tree."""
        flat, n = x.reshape(-1), x.shape[1]
        rows, at = np.arange(n), np.full(n, self.roots[tree])
        for _ in range(self.depth):
            at = self.child.take(at) + (flat.take(self.feature.take(at) * n + rows) > self.cut.take(at))
        return at

    def values(self, tree: int, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(tree, x)]

    def state(self) -> dict:
        return {"depth": self.depth, **{k: getattr(self, k).tolist() for k in ("roots", "feature", "cut", "child", "value")}}

    @classmethod
    def of(cls, s: dict) -> Nodes:
        whole = {k: np.array(s[k], np.int64) for k in ("roots", "feature", "cut", "child")}
        return cls(**whole, value=np.array(s["value"], np.float64), depth=s["depth"])


@dataclass
class Cut:
    slot: int
    feature: int
    bin: int  # -1: the node stays a leaf
    gain: float
    value: float
    sides: list[tuple[float, int]] = field(default_factory=list)  # value and drawn rows of both children


def _best(slot: int, sums: np.ndarray, tried: np.ndarray, picked: np.ndarray, leaf: int) -> Cut:
    """The best cut of a node from its sums: columns x (drawn rows, mass, mass x target) x bins."""
    left = sums.cumsum(2)
    total = left[:, :, -1:]
    right = total - left
    score = left[:, 2]**2 / np.maximum(left[:, 1], 1e-300) + right[:, 2]**2 / np.maximum(right[:, 1], 1e-300)
    mass, least = total[0, 1, 0], 1e-12 * max(total[0, 1, 0], 1e-300)
    score[(left[:, 0] < leaf) | (right[:, 0] < leaf) | (left[:, 1] <= least) | (right[:, 1] <= least)] = -1.0
    score[~picked] = -1.0
    j, b = np.unravel_index(score.argmax(), score.shape)
    own = total[0, 2, 0]**2 / max(mass, 1e-300)
    value = float(total[0, 2, 0] / mass) if mass > 0 else 0.0
    if not score[j, b] > own * (1 + 1e-9) + 1e-12:
        return Cut(slot, 0, -1, 0.0, value)
    return Cut(slot, int(tried[j]), int(b), float(score[j, b] - own), value,
               [(float(s[j, 2, b] / s[j, 1, b]), int(s[j, 0, b])) for s in (left, right)])


def grow(blocks: RDD, view: Callable[[object], Iterable[View]], trees: int, features: int, depth: int, leaf: int, picks: int, seed: int,
         parts: int) -> tuple[Nodes, np.ndarray]:
    """The trees and their gains (trees x features). ``view`` yields what each tree sees of a block, the same in every pass."""
    nodes, gains = Nodes.stumps(trees), np.zeros((trees, features))
    live, tree_of = np.arange(trees), np.arange(trees)
    few = 2 * picks < features  # only the tried features are counted, else all are and the others not looked at
    for level in range(depth):
        order = np.array([np.random.default_rng([seed, 2, int(n)]).permutation(features) for n in live])
        tried = order[:, :picks] if few else np.tile(np.arange(features), (len(live), 1))
        picked = np.ones(tried.shape, bool) if few else np.argsort(order, 1) < picks
        slot = np.full(len(nodes.child), -1, np.int64)
        slot[live] = np.arange(len(live))
        low, high = (np.searchsorted(tree_of[live], np.arange(trees), s) for s in ("left", "right"))
        found = _pass(blocks, view, nodes, slot, low, high, tried, picked, few, leaf, parts)
        nodes.depth, more, born, total = level + 1, [], [], len(nodes.child)
        for c in sorted(found, key=lambda c: c.slot):
            node = live[c.slot]
            nodes.value[node] = c.value
            if c.bin < 0:
                continue
            gains[tree_of[node], c.feature] += c.gain
            nodes.feature[node], nodes.cut[node], nodes.child[node] = c.feature, c.bin, total + len(born)
            for value, n in c.sides:
                if n >= 2 * leaf:
                    more.append(total + len(born))
                born.append((value, tree_of[node]))
        if not born:
            break
        nodes.feature = np.concatenate([nodes.feature, np.zeros(len(born), np.int64)])
        nodes.cut = np.concatenate([nodes.cut, np.full(len(born), BINS, np.int64)])
        nodes.child = np.concatenate([nodes.child, total + np.arange(len(born))])
        nodes.value = np.concatenate([nodes.value, [v for v, _ in born]])
        tree_of = np.concatenate([tree_of, np.array([t for _, t in born], np.int64)])
        live = np.array(more, np.int64)
        if not len(live):
            break
    return nodes, gains


def _pass(blocks: RDD, view: Callable, nodes: Nodes, slot: np.ndarray, low: np.ndarray, high: np.ndarray, tried: np.ndarray, picked: np.ndarray, few: bool,
          leaf: int, parts: int) -> list[Cut]:
    columns, starts = tried.shape[1], np.ascontiguousarray(tried.T)

    def count(part: int, its: Iterator) -> Iterator[tuple[int, np.ndarray]]:
        sums = None
        for block in its:
            sums = np.zeros((len(tried), columns, 3, BINS)) if sums is None else sums
            for t, (x, c, w, r) in enumerate(view(block)):
                first, size = low[t], (high[t] - low[t]) * BINS
                if not size or not len(r):
                    continue
                at = slot.take(nodes.leaves(t, x))
                if at.min() < 0:
                    keep = np.flatnonzero(at >= 0)
                    w = w.take(keep) if w is not c else None
                    x, c, r, at = x.take(keep, 1), None if c is None else c.take(keep), r.take(keep), at.take(keep)
                    w = c if w is None else w
                base, wr, flat, rows = (at - first) * BINS, w * r, x.reshape(-1), np.arange(len(at))
                for j in range(columns):
                    key = base + (flat.take(starts[j].take(at) * len(at) + rows) if few else x[j])
                    found = [np.bincount(key, v, size).reshape(-1, BINS) for v in ((c, wr) if w is c else (c, w, wr))]
                    sums[first:high[t], j] += np.stack(found if len(found) == 3 else [found[0], *found], 1)
        if sums is not None:
            yield part, sums

    def choose(its: Iterator[tuple[int, tuple[int, np.ndarray]]]) -> Iterator[Cut]:
        met: dict[int, list] = {}
        for s, own in its:
            met.setdefault(s, []).append(own)
        for s, own in met.items():
            yield _best(s, _sum(own), tried[s], picked[s], leaf)

    counted = blocks.mapPartitionsWithIndex(count)
    if blocks.getNumPartitions() * tried.size * 3 * BINS * 8 <= DIRECT:
        found = counted.collect()
        total = _sum(found) if found else []
        return [_best(s, own, tried[s], picked[s], leaf) for s, own in enumerate(total)]
    dealt = counted.flatMap(lambda own: [(s, (own[0], v)) for s, v in enumerate(own[1])]).partitionBy(min(parts, len(tried)), int)
    return dealt.mapPartitions(choose).collect()  # a cut per node


def _sum(found: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """Summed in the same order however they came."""
    return sum(v for _, v in sorted(found, key=lambda own: own[0]))
