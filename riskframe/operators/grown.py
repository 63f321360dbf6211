"""Many forests over one table in one job: each fit grows its trees level by level and scores every prefix and depth it is asked for.

A search over tree counts and depths needs no fit of its own for each: a forest of fewer trees is a prefix of a larger one, and a
shallower forest is the same node table read down to a depth (nodes draw their features level by level, so it is the very tree
that a fit to that depth grows; MLlib draws anew, so a refit by it scores a little differently). A fit is a group of a Spark
shuffle: the rows it learns from, as bins, meet in one task, which is why ``ROWS`` bounds the table; beyond it the callers use
``forests``, whose fits are spread over all tasks. Only confusion counts leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table whose fits each run in one task: about 10 MB of bins, labels and weights.
ROWS = 200_000
#: Candidate cuts per feature, and pairs of rows and trees that are grown at once.
BINS, PAIRS = 32, 600_000
#: Rows and nodes of a level that are worked on at once, rows that walk down a tree at once, levels they go before those at leaves are left out.
PART_ROWS, PART_NODES, WALKED, STEPS = 131_072, 1_024, 32_768, 4
COUNTS = "plot int, trees int, depth int, held boolean, y int, p int, n long"


@dataclass(frozen=True)
class Plot:
    """One fit: which rows it leaves out, how its trees grow, and the prefixes and depths that are scored."""

    at: int
    fold: int
    step: int
    leaf: int
    picks: int
    share: float
    trees: tuple[int, ...]
    depths: tuple[int, ...]


def picked(rule: str, features: int) -> int:
    """Features tried at a node."""
    found = {"sqrt": math.ceil(math.sqrt(features)), "log2": math.ceil(math.log2(features)) if features > 1 else 1}[rule]
    return min(max(found, 1), features)


class Walk:
    """The way of rows down node tables: a node's first child, feature and cut are one number, and a leaf is its own child."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> None:
        leaf = child < 0
        self.nodes = (np.where(leaf, np.arange(len(child)), child).astype(np.int64) << 24) | np.where(leaf, 0, feature).astype(np.int64) << 8
        self.nodes |= np.where(leaf, 255, cut)

    def steps(self, root: int, cells: np.ndarray, depths: Sequence[int], rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """The node of every row (or those named) at each of the rising depths at most; ``cells`` is rows x features, contiguous bytes."""
        flat, nodes = cells.reshape(-1), self.nodes
        place = np.arange(0, flat.size, cells.shape[1]) if rows is None else rows * cells.shape[1]
        last = at = np.full(len(place), root, np.int64)
        live, level = None, 0
        for depth in depths:
            while level < depth and len(at):
                upto = min(depth, level + STEPS)
                for _ in range(upto - level):
                    node = nodes.take(at)
                    at = (node >> 24) + (flat.take(place + (node >> 8 & 0xFFFF)) > node.astype(np.uint8))
                level = upto
                if live is None:
                    last = at
                else:
                    last[live] = at
                going = np.flatnonzero(nodes.take(at) >> 24 != at)
                if len(going) < 0.8 * len(at):
                    last, live = (last.copy(), going) if live is None else (last, live.take(going))
                    at, place = at.take(going), place.take(going)
            yield depth, last


class Trees:
    """Node tables of trees grown together: feature, bin, first child (the second follows it), class shares.

    Rows lie node by node, so a level is worked on in parts that stay in the processor's cache. Nodes that cannot be split, as they
    are pure or too small, are left out as soon as they are known.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, draws: np.ndarray, leaf: int, picks: int, depth: int,
                 rng: np.random.Generator) -> None:
        n_trees, features = draws.shape[0], x.shape[1]
        tree, row = np.nonzero(draws)
        self.roots = n_trees  # nodes 0 to n_trees - 1
        self.feature, self.cut, self.child = np.zeros(n_trees, np.int16), np.zeros(n_trees, np.int16), np.full(n_trees, -1, np.int64)
        self.gain = []  # (features, gains in purity) of the nodes split at each level
        count = draws[tree, row].astype(np.float64)
        cells = np.zeros((len(row), -(-features // 8) * 8), np.uint8)  # whole words, which move at once
        cells[:, :features] = x[row]
        own, mine, each = y[row].astype(np.int64), count * w[row], _each(y, w, classes)
        mass, drawn = np.bincount(tree * classes + own, mine, n_trees * classes).reshape(-1, classes), np.bincount(tree, count, n_trees)
        self.share = _shares(mass)
        rows = [cells.view(np.uint64), own, mine, *([count] if each is None else [])]
        size, opened, bins = np.bincount(tree, minlength=n_trees), _open(mass, drawn, leaf), int(x.max()) + 1 if x.size else 1
        if not opened.all():
            keep = np.flatnonzero(np.repeat(opened, size))
            rows = [v.take(keep, 0) for v in rows]
        ids, size, mass, drawn = np.flatnonzero(opened), size[opened], mass[opened], drawn[opened]
        first, total = 0, n_trees
        for _ in range(depth):
            if not len(ids):
                break
            # drawn for all nodes of the level, the closed ones, too
            tried = np.argpartition(rng.random((total - first, features))[ids - first], picks - 1, 1)[:, :picks]
            ends, lo, found = np.concatenate([[0], np.cumsum(size)]), 0, []
            while lo < len(ids):
                hi = min(max(int(np.searchsorted(ends, ends[lo] + PART_ROWS, "right")) - 1, lo + 1), lo + PART_NODES)
                found.append(_split([v[ends[lo]:ends[min(hi, len(ids))]] for v in rows], size[lo:hi], mass[lo:hi], drawn[lo:hi], tried[lo:hi], leaf, bins, each))
                lo = hi
            *found, lefts, rights = zip(*found, strict=True)
            feature, cut, gain, size, mass, drawn = (np.concatenate(v) for v in found)
            order = np.flatnonzero(cut >= 0)
            if not len(order):
                break
            order = order[np.argsort(ids[order])]
            at = ids[order]
            self.gain.append((feature[order], gain[order]))
            self.feature[at], self.cut[at], self.child[at] = feature[order], cut[order], total + 2 * np.arange(len(order))
            child = self.child[ids]
            first, total = total, total + 2 * len(order)
            self.share = np.concatenate([self.share, _shares(mass[order].reshape(2 * len(order), -1))])
            self.feature, self.cut = (np.concatenate([v, np.zeros(total - first, np.int16)]) for v in (self.feature, self.cut))
            self.child = np.concatenate([self.child, np.full(total - first, -1, np.int64)])
            # the first children of all nodes, then the second ones
            rows = [np.concatenate(v) for v in zip(*lefts, *rights, strict=True)]
            ids, size, mass, drawn = (np.concatenate([v[size[:, s] > 0, s] for s in (0, 1)]) for v in (np.column_stack([child, child + 1]), size, mass, drawn))

    def gains(self, features: int) -> np.ndarray:
        """The sum of the splits' gains by feature, over all trees."""
        return sum((np.bincount(f, g, features) for f, g in self.gain), np.zeros(features))

    def votes(self, x: np.ndarray, depths: Sequence[int]) -> dict[int, np.ndarray]:
        """For each depth, the sum over the trees of the class shares of each row's node at that depth at most."""
        walk, x = Walk(self.feature, self.cut, self.child), np.ascontiguousarray(x)
        out = {d: np.zeros((len(x), self.share.shape[1])) for d in depths}
        for lo in range(0, len(x), WALKED):
            for root in range(self.roots):
                for d, at in walk.steps(root, x[lo:lo + WALKED], sorted(depths)):
                    out[d][lo:lo + WALKED] += self.share.take(at, 0)
        return out


def _shares(mass: np.ndarray) -> np.ndarray:
    weight = mass.sum(1)
    return np.where(weight[:, None] > 0, mass / np.maximum(weight, 1e-300)[:, None], 1.0 / mass.shape[1])


def _open(mass: np.ndarray, drawn: np.ndarray, leaf: int) -> np.ndarray:
    """Which nodes a cut can make purer: two classes, and rows enough for both sides."""
    return (drawn >= 2 * leaf) & ((mass != 0).sum(-1) > 1)


def _each(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray | None:
    """The weight of each class if all its rows have the same, above 0; a mass then tells how many rows it is."""
    each = np.ones(classes)
    each[y] = w
    return each if (each > 0).all() and (each[y] == w).all() else None


def _split(rows: Sequence[np.ndarray], size: np.ndarray, mass: np.ndarray, drawn: np.ndarray, tried: np.ndarray, leaf: int, bins: int,
           each: np.ndarray | None) -> tuple:
    """The best cut of each node, and of its two sides the rows that can be split on: (feature, cut, gain, rows, masses, draws), rows left, rows right.

    ``rows`` (features' bins, class, mass, and draws if they do not follow from the masses) lie node by node, ``size`` each.
    """
    words, own, mine = rows[:3]
    (k, classes), flat = mass.shape, words.view(np.uint8).reshape(-1)
    kind = np.int32 if max(flat.size, bins * classes * k) < 2**31 else np.int64
    place, slot = np.arange(0, flat.size, 8 * words.shape[1], kind), np.repeat(np.arange(k, dtype=kind), size)
    base, whole = own.astype(kind) * kind(k) + slot, np.ascontiguousarray(mass.T)
    # the sum of squared masses over the mass: less by the node's own, a gain in purity
    weight = mass.sum(1)
    pure = np.where(weight > 0, (mass**2).sum(1) / np.maximum(weight, 1e-300), 0.0)
    best = pure * (1 + 1e-9) + 1e-12
    feature, cut, n_left = np.zeros(k, np.int16), np.full(k, -1, np.int16), np.zeros(k)
    for f in tried.T:
        value = flat.take(np.repeat(f.astype(kind), size) + place).astype(kind)
        left = np.bincount(value * kind(classes * k) + base, mine, bins * classes * k).reshape(bins, classes, k)
        for b in range(1, bins):
            left[b] += left[b - 1]
        if each is None:
            n = np.bincount(value * kind(k) + slot, rows[3], bins * k).reshape(bins, k).cumsum(0)
        elif (each == 1).all():
            n = left.sum(1)
        else:
            n = sum(np.rint(left[:, c] * (1 / e)) for c, e in enumerate(each))
        right = whole - left
        a, b = left.sum(1), right.sum(1)
        bad = (n < leaf) | (n > drawn - leaf) | (a <= 0) | (b <= 1e-12)
        score = np.square(left, out=left).sum(1)
        score /= np.maximum(a, 1e-300, out=a)
        other = np.square(right, out=right).sum(1)
        other /= np.maximum(b, 1e-300, out=b)
        score += other
        score = np.where(bad, -1.0, score)
        top = score.max(0)
        better = np.flatnonzero(top > best)
        c = (score == top).argmax(0)[better]
        best[better], feature[better], cut[better], n_left[better] = top[better], f[better], c, n[c, better]
    second = flat.take(np.repeat(feature.astype(kind), size) + place) > np.repeat(cut, size)
    side = 2 * slot + second
    masses = np.bincount(side * kind(classes) + own, mine, 2 * k * classes).reshape(k, 2, classes)
    draws = np.column_stack([n_left, drawn - n_left])
    goes = _open(masses, draws, leaf) & (cut >= 0)[:, None]
    late = np.add.reduceat(second, np.cumsum(size) - size, dtype=np.int64)
    live = goes.ravel().take(side)
    kept = [[v.take(at, 0) for v in rows] for at in (np.flatnonzero(live & ~second), np.flatnonzero(live & second))]
    return feature, cut, best - pure, np.column_stack([size - late, late]) * goes, masses, draws, *kept


def confusion_counts(x: np.ndarray, y: np.ndarray, w: np.ndarray, learn: np.ndarray, held: np.ndarray, classes: int, plot: Plot, seed: int
                     ) -> Iterator[tuple]:
    """(trees, depth, held, y, p, n) of one fit on the rows ``learn``, scored on them and on the rows ``held``."""
    own = np.flatnonzero(learn)
    scored = np.flatnonzero(learn | held)
    sums = {d: np.zeros((len(scored), classes)) for d in plot.depths}
    done, most = 0, max(plot.trees)
    ends = sorted(plot.trees)
    while done < most and len(own):
        upto = min(done + max(1, PAIRS // len(scored)), next(e for e in ends if e > done))
        draws = np.array([np.random.default_rng([seed, t]).poisson(plot.share, len(own)) for t in range(done, upto)])
        trees = Trees(x[own], y[own], w[own], classes, draws, plot.leaf, plot.picks, max(plot.depths), np.random.default_rng([seed, done, 1]))
        for d, votes in trees.votes(x[scored], plot.depths).items():
            sums[d] += votes
        done = upto
        if done in ends:
            for d in plot.depths:
                guess = sums[d].argmax(1)
                table = np.bincount((held[scored] * classes + y[scored]) * classes + guess, minlength=2 * classes * classes)
                for cell in np.flatnonzero(table):
                    yield done, d, bool(cell >= classes * classes), int(cell // classes % classes), int(cell % classes), int(table[cell])


def evaluate(df: DataFrame, features: Sequence[str], label: str, plots: Sequence[Plot], fold: str, step: str | None = None, weight: str | None = None,
             classes: int = 3, seed: int = 42) -> DataFrame:
    """(plot, trees, depth, held, y, p, n): confusion counts of every plot, prefix and depth.

    ``label`` is a code from 0. A plot learns from the rows of other folds and of steps up to its own, and is scored on them and on
    its fold. Features are cut into BINS by quantiles of the whole table; a null or NaN is an error, as in MLlib's assembler.
    """
    points = [k / BINS for k in range(1, BINS)]
    got = df.agg(*[F.percentile_approx(c, points, 10_000).alias(c) for c in features]).first()
    cuts = [np.unique(np.array(got[c] or [], np.float64)) for c in features]
    whole = df.select(*[F.assert_true(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), f"{c} must be filled").alias(f"_{c}") for c in features],
                      F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).cast("int").alias("y"),
                      (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.col(fold).cast("int").alias("fold"),
                      (F.col(step).cast("int") if step else F.lit(0)).alias("step"))
    checked = whole.where(F.coalesce(*[F.col(f"_{c}") for c in features], F.lit(None)).isNull()).select("x", "y", "w", "fold", "step")
    by = {p.at: p for p in plots}

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        plot = by[key[0].as_py()]
        values = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        y, w, f, s = (table.column(c).to_numpy() for c in ("y", "w", "fold", "step"))
        order = np.lexsort((*values.T, y, w, s, f))  # the same rows in the same order, however they came
        values, y, w, f, s = values[order], y[order].astype(np.int64), w[order], f[order], s[order]
        x = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, values.T, strict=True)]).astype(np.uint8)
        held = f == plot.fold
        rows = [(plot.at, *r) for r in confusion_counts(x, y, w, ~held & (s <= plot.step), held, classes, plot, seed)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split(" ")[0] for c in COUNTS.split(", ")])

    dealt = checked.withColumn("plot", F.explode(F.array(*[F.lit(p.at) for p in plots])))
    # more parts than fits: few fits meet in a part, and free cores take the next
    return dealt.repartition(4 * len(plots), "plot").groupBy("plot").applyInArrow(fit, COUNTS)
