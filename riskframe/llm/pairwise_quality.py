"""Quality by Bradley-Terry pairwise ranking.

A good and a bad labelled text make a preference pair. The chance that the first wins is the logistic function of the difference
of their scores, and a score is linear in features of the text alone; the weights minimize the logistic loss on the features'
differences. A quantile of the training texts' scores is the cut; scores are returned on a scale on which the cut is ``AT``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import words as W
from riskframe.llm.labelled import held_out, whole
from riskframe.llm.shared import stored, tasks

#: The returned score of a text at the cut.
AT = 0.3
#: Opponents that each text of the rarer label meets.
OPPONENTS = 25
#: Labelled texts of a group, about, within which pairs are drawn; pairs held at once; edges that scores are counted by for the cut.
GROUP_ROWS, PAIRS, EDGES = 20_000, 100_000, 65_536
_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&|<>", "shout": b"!?", "stop": b".,;:", "line": b"\n",
            "bar": b"|", "quote": b"\"'()[]{}", "link": b"/@=_", "other": range(128, 192)}


def features(column: pa.Array) -> np.ndarray:
    """A row of features per text: lengths, shares of character classes, and how much words, windows and lines repeat."""
    data, offsets = W.utf8(column)
    out = []
    for lo, hi in W.blocks(offsets):
        part = offsets[lo : hi + 1]
        own, ends = data[part[0] : part[-1]], part - part[0]
        found = W.words(own, ends)
        size = np.diff(ends).astype(float)
        words = np.diff(found.bounds).astype(float)
        rates = []
        for members in _CLASSES.values():
            table = np.zeros(256, np.int32)
            table[list(members)] = 1
            total = np.concatenate([[0], np.cumsum(table[own], dtype=np.int64)])
            rates.append(np.log1p(100 * (total[ends[1:]] - total[ends[:-1]]) / np.maximum(words, 1)))
        kinds, again, lines = np.zeros(hi - lo), np.zeros(hi - lo), np.zeros(hi - lo)
        for i in range(hi - lo):
            hashes = found.hash[found.bounds[i] : found.bounds[i + 1]]
            if len(hashes):
                kinds[i] = len(np.unique(hashes)) / len(hashes) ** 0.9
                windows = W.window_hashes(hashes, 5)
                again[i] = 1 - len(np.unique(windows)) / max(len(windows), 1)
                rows = [x for x in own[ends[i] : ends[i + 1]].tobytes().split(b"\n") if x.strip()]
                lines[i] = 1 - len(set(rows)) / max(len(rows), 1)
        length = np.log(np.maximum(size, 1) / np.maximum(words, 1))
        short = 1 / (1 + words)
        out.append(np.column_stack([np.log1p(words), np.log1p(words) ** 2 / 10, short, length, length**2, kinds, np.log1p(100 * again),
                                    np.log1p(100 * lines), again > 0.1, *rates, *(np.minimum(r, 2.0) for r in rates[:4])]))
    return np.concatenate(out) if out else np.zeros((0, 0))


class Ranking(NamedTuple):
    """Weights of scaled features and the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.raw(x) - self.cut + np.log(AT / (1 - AT))).clip(-50, 50)))


class _Tasks:
    """Sums over the groups of labelled texts, a row per group: its features and labels, in the order of its ids."""

    def __init__(self, groups: DataFrame) -> None:
        self.groups = groups

    def each(self, work: Callable[[int, np.ndarray, np.ndarray], Sequence[np.ndarray]]) -> list[list[np.ndarray]]:
        """What ``work`` (group, features, labels) makes of every group, in the groups' order: arrays whose size rows do not change."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group, x, label in zip(*(batch.column(c).to_pylist() for c in ("group", "x", "label")), strict=True):
                    label = np.frombuffer(label, np.int8)
                    made = work(group, np.frombuffer(x, np.float64).reshape(len(label), -1), label)
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([[np.asarray(m, np.float64).tobytes() for m in made]], pa.list_(pa.binary()))],
                                                     ["group", "made"])

        found = self.groups.mapInArrow(run, "group long, made array<binary>").collect()  # a few KB per GROUP_ROWS rows
        return [[np.frombuffer(m, np.float64) for m in r["made"]] for r in sorted(found, key=lambda r: r["group"])]


def _pairs(label: np.ndarray, rare: int, group: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(winners, losers) of a group: each text of the rarer label meets OPPONENTS of the other."""
    few, often = np.flatnonzero(label == rare), np.flatnonzero(label == 1 - rare)
    if not len(few) or not len(often):
        return few[:0], few[:0]
    met = np.random.default_rng(seed + group).choice(often, (len(few), OPPONENTS))
    win, lose = (met.ravel(), np.repeat(few, OPPONENTS))
    return (win, lose) if rare == 0 else (lose, win)


def fit(groups: DataFrame, seed: int = 5, ridge: float = 1e-3, rounds: int = 40) -> Ranking | None:
    """Bradley-Terry weights, and the score quantile that parts the labels best (the two classes weigh the same).

    Every sum runs over all labelled texts, group by group in tasks; a step of Newton's method is one scan of their features.
    """
    sums = _Tasks(groups)
    facts = sums.each(lambda g, x, label: [np.array([len(x), (label == 1).sum(), (label == 0).sum()]), x.sum(0)])
    if not facts:
        return None
    n, n_good, n_bad = np.sum([f[0] for f in facts], 0)
    if not n_good or not n_bad:
        return None
    mean = np.sum([f[1] for f in facts], 0) / n
    scale = np.sqrt(np.sum([f[0] for f in sums.each(lambda g, x, label: [((x - mean) ** 2).sum(0)])], 0) / n) + 1e-6
    rare, d = (0 if n_bad <= n_good else 1), len(mean)
    w = np.zeros(d)

    def slopes(group: int, x: np.ndarray, label: np.ndarray) -> Sequence[np.ndarray]:
        win, lose = _pairs(label, rare, group, seed)
        z = ((x - mean) / scale).clip(-8, 8)
        first, second, met = np.zeros(d), np.zeros((d, d)), 0
        for s in range(0, len(win), PAIRS):
            gap = z[win[s:s + PAIRS]] - z[lose[s:s + PAIRS]]
            p = 1 / (1 + np.exp(-(gap @ w).clip(-50, 50)))
            first, second, met = first + gap.T @ (1 - p), second + (gap.T * (p * (1 - p))) @ gap, met + len(gap)
        return [first, second.ravel(), np.array([met])]

    for _ in range(rounds):
        first, second, met = (np.sum(parts, 0) for parts in zip(*sums.each(slopes), strict=True))
        step = np.linalg.solve(second.reshape(d, d) / met[0] + ridge * np.eye(d), first / met[0] - ridge * w)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break

    def raw(x: np.ndarray) -> np.ndarray:
        return ((x - mean) / scale).clip(-8, 8) @ w

    shares = np.arange(1, 1000) / 1000
    if len(facts) == 1:
        cuts = sums.each(lambda g, x, label: [np.quantile(raw(x), shares)])[0][0]
    else:  # the first of many even edges that the share is below
        ends = sums.each(lambda g, x, label: [np.array([raw(x).min(), raw(x).max()])])
        edges = np.linspace(min(e[0][0] for e in ends), max(e[0][1] for e in ends), EDGES)
        counted = sums.each(lambda g, x, label: [np.bincount(np.searchsorted(edges, raw(x), "right"), minlength=EDGES + 1)])
        below = np.cumsum(np.sum([c[0] for c in counted], 0))[:-1]
        cuts = edges[np.searchsorted(below, shares * n, "left").clip(max=EDGES - 1)]
    under = sums.each(lambda g, x, label: [np.searchsorted(np.sort(raw(x)[label == c]), cuts, "left") for c in (0, 1)])
    zeros, ones = (np.sum(c, 0) for c in zip(*under, strict=True))  # texts of each label below each cut
    right = (1 - ones / n_good) + zeros / n_bad
    return Ranking(mean, scale, w, float(cuts[right.argmax()]))


def train(rows: DataFrame) -> Ranking | None:
    """A ranking from all rows of (doc_id, text, label); None without both labels."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())],
                                             ["doc_id", "label", "x"])

    read_rows = stored(rows.select("doc_id", "text", "label").mapInArrow(read, "doc_id long, label int, x binary").where("label in (0, 1)"), "features")
    n = read_rows.count()
    many = max(1, -(-n // GROUP_ROWS))

    def packed(table: pa.Table) -> pa.Table:
        own = sorted(zip(table.column("doc_id").to_pylist(), table.column("label").to_pylist(), table.column("x").to_pylist(), strict=True))
        return pa.table([pa.array([table.column("group")[0].as_py()], pa.int64()), pa.array([b"".join(r[2] for r in own)], pa.binary()),
                         pa.array([np.array([r[1] for r in own], np.int8).tobytes()], pa.binary())], ["group", "x", "label"])

    dealt = read_rows.withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(many)))
    parts = min(many, tasks(rows.sparkSession))
    groups = dealt.repartition(parts, "group").groupBy("group").applyInArrow(packed, "group long, x binary, label binary")
    return fit(stored(groups, "groups"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text).

    Only texts are read for a score. ``labels`` (doc_id, quality) trains on all rows outside the held-out fold. Null
    and empty texts score as texts without words; a null doc_id counts as held out; repeated rows score alike. Without labels of
    both classes every score is 0.
    """
    ranking = train(whole(docs, labels, "quality"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if ranking is not None and batch.num_rows:
                score = ranking.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))
