"""Toxicity by weak supervision.

Voters are lexicon entries (words) and patterns (words that begin alike, once or several times in a text), mined from labelled
rows: greedily the one that speaks most for the toxic texts which few voters cover yet, so that a rare language has its own before
a common one has all of its words in all their forms. A voter that finds nothing abstains, which says nothing of the class: no
text is clean for lack of another language's words. Three voters have no term: the given label where it is 1, the given label
where it is 0, and finding no term at all. A generative label model explains the votes by a hidden class: each voter has its rates
in both classes, and the strongest correlation of each term's voter given the class is kept as an edge of a tree, so that voters
that repeat each other do not count twice. Expectation-maximization gives posterior labels; a linear classifier on the counts
behind the votes is trained on these posteriors and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import words as W
from riskframe.llm.labelled import SAMPLE_ROWS, held_out, sample

from riskframe.llm.tiling import APART

#: Bytes of a word's beginning that make a pattern; 0 stands for the whole word.
LENGTHS = (0, 4, 5, 6, 7, 8, 10)
#: A voter asks for a term at least so often in a text.
TIMES = (1, 2, 3)
#: Voters at least, and labelled rows that allow another one.
VOTERS, ROWS_A_VOTER = 256, 50
#: How many times likelier in the toxic class a voter is, and the toxic texts that it needs: so many, or this share of them.
LEAST_LIFT, LEAST_TEXTS, LEAST_SHARE = 4.0, 2, 0.001
#: The share that the first beliefs keep in the label model's steps.
ANCHOR = 0.5
#: A voter speaks for the equivalent of so many toxic texts that no other covers.
LEAST_GAIN = 1.0


def terms(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of texts: the text and the hash of every term, the number of words per text, the length family."""
    data, offsets = W.utf8(batch.column("text"))
    for lo, hi in W.blocks(offsets):
        part = offsets[lo : hi + 1]
        own = data[part[0] : part[-1]]
        found = W.words(own, part - part[0], space=APART)
        counts = np.diff(found.bounds)
        text = lo + np.repeat(np.arange(hi - lo), counts)
        names, at = [found.hash], [text]
        for length in LENGTHS[1:]:
            long, hashes = W.prefix_hashes(own, found, length)
            names.append(hashes)
            at.append(text[long])
        yield np.concatenate(at), np.concatenate(names), counts, np.arange(lo, hi)


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, times, toxic texts, other texts) of a batch."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        for text, name, _, _ in terms(batch):
            order = np.lexsort((text, name))
            text, name = text[order], name[order]
            first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])) if len(name) else np.zeros(0, int)
            count = np.diff(np.append(first, len(name)))
            toxic = label[text[first]]
            for times in TIMES:
                enough = count >= times
                names, which = np.unique(name[first][enough], return_inverse=True)
                ones = np.bincount(which, toxic[enough], len(names)).astype(np.int64)
                alls = np.bincount(which, minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.full(len(names), times, np.int32)),
                                                  pa.array(ones), pa.array(alls - ones)], ["term", "times", "toxic", "other"])


class Voters(NamedTuple):
    """Sorted distinct terms, and each voter's term (its place) and least count."""

    terms: np.ndarray
    term: np.ndarray
    times: np.ndarray

    def counts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """How often each text has each term, and the texts' words."""
        out, size = np.zeros((batch.num_rows, len(self.terms)), np.float32), np.zeros(batch.num_rows)
        likely = np.zeros(1 << 16, bool)
        likely[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        for text, name, counts, rows in terms(batch):
            maybe = np.flatnonzero(likely[(name >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, name[maybe]), len(self.terms) - 1)
            hit = self.terms[at] == name[maybe] if len(self.terms) else np.zeros(0, bool)
            np.add.at(out, (text[maybe][hit], at[hit]), 1)
            size[rows] = counts
        return out, size

    def votes(self, counts: np.ndarray) -> np.ndarray:
        return counts[:, self.term] >= self.times


def covering(text: np.ndarray, term: np.ndarray, telling: np.ndarray, voters: int) -> np.ndarray:
    """Terms in the order they are chosen. ``text``, ``term``: which toxic text has which term; ``telling``: each term's log lift.

    A text that c chosen terms cover counts 1 / (1 + c)^2; a term's gain is what its texts count, times its log lift over the
    largest one. Equal gains go by the term's place.
    """
    order = np.argsort(term, kind="stable")
    text, term = text[order], term[order]
    names, first = np.unique(term, return_index=True)
    ends = np.append(first[1:], len(term))
    covered = np.zeros(int(text.max()) + 1 if len(text) else 0)
    worth, free, chosen = telling[names] / max(telling.max(initial=0.0), 1e-9), np.ones(len(names), bool), []
    while len(chosen) < min(voters, len(names)):
        gain = np.where(free, np.add.reduceat(1 / (1 + covered[text]) ** 2, first) * worth, -1.0)
        k = int(gain.argmax())
        if gain[k] < LEAST_GAIN * min(1.0, worth[k]):
            break
        free[k] = False
        chosen.append(names[k])
        covered[text[first[k] : ends[k]]] += 1
    return np.array(chosen, np.int64)


def mine(rows: DataFrame, voters: int = VOTERS) -> Voters:
    """The voters that cover the toxic texts best (see ``covering``); their number grows with the labelled rows.

    What the driver holds is bounded by the sample: its telling terms, and which toxic text has which.
    """
    totals = rows.agg(F.sum("label"), F.count("*")).first()
    ones, others = float(totals[0] or 0), float(totals[1] - (totals[0] or 0))
    found = rows.select("text", "label").mapInArrow(_mined, "term long, times int, toxic long, other long")
    found = found.groupBy("term", "times").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    lift = ((F.col("toxic") + 0.5) / (ones + 1)) / ((F.col("other") + 0.5) / (others + 1))
    found = found.where(F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * ones)).withColumn("lift", lift).where(F.col("lift") >= LEAST_LIFT)
    # of a term's thresholds the most telling stays; evidence is the toxic texts times the log lift
    telling = F.struct((F.col("toxic") * F.log("lift")).alias("evidence"), (-F.col("times")).alias("fewest"), F.log("lift").alias("telling"))
    best = found.groupBy("term").agg(F.max(telling).alias("b")).select("term", "b.*").toArrow()
    names = best["term"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    names, times, log_lift = names[order], -best["fewest"].to_numpy()[order], best["telling"].to_numpy()[order]

    def has(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for text, name, _, _ in terms(batch):
                at = np.minimum(np.searchsorted(names, name), len(names) - 1)
                hit = names[at] == name
                pair, count = np.unique(text[hit] * len(names) + at[hit], return_counts=True)
                text, at = pair // len(names), pair % len(names)
                enough = count >= times[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[text[enough]]), pa.array(at[enough])], ["doc_id", "at"])

    if not len(names):
        return Voters(names, np.zeros(0, np.int64), np.zeros(0, np.int64))
    pairs = rows.where("label = 1").select("doc_id", "text").mapInArrow(has, "doc_id long, at long").toArrow()
    text = np.unique(pairs["doc_id"].to_numpy(), return_inverse=True)[1]
    chosen = np.sort(covering(text, pairs["at"].to_numpy(), log_lift, max(voters, int(ones + others) // ROWS_A_VOTER)))
    return Voters(names[chosen], np.arange(len(chosen)), times[chosen].astype(np.int64))


class LabelModel:
    """Two hidden classes, voters' rates in each, and a tree of the strongest correlations of term voters given the class."""

    def __init__(self, prior: float, plain: int = 0, rounds: int = 25) -> None:
        """``plain``: the last voters, which have no edge, as they exclude one another."""
        self.prior, self.plain, self.rounds = prior, plain, rounds

    @staticmethod
    def _tree(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Parent of each voter (-1: none) in the maximum spanning tree of mutual information given the class."""
        n = votes.shape[1]
        info = np.zeros((n, n))
        for w in (weight, 1 - weight):
            total = w.sum() + 1.0
            both = (votes.T * w) @ votes
            one = np.diag(both).copy()
            cells = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None] - both, (0, 0): total - 1 - one[:, None] - one[None] + both}
            for (a, b), cell in cells.items():
                p = (cell + 0.25) / total
                pa_ = ((one if a else total - 1 - one) + 0.5) / total
                pb = ((one if b else total - 1 - one) + 0.5) / total
                info += total / len(votes) * p * np.log(p / (pa_[:, None] * pb[None]))
        np.fill_diagonal(info, -np.inf)
        parent, inside = np.full(n, -1), np.zeros(n, bool)
        if n:
            inside[0] = True
            best, source = info[0].copy(), np.zeros(n, int)
            for _ in range(n - 1):
                k = int(np.where(inside, -np.inf, best).argmax())
                parent[k] = source[k] if best[k] > 1e-3 else -1
                inside[k] = True
                closer = info[k] > best
                best[closer], source[closer] = info[k][closer], k
        return parent

    def _given(self, votes: np.ndarray) -> np.ndarray:
        return np.where(self.parent[None] >= 0, votes[:, self.parent], False)

    def _rates(self, votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Log probability of a vote in each class given whether the parent voted: [class, parent's vote, voter]."""
        given = self._given(votes)
        out = np.zeros((2, 2, votes.shape[1]))
        for c, w in enumerate((1 - weight, weight)):
            rate = (w @ votes + 0.1) / (w.sum() + 1)
            for g in (0, 1):
                mine = w[:, None] * (given == g)
                out[c, g] = np.log((((mine * votes).sum(0) + 2 * rate) / (mine.sum(0) + 2)).clip(1e-9))  # two rows' worth of its own rate
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic class; abstentions do not count."""
        lift = self.rates[1] - self.rates[0]
        odds = np.log(self.prior / (1 - self.prior)) + (votes * np.where(self._given(votes), lift[1], lift[0])).sum(1)
        return 1 / (1 + np.exp(-odds.clip(-50, 50)))

    def fit(self, votes: np.ndarray, start: np.ndarray) -> LabelModel:
        """Rates by expectation-maximization from the beliefs ``start``, which keep their share of every step: as abstentions do not
        count, the class would else become "any vote at all"."""
        weight, terms = start, votes.shape[1] - self.plain
        for k in range(self.rounds):
            if k % 5 == 0:
                self.parent = np.append(self._tree(votes[:, :terms], weight), np.full(self.plain, -1))
            self.rates = self._rates(votes, weight)
            weight = ANCHOR * start + (1 - ANCHOR) * self.posterior(votes)
        return self


def inputs(counts: np.ndarray, size: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """What the classifier reads: counts of the terms, their share of the words, the number of votes, the length."""
    total = counts.sum(1).astype(float)
    return np.column_stack([np.log1p(counts), np.log1p(total), np.log1p(100 * total / np.maximum(size, 1)), np.log1p(votes.sum(1)), np.log1p(size)]).astype(np.float32)


class Linear(NamedTuple):
    """A logistic regression on scaled inputs."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(((x - self.mean) / self.scale) @ self.weight + self.bias).clip(-50, 50)))


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Linear:
    """Logistic regression on soft targets by Newton steps; the sums run over blocks of rows."""
    mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-6
    w, penalty = np.zeros(x.shape[1] + 1), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        slope, curve = -penalty * w, np.diag(penalty)
        for at in range(0, len(x), 2000):
            z = np.column_stack([(x[at : at + 2000] - mean) / scale, np.ones(len(x[at : at + 2000]))])
            p = 1 / (1 + np.exp(-(z @ w).clip(-50, 50)))
            slope += z.T @ (target[at : at + 2000] - p)
            curve += (z.T * (p * (1 - p))) @ z
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Linear(mean, scale, w[:-1], float(w[-1]))


def train(rows: DataFrame, voters: int = VOTERS) -> tuple[Voters, LabelModel, Linear] | None:
    """Voters, label model and classifier from (doc_id, text, label), a bounded table; None without both classes or a voter."""
    found = mine(rows, voters)
    if not len(found.terms):
        return None
    schema = "label int, size double, counts binary"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, size = found.counts(batch)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(size), pa.array([c.tobytes() for c in counts], pa.binary())],
                                             ["label", "size", "counts"])

    table = rows.select("doc_id", "text", "label").mapInArrow(counted, schema).toArrow()  # bounded by the sample's rows
    label, size = (table[c].to_numpy().astype(float) for c in ("label", "size"))
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.float32).reshape(len(label), -1)
    del table
    order = np.lexsort((label, size, *counts.T))  # the same sums whatever the order of the rows
    label, size, counts = label[order], size[order], counts[order]
    if label.min() == label.max():
        return None
    votes = found.votes(counts)
    given = np.column_stack([votes, label == 1, label == 0, ~votes.any(1)])
    model = LabelModel(label.mean(), plain=3).fit(given, 0.05 + 0.9 * label)
    return found, model, fit_linear(inputs(counts, size, votes), model.posterior(given))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, voters: int = VOTERS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text).

    Only texts are read for a score. ``labels`` (doc_id, toxic) trains on at most ``rows`` rows outside the held-out fold. A null
    or empty text scores as one without any vote; a null doc_id counts as held out; repeated rows score alike. Without labels of
    both classes every score is 0.
    """
    fitted = train(sample(docs, labels, "toxic", rows), voters)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if fitted is not None and batch.num_rows:
                counts, size = fitted[0].counts(batch)
                score = fitted[2].score(inputs(counts, size, fitted[0].votes(counts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
