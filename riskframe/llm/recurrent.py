"""Language-model scores by a gated recurrent network in numpy.

The output softmax is factored into classes. Frequent words form classes of equal size, and the network predicts the class and the
word in it; every other word falls into a class that its spelling alone decides, in which it has its smoothed share of the class's
training tokens. Counts cover all training documents: those of frequent words are broadcast (a bounded table), those of rare words
meet the tokens in a join. Training runs truncated backpropagation over all training documents, in parallel from one warm start,
and averages the weights; scoring carries the state over whole documents, many documents side by side.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm import words as W
from riskframe.llm.shared import stored

#: Rows whose crc32(doc_id as text) leaves this remainder by FOLDS are not learned from.
FOLDS, HELD = 7, 2
#: Words with a count that are broadcast, at most (16 bytes each), and words that the network itself predicts.
HEAD_WORDS, CLASSES, CLASS_WORDS = 1 << 18, 40, 50
#: Spelling classes of the other words: last byte (comma, full stop, other mark, none) by plain ASCII or not by length.
SPELLINGS = 24
#: State size, steps of truncated backpropagation, documents side by side in training and scoring.
STATE, STEPS, TRAIN_LANES, LANES = 16, 16, 128, 256
#: Tokens after which training begins a long document's state again, so that one document does not keep a lane busy alone.
TRAIN_PIECE = 2048
#: Logits up to this have exponentials that floats hold.
MOST_LOGIT = 60
#: Training documents of the warm start, and of them side by side; the averaged round reads all documents.
WARM_DOCS, WARM_LANES = 1500, 64
#: Documents that a training task has in memory.
TRAIN_DOCS = 4000


def learned() -> Column:
    """Whether a document is learned from; one without an id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD, F.lit(False))


def held_out() -> Column:
    """Whether the id's remainder is HELD; a null id is held out."""
    return ~learned()


def spelling(data: np.ndarray, found: W.Words) -> np.ndarray:
    """The spelling class of each word, from its bytes alone."""
    if not len(found.start):
        return np.zeros(0, np.int16)
    last = data[found.end - 1]
    mark = np.where(last == 44, 0, np.where(last == 46, 1, np.where((last < 48) | ((last > 57) & (last < 65)) | ((last > 90) & (last < 97)), 2, 3)))
    high = np.concatenate([[0], np.cumsum(data > 127, dtype=np.int32)])
    plain = high[found.end] == high[found.start]
    size = np.searchsorted([6, 10], found.end - found.start, "right")
    return (mark * 6 + plain * 3 + size).astype(np.int16)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, W.Words]]:
    data, offsets = W.utf8(batch.column("text"))
    for lo, hi in W.blocks(offsets):
        part = offsets[lo : hi + 1]
        own = data[part[0] : part[-1]]
        yield lo, hi, own, W.words(own, part - part[0])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, spelling, n) of a task's batches; one batch's distinct words are in memory."""
    for batch in batches:
        names, kinds = [], []
        for _, _, own, found in _texts(batch):
            names.append(found.hash)
            kinds.append(spelling(own, found))
        if names:
            unique, first, n = np.unique(np.concatenate(names), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(np.concatenate(kinds)[first].astype(np.int8)), pa.array(n)],
                                             ["word", "spelling", "n"])


class Vocabulary(NamedTuple):
    """The head's sorted hashes with counts and network ids (-1: none), and what the counts add up to."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    tokens: int
    distinct: int
    ends: int
    class_of_spelling: np.ndarray  # log10 of tokens + distinct words + 1 of each spelling class
    starts: np.ndarray  # place of the first hash with each run of upper bits

    def network(self) -> Vocabulary:
        """The same with the network's own words alone."""
        own = self.ids >= 0
        return self._replace(hashes=self.hashes[own], counts=self.counts[own], ids=self.ids[own], starts=_starts(self.hashes[own]))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the head, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        upper = (hashes >> np.uint64(65 - len(self.starts).bit_length())).astype(np.int32)
        at, end = self.starts[upper], self.starts[upper + 1]
        out = np.full(len(hashes), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        while len(open_):  # few hashes share their upper bits
            place = at[open_]
            same = self.hashes[place] == hashes[open_]
            out[open_[same]] = place[same]
            at[open_] += 1
            open_ = open_[~same & (place + 1 < end[open_])]
        return out


def _starts(hashes: np.ndarray) -> np.ndarray:
    """For each value of the upper bits, four values a hash, the place of the first of the sorted hashes with it."""
    bits = max(len(hashes), 1).bit_length() + 1
    return np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)


def vocabulary(counts: DataFrame, ends: int, head: int = HEAD_WORDS) -> tuple[Vocabulary, int]:
    """The head of at most ``head`` words and the least count in it; ``counts`` is stored."""
    total = counts.agg(F.sum("n"), F.count("*")).first()
    levels = counts.groupBy("n").agg(F.count("*").alias("words"))
    # a count's words go into the head together; few distinct counts are large, so only those that fit are collected
    ranked = levels.orderBy(F.desc("n")).limit(min(head, 1 << 16)).collect()
    least, room = 1 << 62, head
    for row in ranked:
        if row["words"] > room:
            break
        least, room = row["n"], room - row["words"]
    rows = counts.where(F.col("n") >= least).select("word", "n", "spelling").toPandas() if room < head else pd.DataFrame({"word": [], "n": [], "spelling": []})
    hashes, n, kinds = rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), rows["spelling"].to_numpy(np.int64)
    del rows
    order = np.argsort(hashes)
    hashes, n, kinds = hashes[order], n[order], kinds[order]
    ids = np.full(len(hashes), -1, np.int32)
    best = np.lexsort((hashes, -n))[: CLASSES * CLASS_WORDS]
    ids[best] = np.arange(len(best))
    by = {r["spelling"]: (r["n"], r["words"]) for r in counts.groupBy("spelling").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    sums = np.array([sum(by.get(k, (0, 0))) for k in range(SPELLINGS)], float)
    sums -= np.bincount(kinds[best], n[best] + 1, SPELLINGS)[:SPELLINGS]
    return Vocabulary(hashes, n, ids, int(total[0] or 0) + ends, int(total[1]) + (ends > 0), ends, np.log10(sums + 1), _starts(hashes)), least


class Tokens(NamedTuple):
    """Per token: class, word in the class (-1: none), input id, place in the head (-1: none), hash; the texts' bounds."""

    group: np.ndarray
    word: np.ndarray
    input: np.ndarray
    head: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


END_GROUP = CLASSES + SPELLINGS
GROUPS = END_GROUP + 1


def tokens(batch: pa.RecordBatch, known: Vocabulary) -> Tokens:
    """A batch's tokens, every text followed by its end."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    sizes = []
    for _, _, own, found in _texts(batch):
        at = known.lookup(found.hash)
        ids = np.where(at >= 0, known.ids[at] if len(known.ids) else -1, -1)
        kind = spelling(own, found)
        group = np.where(ids >= 0, ids // CLASS_WORDS, CLASSES + kind).astype(np.int16)
        word = np.where(ids >= 0, ids % CLASS_WORDS, -1).astype(np.int16)
        entry = np.where(ids >= 0, ids, CLASSES * CLASS_WORDS + kind).astype(np.int16)
        ends = found.bounds[1:]
        for k, (column, mark) in enumerate(((group, END_GROUP), (word, -1), (entry, 0), (at.astype(np.int32), -1), (found.hash, 0))):
            out[k].append(np.insert(column, ends, mark))
        sizes.append(np.diff(found.bounds) + 1)
    if not sizes:
        return Tokens(*(np.zeros(0, t) for t in (np.int16, np.int16, np.int16, np.int32, np.uint64)), np.zeros(1, np.int64))
    return Tokens(*(np.concatenate(c) for c in out), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))


class Lanes(NamedTuple):
    """Texts dealt to lanes: ``place[t, lane]`` is a token's number or -1, lanes by falling length; ``fresh``: a text begins."""

    place: np.ndarray
    fresh: np.ndarray
    active: np.ndarray


def lanes(bounds: np.ndarray, most: int) -> Lanes:
    """Deals whole texts to at most ``most`` lanes, the longest first, each to the shortest lane."""
    sizes = np.diff(bounds)
    n = min(most, len(sizes))
    heap, own = [(0, k) for k in range(n)], [[] for _ in range(n)]
    for i in np.argsort(-sizes, kind="stable"):
        load, k = heapq.heappop(heap)
        own[k].append(i)
        heapq.heappush(heap, (load + int(sizes[i]), k))
    loads = np.array([int(sizes[x].sum()) for x in own])
    order = np.argsort(-loads, kind="stable")
    place = np.full((int(loads.max()), n), -1, np.int32)
    fresh = np.zeros(place.shape, bool)
    for lane, k in enumerate(order):
        at = 0
        for i in own[k]:
            place[at : at + sizes[i], lane] = np.arange(bounds[i], bounds[i + 1])
            fresh[at, lane] = True
            at += sizes[i]
    return Lanes(place, fresh, (place >= 0).sum(1))


def pieces(bounds: np.ndarray, most: int) -> np.ndarray:
    """Bounds of the texts cut into pieces of at most ``most`` tokens."""
    n = -(-np.diff(bounds) // most)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.append(np.repeat(bounds[:-1], n) + within * most, bounds[-1])


SHAPES = {"enter": (CLASSES * CLASS_WORDS + SPELLINGS, 3 * STATE), "carry": (STATE, 3 * STATE), "bias": (3 * STATE,),
          "group": (STATE, GROUPS), "group_bias": (GROUPS,), "word": (CLASSES, CLASS_WORDS, STATE), "word_bias": (CLASSES, CLASS_WORDS)}


class Network:
    """The recurrent network; all weights lie in one vector, ``flat``."""

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, at = flat, 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in SHAPES.values())

    @classmethod
    def start(cls, known: Vocabulary) -> Network:
        """Small random weights; the output biases are the logarithms of the counts."""
        rng = np.random.default_rng(3)
        new = cls((0.1 * rng.standard_normal(cls.size())).astype(np.float32))
        new.bias[:] = 0
        new.bias[STATE : 2 * STATE] = 1
        n = np.zeros(CLASSES * CLASS_WORDS)
        got = known.ids >= 0
        n[known.ids[got]] = known.counts[got]
        new.word_bias[:] = np.where(n > 0, np.log(np.maximum(n, 1)), -30).reshape(CLASSES, CLASS_WORDS)
        new.word_bias -= np.maximum(new.word_bias.max(1, keepdims=True), -20)
        groups = np.concatenate([n.reshape(CLASSES, CLASS_WORDS).sum(1), 10.0**known.class_of_spelling, [known.ends]])
        new.group_bias[:] = np.log(np.maximum(groups, 0.5) / max(groups.sum(), 1))
        return new

    def steps(self, entry: np.ndarray, fresh: np.ndarray, active: np.ndarray, h: np.ndarray, keep: bool = False):
        """States before each token of a window, the state after it, and (``keep``) what backpropagation needs: reset, update and
        carried part, and the new state. Lanes are the last axis in memory, so that each part of a gate is one stretch."""
        s, h = STATE, np.ascontiguousarray(h.T)
        gates = np.ascontiguousarray(self.enter[entry].transpose(0, 2, 1))
        # a logistic function is a hyperbolic tangent of half its argument
        gates[:, : 2 * s] += self.bias[: 2 * s, None]
        gates[:, : 2 * s] *= 0.5
        carry, bias = self.carry.T.copy(), self.bias[2 * s :, None]
        carry[: 2 * s] *= 0.5
        begins = fresh.any(1)
        before = np.zeros((len(entry), s, entry.shape[1]), np.float32)
        memory = (np.zeros(gates.shape, np.float32), np.zeros(before.shape, np.float32)) if keep else ()
        for t in range(len(entry)):
            n = int(active[t])
            now = np.where(fresh[t, :n], np.float32(0), h[:, :n]) if begins[t] else h[:, :n]
            before[t, :, :n] = now
            inner = carry @ now
            both, carried = inner[: 2 * s], inner[2 * s :]
            both += gates[t, : 2 * s, :n]
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            carried += bias
            new = both[:s] * carried
            new += gates[t, 2 * s :, :n]
            np.tanh(new, out=new)
            after = now - new
            after *= both[s:]
            after += new
            h[:, :n] = after
            if keep:
                memory[0][t, :, :n] = inner
                memory[1][t, :, :n] = new
        return before.transpose(0, 2, 1), h.T, memory

    @staticmethod
    def _chances(logits: np.ndarray, pick: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials of the logits, their sums, and the picked places' log probability; logits are overwritten. States are
        within 1, so logits below ``bound`` by weight need no search for the largest."""
        if bound > MOST_LOGIT:
            logits -= logits.max(1, keepdims=True)
        rows = np.arange(0, logits.size, logits.shape[1]) + pick
        out = logits.ravel()[rows]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], np.float32)
        return rows, total, out - np.log(total)

    def output(self, states: np.ndarray, group: np.ndarray, word: np.ndarray, gradient: dict | None = None):
        """Natural-log probability of each token; with ``gradient``, that of the loss is added and the states' returned."""
        chance = states @ self.group
        chance += self.group_bias
        rows, total, out = self._chances(chance, group, float((np.abs(self.group).sum(0) + np.abs(self.group_bias)).max()))
        back = None
        if gradient is not None:
            chance *= (1 / total)[:, None]
            chance.ravel()[rows] -= 1
            gradient["group"] += states.T @ chance
            gradient["group_bias"] += chance.sum(0)
            back = chance @ self.group.T
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(CLASSES + 1))
        order = order[: cuts[-1]]
        held = [(c, slice(cuts[c], cuts[c + 1])) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]
        if not held:
            return out, back
        mine = states[order]
        chance = np.empty((len(order), CLASS_WORDS), mine.dtype)
        for c, own in held:
            part = np.matmul(mine[own], self.word[c].T, out=chance[own])
            part += self.word_bias[c]
        rows, total, named = self._chances(chance, word[order], float((np.abs(self.word).sum(2) + np.abs(self.word_bias)).max()))
        out[order] += named
        if gradient is not None:
            chance *= (1 / total)[:, None]
            chance.ravel()[rows] -= 1
            pull = np.empty_like(mine)
            for c, own in held:
                gradient["word"][c] += chance[own].T @ mine[own]
                pull[own] = chance[own] @ self.word[c]
            gradient["word_bias"][[c for c, _ in held]] += np.add.reduceat(chance, [own.start for _, own in held], axis=0)
            back[order] += pull
        return out, back

    def train(self, found: Tokens, rate: float, state: dict, most: int = TRAIN_LANES) -> None:
        """One pass of truncated backpropagation with Adam over a batch of texts."""
        if len(found.bounds) < 2:
            return
        dealt = lanes(pieces(found.bounds, TRAIN_PIECE), most)
        h = np.zeros((dealt.place.shape[1], STATE), np.float32)
        grad_flat, words = np.empty_like(self.flat), self.enter.size
        grad = Network(grad_flat)
        parts = {k: getattr(grad, k) for k in SHAPES}
        for at in range(0, len(dealt.place), STEPS):
            place, fresh, active = (x[at : at + STEPS] for x in dealt)
            n = int(active[0])
            place, fresh = place[:, :n], fresh[:, :n]
            real = place >= 0
            entry = np.where(real, found.input[place], 0)
            before, h, (gates, new) = self.steps(entry, fresh, active, h[:n], keep=True)
            grad_flat[words:] = 0
            own = place[real]
            _, back = self.output(before[real], found.group[own], found.word[own], parts)
            before, reach = before.transpose(0, 2, 1), np.zeros(new.shape, np.float32)
            reach.transpose(0, 2, 1)[real] = back
            # lanes without a token keep zeros throughout
            reset, update, carried = (gates[:, k * STATE : (k + 1) * STATE] for k in range(3))
            of_new = (1 - update) * (1 - new * new)
            of_update = (before - new) * update * (1 - update)
            of_reset = carried * reset * (1 - reset)
            begins, through = fresh.any(1), (~fresh).astype(np.float32)
            inside, pull = np.empty_like(gates), np.empty_like(new)
            d = np.zeros_like(new[0])
            for t in range(len(place) - 1, -1, -1):
                dn = np.multiply(d, of_new[t], out=pull[t])
                both = inside[t]
                np.multiply(dn, of_reset[t], out=both[:STATE])
                np.multiply(d, of_update[t], out=both[STATE : 2 * STATE])
                np.multiply(dn, reset[t], out=both[2 * STATE :])
                d *= update[t]
                d += self.carry @ both
                d += reach[t]
                if begins[t]:
                    d *= through[t]
            parts["carry"] += np.matmul(before, inside.transpose(0, 2, 1)).sum(0)
            parts["bias"] += inside.sum((0, 2))
            inside[:, 2 * STATE :] = pull
            rows, flat = entry[real], inside.transpose(0, 2, 1)[real]
            order = np.argsort(rows, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) != 0]))
            n = np.float32(1 / max(len(rows), 1))
            state["t"] += 1
            pace = rate / (1 - 0.9 ** state["t"]), (1 - 0.99 ** state["t"]) ** -0.5
            grad_flat[words:] *= n
            self._adam(slice(words, None), grad_flat[words:], state, pace)
            # words that a window lacks keep their weights and moments
            met = rows[order][first]
            self._adam_rows(met, np.add.reduceat(flat[order], first, axis=0) * n, state, pace)

    def _adam(self, at: slice, grad: np.ndarray, state: dict, pace: tuple[float, float]) -> None:
        """A step of the weights ``at``; ``grad`` is overwritten."""
        m, v = state["m"][at], state["v"][at]
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        grad *= grad
        grad *= 0.01
        v += grad
        self.flat[at] -= pace[0] * m / (np.sqrt(v) * pace[1] + 1e-6)

    def _adam_rows(self, met: np.ndarray, grad: np.ndarray, state: dict, pace: tuple[float, float]) -> None:
        """The same for some rows of the input weights."""
        m, v = (state[k][: self.enter.size].reshape(self.enter.shape) for k in ("m", "v"))
        new_m, new_v = 0.9 * m[met] + 0.1 * grad, 0.99 * v[met] + 0.01 * grad * grad
        m[met], v[met] = new_m, new_v
        self.enter[met] -= pace[0] * new_m / (np.sqrt(new_v) * pace[1] + 1e-6)

    def score(self, found: Tokens) -> np.ndarray:
        """Natural-log probability of each token's class and word in it, the state carried over whole texts."""
        out = np.zeros(len(found.group), np.float32)
        if len(found.bounds) < 2:
            return out
        dealt = lanes(found.bounds, LANES)
        h = np.zeros((dealt.place.shape[1], STATE), np.float32)
        for at in range(0, len(dealt.place), 4 * STEPS):
            place, fresh, active = (x[at : at + 4 * STEPS] for x in dealt)
            n = int(active[0])
            place, fresh = place[:, :n], fresh[:, :n]
            real = place >= 0
            before, h, _ = self.steps(np.where(real, found.input[place], 0), fresh, active, h[:n])
            own = place[real]
            out[own] = self.output(before[real], found.group[own], found.word[own])[0]
        return out


def _adam() -> dict:
    return {"t": 0, "m": np.zeros(Network.size(), np.float32), "v": np.zeros(Network.size(), np.float32)}


def _trained(known, weights, rate: float, passes: int):
    """Trains on a task's texts, more than one pass in the warm start; returns the weights in pieces with the number of tokens
    behind them."""
    most = TRAIN_LANES if passes == 1 else WARM_LANES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, state, seen, words = Network(weights.value.copy()), _adam(), 0, known.value.network()
        for batch in batches:
            for at in range(0, batch.num_rows, TRAIN_DOCS):
                found = tokens(batch.slice(at, TRAIN_DOCS), words)
                seen += len(found.group)
                for k in range(passes):
                    net.train(found, rate / (1 + k), state, most)
        if seen:
            pieces = np.array_split(net.flat, 32)
            yield pa.RecordBatch.from_arrays([pa.array(range(32), pa.int32()), pa.array([seen] * 32, pa.int64()),
                                              pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "tokens", "weights"])

    return run


def _averaged(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(w, np.float32).astype(float) * n for w, n in sorted(zip(rows["weights"], rows["tokens"], strict=True)))
    return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "weights": [(total / rows["tokens"].sum()).astype(np.float32).tobytes()]})


def fit(docs: DataFrame, shared) -> np.ndarray:
    """The network's weights: a warm start on a bounded sample, then one averaged round over all training documents, each task
    on its own. ``shared`` is the broadcast vocabulary."""
    spark = docs.sparkSession
    net = Network.start(shared.value)
    train = docs.where(learned())
    names = train.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM_DOCS)
    warm = stored(train.join(F.broadcast(stored(names, "warm-ids")), "doc_id").select("doc_id", "text"), "warm")
    for rows, rate, passes in ((warm.coalesce(1).sortWithinPartitions("doc_id", "text"), 0.02, 3), (train.select("doc_id", "text"), 0.004, 1)):
        weights = spark.sparkContext.broadcast(net.flat)
        done = rows.mapInArrow(_trained(shared, weights, rate, passes), "piece int, tokens long, weights binary")
        mean = done.groupBy("piece").applyInPandas(_averaged, "piece int, weights binary").orderBy("piece").collect()
        if mean:
            net = Network(np.concatenate([np.frombuffer(bytes(r["weights"]), np.float32) for r in mean]))
    return net.flat


def _scored(known, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = known.value, Network(weights.value.copy())
        logs = np.log10(words.counts + 1.0)
        for batch in batches:
            found = tokens(batch, words)
            if not batch.num_rows:
                continue
            n = np.diff(found.bounds)
            first = found.bounds[:-1]
            end = found.group == END_GROUP
            in_head, spelled = found.head >= 0, (found.group >= CLASSES) & ~end
            log = np.zeros(len(end))
            log[in_head] = logs[found.head[in_head]]
            log[end] = np.log10(words.ends + 1.0)
            score = net.score(found) / np.log(10.0)
            score[spelled] -= words.class_of_spelling[found.group[spelled] - CLASSES].astype(np.float32)
            add = lambda x: np.add.reduceat(x.astype(float), first)
            tail = ~in_head & ~end
            cuts = np.concatenate([[0], np.cumsum(add(tail).astype(np.int32))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(add(in_head | (end & (words.ends > 0))).astype(np.int64)),
                 pa.array(add(log)), pa.array(add(score) + add(np.where(spelled, log, 0))),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.hash[tail].view(np.int64)))],
                ["row", "doc_id", "n_tokens", "known", "log_counts", "score", "tail"])

    return run


def language_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs`` (doc_id, text).

    Words are ASCII-lower-cased; every text, null and empty ones too, has an end token. Both scores are log10 probabilities of
    the whole text. A word unseen in training counts 0 in its spelling class, which keeps one share for all such words. Rows
    that repeat id and text score alike; a null doc_id is held out; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = docs.where(learned())
    counts = train.mapInArrow(_counts, "word long, spelling byte, n long")
    counts = stored(counts.groupBy("word").agg(F.first("spelling").alias("spelling"), F.sum("n").alias("n")), "counts")
    known, least = vocabulary(counts, train.count())
    send = spark.sparkContext.broadcast
    shared = send(known)
    weights = fit(docs, shared)
    rows = docs.withColumn("row", F.xxhash64("doc_id", "text", F.col("doc_id").isNull()))
    scored = stored(rows.mapInArrow(_scored(shared, send(weights)), "row long, doc_id long, n_tokens long, known long, log_counts double, "
                                    "score double, tail array<long>"), "scored")
    # equal rows have one name: each text's rare words are looked up once
    once = scored.groupBy("row").agg(F.count("*").alias("copies"))
    rare = scored.select("row", F.explode("tail").alias("word")).join(counts.where(F.col("n") < least).select("word", "n"), "word")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_log"), F.count("*").alias("rare_known"))
    rare = rare.join(once, "row").select("row", (F.col("rare_log") / F.col("copies")).alias("rare_log"),
                                         F.expr("rare_known div copies").alias("rare_known"))
    out = scored.drop("tail").join(rare, "row", "left").fillna(0, ["rare_log", "rare_known"])
    base = F.col("log_counts") + F.col("rare_log") - F.col("n_tokens") * float(np.log10(known.tokens + known.distinct + 1))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"),
                      F.lit(known.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.col("rare_log")).alias("score"))
