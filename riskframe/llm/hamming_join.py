"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's signature holds ``CHUNKS * WIDTH`` symbols of 16 bits, each the low bits of one minimum over its shingles.
Two signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` symbols have, by pigeonhole, a chunk that differs in at
most ``ERRORS`` symbols; so every document is filed under each chunk with each choice of ``ERRORS`` symbols left out, and all
pairs within that distance meet under a common key. At a similarity of 0.75 a pair misses all keys with probability 1.5e-6.
Pairs that meet are confirmed on their full shingle sets, in two rounds: with a key's first document, and then all that meet and
are not in one component yet. The second round returns no pairs to be tested: a first pass leaves the documents that have a
likely partner in another component, each pair under the first key that its two documents share, and a second pass gets their
sets and returns confirmed links, no more than join the components it sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import words as W
from riskframe.llm.graph import components
from riskframe.llm.shared import small_side, stored, tasks

SHINGLE = 5
CHUNKS, WIDTH, ERRORS = 10, 4, 1
SYMBOLS = CHUNKS * WIDTH
#: Pairs that meet under a key and differ in more symbols are not confirmed. A pair of similarity 0.75 differs in 10 of 40
#: symbols on average; it differs in more than 32 with probability 3.6e-14, against 1.5e-6 for sharing no key at all.
FARTHEST = 32
#: Rows of a key that one task compares with each other; larger keys are cut into blocks that meet pair by pair.
BLOCK = 2_000
_factors = np.random.default_rng(7).integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray) -> np.ndarray:
    """16-bit MinHash symbols of a set of shingle hashes (at least one)."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at : at + 4096, None] * _factors).min(axis=0), out=least)
    return (W.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _text_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = W.utf8(batch.column("text"))
    for lo, hi in W.blocks(offsets):
        part = offsets[lo : hi + 1]
        found = W.words(data[part[0] : part[-1]], part - part[0])
        for i in range(hi - lo):
            yield W.shingles(found.hash[found.bounds[i] : found.bounds[i + 1]], SHINGLE)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, signs = [], [], []
        for found in _text_sets(batch):
            sizes.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            signs.append(signature(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())],
            ["doc_id", "n_shingles", "digest", "sign"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x.tobytes() for x in _text_sets(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "found"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id) for each chunk and each choice of symbols left out; the key's low 6 bits number the two."""
    kept = list(combinations(range(WIDTH), WIDTH - ERRORS))
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        out = []
        for k, choice in enumerate(kept):
            packed = signs[:, :, choice[0]]
            for c in choice[1:]:
                packed = (packed << np.uint64(16)) | signs[:, :, c]
            slot = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(len(kept)) + np.uint64(k)
            out.append(W.mix(packed + W.mix(slot)) & ~np.uint64(63) | slot)
        keys = np.stack(out, axis=2).reshape(len(ids), -1)
        for at in range(0, len(ids), 2000):
            part = keys[at : at + 2000]
            yield pa.RecordBatch.from_arrays([pa.array(part.ravel().view(np.int64)), pa.array(np.repeat(ids[at : at + 2000], keys.shape[1]))],
                                             ["key", "doc_id"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in at most FARTHEST symbols."""
    for batch in batches:
        a, b = _signs(batch.column("sign_a")), _signs(batch.column("sign_b"))
        keep = (a != b).sum(axis=1) <= FARTHEST
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("found_a"), batch.column("found_b"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([p, q]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return run


def _signs(column: pa.Array) -> np.ndarray:
    """Signatures of a column without nulls, one row of symbols each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _first_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first key, by number, under which signatures meet; for pairs that share a key."""
    same = (a == b).reshape(len(a), CHUNKS, WIDTH)
    enough = same.sum(axis=2) >= WIDTH - ERRORS
    chunk = enough.argmax(axis=1)
    own = same[np.arange(len(a)), chunk]
    # choices leave out the last symbol first
    return chunk * WIDTH + np.where(own.all(axis=1), 0, WIDTH - 1 - own.argmin(axis=1))


def _likely(slot: int, comp: np.ndarray, left: np.ndarray, size: np.ndarray, signs: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a meeting in different components, within FARTHEST symbols, of sizes that allow a link, first met here."""
    right = np.flatnonzero(left != 0)
    for at in range(0, len(comp), 256):
        rows = at + np.flatnonzero(left[at : at + 256] != 1)
        near = np.zeros((len(rows), len(right)), bool)
        for k in range(0, len(right), 1024):
            near[:, k : k + 1024] = (signs[rows, None] != signs[None, right[k : k + 1024]]).sum(axis=2) <= FARTHEST
        small, large = np.minimum(size[rows, None], size[None, right]), np.maximum(size[rows, None], size[None, right])
        near &= (comp[rows, None] != comp[None, right]) & (100 * small >= percent * large)
        i, j = np.nonzero(near)
        i, j = rows[i], right[j]
        here = _first_slot(signs[i], signs[j]) == slot
        if here.any():
            yield i[here], j[here]


def _meetings(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(key, x, y), then arrays of one meeting's left, doc_id, component, size, signs and ``more``; rows come sorted by meeting."""
    held: list[tuple] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, x, y, *numbers = (batch.column(c).to_numpy() for c in ("key", "x", "y", "left", "doc_id", "component", "size"))
        columns = [*numbers, _signs(batch.column("sign")), *(np.array(batch.column(c).to_pylist(), object) for c in more)]
        cuts = 1 + np.flatnonzero((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0))
        for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if held and name != (key[a], x[a], y[a]):
                yield name, *(np.concatenate(c) for c in zip(*held, strict=True))
                held = []
            name = (key[a], x[a], y[a])
            held.append(tuple(c[a:b] for c in columns))
    if held:
        yield name, *(np.concatenate(c) for c in zip(*held, strict=True))


def _with_partner(percent: int):
    """The rows of each meeting that have a likely partner in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (key, x, y), left, ids, comp, size, signs in _meetings(batches):
            found = [k for pair in _likely(int(key) & 63, comp, left, size, signs, percent) for k in pair]
            for k in np.unique(np.concatenate(found)) if found else ():
                out.append((key, x, y, left[k], ids[k], comp[k], size[k], signs[k].tobytes()))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ROW_TYPES, strict=True)], _ROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ROW_TYPES, strict=True)], _ROW)

    return run


_ROW = ["key", "x", "y", "left", "doc_id", "component", "size", "sign"]
_ROW_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _joined(percent: int):
    """Confirmed links of each meeting, none between components that earlier links of the meeting have joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, _), left, ids, comp, size, signs, found in _meetings(batches, "found"):
            sets: dict[int, frozenset] = {}
            above: dict[int, int] = {}

            def top(c: int) -> int:
                while above.get(c, c) != c:
                    above[c] = above.get(above[c], above[c])
                    c = above[c]
                return c

            links = []
            for left_rows, right_rows in _likely(int(key) & 63, comp, left, size, signs, percent):
                for i, j in zip(left_rows.tolist(), right_rows.tolist(), strict=True):
                    p, q = top(int(comp[i])), top(int(comp[j]))
                    if p == q:
                        continue
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = frozenset(np.frombuffer(found[k], np.uint64).tolist())
                    shared = len(sets[i] & sets[j])
                    if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                        above[max(p, q)] = min(p, q)
                        links.append((ids[i], ids[j]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, found) of the documents whose doc_id is in ``ids``."""
    needed = small_side(stored(ids.select("doc_id").distinct(), "needed"))
    return stored(docs.join(needed, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, found binary"), "sets")


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    sets = _sets_of(docs, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))))
    one = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("found").alias("found_b")), "b")
    two = one.join(sets.select(F.col("doc_id").alias("a"), F.col("found").alias("found_a")), "a")
    return stored(two.select("a", "b", "found_a", "found_b").mapInArrow(_similar(percent), "a long, b long").distinct(), "confirmed")


def _blocked(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of each key dealt to its blocks' meetings: (key, x, y) with x <= y, where ``left`` is 0, 1, or 2 when x = y."""
    cut = rows.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
        F.least("part", o).alias("x"), F.greatest("part", o).alias("y"),
        F.when(F.col("part") == o, 2).when(F.col("part") < o, 0).otherwise(1).alias("left"))))
    return cut.withColumn("meet", meet).select("key", "meet.x", "meet.y", "meet.left", "doc_id", "component", "size", "sign")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs`` (doc_id, text; other columns are not read).

    Documents are linked when ``100 * shared >= percent * union`` over their distinct 5-word shingles of ASCII-lower-cased
    words; fewer words are one shingle. Texts that are null or without words have no shingle and no link. A null doc_id gets a
    null component and is kept. Rows that repeat a doc_id are judged row by row. Equal sets are collapsed first, so copies
    cost one row each; an empty table gives an empty table. ``percent`` below 75 lowers the recall stated above.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = stored(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, sign binary"), "signatures")
    real = signs.where("n_shingles > 0 and doc_id is not null")
    first = real.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("sign").alias("sign"), F.first("n_shingles").alias("size"))
    first = stored(first, "sets-once")
    nodes = first.select(F.col("first").alias("doc_id"), "sign", "size").dropDuplicates(["doc_id", "sign"])
    keys = stored(nodes.mapInArrow(_keys, "key long, doc_id long"), "keys")
    heads = stored(keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z"), "heads")
    meetings = stored(keys.join(heads.select("key", "a"), "key"), "meetings")

    signed = nodes.select("doc_id", "sign")
    star = stored(meetings.where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct(), "pairs")
    near = (star.join(signed.withColumnsRenamed({"doc_id": "b", "sign": "sign_b"}), "b")
            .join(signed.withColumnsRenamed({"doc_id": "a", "sign": "sign_a"}), "a").select("a", "b", "sign_a", "sign_b"))
    links = _confirmed(docs, stored(near.mapInArrow(_near, "a long, b long").distinct(), "candidates"), percent)

    found = components(links)
    at = meetings.join(found, meetings["doc_id"] == found["node"], "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    open_keys = at.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("n"))
    open_keys = open_keys.where("c < d").select("key", "n")
    together = lambda rows: rows.repartition(tasks(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y")
    rows = together(_blocked(at.join(nodes, "doc_id"), open_keys))
    rows = stored(rows.mapInArrow(_with_partner(percent), "key long, x int, y int, left int, doc_id long, component long, size long, sign binary"), "likely")
    rows = together(rows.join(_sets_of(docs, rows), "doc_id").select(*_ROW, "found"))
    more = stored(rows.mapInArrow(_joined(percent), "a long, b long").distinct(), "links")
    found = components(links.unionByName(more))
    classes = first.join(found, first["first"] == found["node"], "left").select(
        "digest", F.coalesce("component", "first").alias("component_id"))
    out = signs.join(classes, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
