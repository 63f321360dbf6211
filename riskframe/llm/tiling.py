"""Benchmark decontamination by greedy string tiling.

A benchmark is cut into blocks of bounded size; each block is broadcast and met by all documents in one scan. Documents and
items that share a seed (five words in a row, found by a rolling hash) are tiled: the longest match of unmarked words is marked
in both, again and again, so that passages count however they are reordered. An item whose words are covered to ``percent`` or
more leaks into the document.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import words as W
from riskframe.llm.shared import new_folder, stored

LEAST = 5
#: Bytes of benchmark text that one scan of the documents broadcasts; blocks are scanned one after the other.
BLOCK_BYTES = 8_000_000
#: ASCII punctuation separates words here, so that a passage is found whatever marks follow its words.
APART = W.SPACE.copy()
APART[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Seeds:
    """The seeds of a block of items: sorted window hashes with the item and the place of each, by window width."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        data, offsets = W.utf8(pa.array([text for _, text in items], pa.string()))
        found = W.words(data, offsets, space=APART)
        self.words = [found.hash[a:b] for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
        self.ids = [i for i, _ in items]
        places = defaultdict(list)
        for n, own in enumerate(self.words):
            if len(own):
                width = min(LEAST, len(own))
                places[width] += [(h, n, k) for k, h in enumerate(W.window_hashes(own, width).tolist())]
        self.widths = {}
        for width, rows in places.items():
            rows.sort()
            self.widths[width] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(text, item) -> (word of the text, word of the item) of each shared seed."""
        out = defaultdict(list)
        for width, (keys, item, place) in self.widths.items():
            windows = W.window_hashes(hashes, width)
            likely = np.zeros(1 << 16, bool)
            likely[(keys >> np.uint64(48)).astype(np.int64)] = True
            at = np.flatnonzero(likely[(windows >> np.uint64(48)).astype(np.int64)])
            low, high = np.searchsorted(keys, windows[at], "left"), np.searchsorted(keys, windows[at], "right")
            text = np.searchsorted(bounds, at, "right") - 1
            whole = (high > low) & (at + width <= bounds[text + 1])
            for p, t, a, b in zip(at[whole], text[whole], low[whole], high[whole], strict=True):
                for k in range(a, b):
                    out[int(t), int(item[k])].append((int(p - bounds[t]), int(place[k])))
        return out


def tiles(seeds: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from all windows of ``width`` equal words: (place in the text, place in the item, words).

    Windows in a row on one diagonal are one maximal match. The longest match goes first, ties by the item's and then the
    text's place; a match that meets marked words is cut to its unmarked parts, which wait for their turn.
    """
    runs, queue = defaultdict(list), []
    for p, q in sorted(set(seeds)):
        own = runs[p - q]
        if own and own[-1][0] + own[-1][2] - width + 1 == p:
            own[-1][2] += 1
        else:
            own.append([p, q, width])
    for own in runs.values():
        queue += [(-n, q, p) for p, q, n in own]
    heapq.heapify(queue)
    text, item, out = set(), set(), []
    while queue:
        n, q, p = heapq.heappop(queue)
        free = [k for k in range(-n) if p + k not in text and q + k not in item]
        if len(free) == -n:
            out.append((p, q, -n))
            text.update(range(p, p - n))
            item.update(range(q, q - n))
            continue
        first = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - first >= width:
                    heapq.heappush(queue, (first - k, q + free[first], p + free[first]))
                first = k
    return out


def _leaks(shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            out = []
            for lo, hi in W.blocks(offsets):
                part = offsets[lo : hi + 1]
                found = W.words(data[part[0] : part[-1]], part - part[0], space=APART)
                for (t, n), pairs in seeds.hits(found.hash, found.bounds).items():
                    size = len(seeds.words[n])
                    cover = tiles(pairs, min(LEAST, size))
                    marked = sum(c for _, _, c in cover)
                    if 100 * marked >= percent * size:
                        out.append((ids[lo + t], seeds.ids[n], size, marked, len(cover)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)],
                                             ["doc_id", "item_id", "n_words", "n_covered", "n_tiles"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_tiles), one row per document and benchmark item whose words it covers.

    Words are ASCII-lower-cased and end at white space or ASCII punctuation; a match has five words or more, or a shorter
    item's whole length. Null or empty texts, and items without words, leak nothing; so does an empty table. A null doc_id is
    returned as it is; repeated documents and items give a row each. Whole texts are read, whatever their length.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    layout = "doc_id long, item_id long, n_words long, n_covered long, n_tiles long"
    folder = new_folder(spark, "leaks")
    items, blocks = _blocks(items)
    for block in range(blocks):
        rows = items.where(F.col("block") == block).select("item_id", "text").collect()  # BLOCK_BYTES, or one longer item
        shared = spark.sparkContext.broadcast(Seeds([(r[0], r[1]) for r in rows]))
        texts.mapInArrow(_leaks(shared, percent), layout).write.parquet(f"{folder}/block={block}")
        shared.destroy()
    if not blocks:
        return spark.createDataFrame([], layout)
    return spark.read.schema(layout).parquet(*[f"{folder}/block={block}" for block in range(blocks)])


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """Items with the number of their block, and how many blocks there are.

    Items are dealt by hash into cells; cells in a row fill a block up to ``BLOCK_BYTES``, and an item too long to share one has a
    block to itself. The sums are over cells, and over the few items that are long.
    """
    sized = items.withColumn("bytes", F.octet_length("text").cast("long"))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    cells = max(1, 16 * total // BLOCK_BYTES)
    long = F.col("bytes") * 16 > BLOCK_BYTES
    cell = F.when(long, F.xxhash64("item_id", "text").cast("string")).otherwise(
        F.concat(F.lit("c"), F.pmod(F.xxhash64("item_id", "text"), F.lit(cells)).cast("string")))
    sized = stored(sized.withColumn("cell", cell), "items")
    number, filled, blocks = 0, 0, {}
    for row in sized.groupBy("cell").agg(F.sum("bytes").alias("bytes")).orderBy("cell").collect():  # 16 cells a block
        if filled and filled + row["bytes"] > BLOCK_BYTES:
            number, filled = number + 1, 0
        blocks[row["cell"]], filled = number, filled + row["bytes"]
    if not blocks:
        return sized.withColumn("block", F.lit(0)), 0
    table = items.sparkSession.createDataFrame(list(blocks.items()), "cell string, block int")
    return stored(sized.join(F.broadcast(table), "cell").select("item_id", "text", "block"), "blocks"), number + 1


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_items, best_item, coverage): the documents that cover an item, with the item covered most."""
    found = leaks(docs, benchmark, percent).withColumn("coverage", F.col("n_covered") / F.col("n_words"))
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("item")))
    return found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), best.alias("best")).select(
        "doc_id", "n_items", (-F.col("best.item")).alias("best_item"), F.col("best.coverage").alias("coverage"))
