"""Exact k nearest neighbours between two tables, with missing coordinates allowed.

Distances are squared Euclidean over the coordinates both rows have, scaled by (all / shared). Ties go to
the smaller id. The work is a partitioned join in two rounds:

1. Donors are cut into boxes of similar size by median splits (per group and per pattern of present
   coordinates); rows at one and the same point keep only the k smallest ids, which no answer can exceed,
   so copies of a row cannot overload a box.
2. Each query point first searches the box near it that likely holds the nearest donors. Its k-th distance then bounds
   the answer, and only boxes whose bounding rectangle comes within that bound are searched in the second round.

No donor is skipped unless its box provably holds nothing nearer, so results are exact. Only box
rectangles reach the driver (at most about ``MAX_BOXES``, and one for each group and pattern); the distance kernel runs inside tasks
on one box and one slice of its queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable, slices, spread
from ..sources import tables

BOX_ROWS = 4_096  # donors aimed at per box
MAX_BOXES = 1 << 16  # boxes grow beyond BOX_ROWS rather than exceed it
BLOCK_BOXES = 64  # boxes that a query passes by with one comparison
SAMPLE_PER_BOX = 24
SLICE_QUERIES = 20_000  # query visits per task and box, at least
PART_DONORS = 65_536  # donors of a box that one task holds; a larger box is searched in parts
PART_ROWS = 512  # donors per part inside a box
KERNEL_CELLS = 1 << 18  # distances held at once (2 MB: stays in cache)


def _carried(column: str) -> str:
    return f"_c_{column}"


def _pattern(dims: Sequence[str]) -> Column:
    """Bit mask of the present coordinates."""
    if len(dims) > 62:
        raise ValueError("at most 62 coordinates")
    mask = F.lit(0).cast("bigint")
    for i, c in enumerate(dims):
        mask = mask + F.when(F.col(c).isNotNull(), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return mask


# ---- boxes ----------------------------------------------------------------------------------------------


def _median_tree(x: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Heap of (coordinate, threshold) splits; coordinate -1 ends a branch."""
    nodes = [(-1, 0.0)] * (2**depth - 1)
    pending = [(0, x)]
    while pending:
        at, part = pending.pop()
        if at >= len(nodes) or len(part) < 2:
            continue
        spread = part.std(axis=0)
        for j in np.argsort(-spread, kind="stable"):
            t = float(np.median(part[:, j]))
            left = part[:, j] <= t
            if left.all():  # most rows share the top value: cut just below it
                smaller = part[:, j][part[:, j] < t]
                if not len(smaller):
                    continue
                t = float(smaller.max())
                left = part[:, j] <= t
            nodes[at] = (int(j), t)
            pending += [(2 * at + 1, part[left]), (2 * at + 2, part[~left])]
            break
    return nodes


def _leaf(nodes: list[tuple[int, float]], x: np.ndarray) -> np.ndarray:
    """Leaf number per row; a branch that ends early keeps its number."""
    axis = np.array([n[0] for n in nodes])
    cut = np.array([n[1] for n in nodes])
    at = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    for _ in range(int(math.log2(len(nodes) + 1)) if nodes else 0):
        inner = at < len(nodes)
        j = np.where(inner, axis[np.where(inner, at, 0)], -1)
        move = j >= 0
        right = x[rows, np.where(move, j, 0)] > cut[np.where(inner, at, 0)]
        at = np.where(move, 2 * at + 1 + right, at)
    return at


def _boxes(donors: DataFrame, dims: Sequence[str], by: str, carry: Sequence[str], box_rows: int) -> DataFrame:
    """Donors with a ``box`` number."""
    keys = donors.groupBy(by, "pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # groups x patterns
    total = sum(k["n"] for k in keys)
    box_rows = max(box_rows, math.ceil(total / MAX_BOXES))  # larger boxes, not more of them; a box is cut again when it is searched
    aimed = math.ceil(total / box_rows) if total else 1
    share = min(1.0, aimed * SAMPLE_PER_BOX / max(total, 1))
    columns = list(dims)
    # the sample only places the splits; any sample gives the same neighbours
    sample = donors.select(by, "pattern", *columns).sample(fraction=share, seed=7).toPandas() if aimed > 1 else None
    trees: dict[tuple, list] = {}
    for k in keys:
        depth = max(0, math.ceil(math.log2(max(1.0, k["n"] / box_rows))))
        present = [i for i in range(len(columns)) if k["pattern"] >> i & 1]
        part = None
        if depth and sample is not None and present:
            mine = sample[(sample[by] == k[by]) & (sample["pattern"] == k["pattern"])]
            part = mine[columns].to_numpy(dtype=float)
            part[:, [i for i in range(len(columns)) if i not in present]] = 0.0
        trees[(k[by], k["pattern"])] = _median_tree(part, depth) if part is not None and len(part) else []
    first, base = 0, {}
    for key, nodes in trees.items():
        base[key] = first
        first += 2 * len(nodes) + 1
    shared = donors.sparkSession.sparkContext.broadcast((trees, base))  # a split per box

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, base = shared.value
        for f in frames:
            x = np.nan_to_num(f[columns].to_numpy(dtype=float))
            box = np.zeros(len(f), dtype=np.int64)
            for key, at in f.groupby([by, "pattern"], sort=False).indices.items():
                box[at] = base[key] + (_leaf(trees[key], x[at]) if trees[key] else 0)
            yield f.assign(box=box)

    numbers = ", ".join(f"{c} double" for c in [*columns, *map(_carried, carry)])
    return donors.select("id", by, "pattern", *columns, *map(_carried, carry)).mapInPandas(
        place, f"id bigint, {by} string, pattern bigint, {numbers}, box bigint")


def _rectangles(placed: DataFrame, dims: Sequence[str], by: str) -> pd.DataFrame:
    """The rectangle of every box, on the driver."""
    return placed.groupBy("box", by, "pattern").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"{c}_lo") for c in dims],
        *[F.max(c).alias(f"{c}_hi") for c in dims]).toPandas().sort_values("box").reset_index(drop=True)


# ---- kernel ---------------------------------------------------------------------------------------------


def _shared_weight(mask: np.ndarray, d: int) -> np.ndarray:
    """all / shared coordinates per mask; NaN when nothing is shared."""
    bits = np.array([bin(m).count("1") for m in mask], dtype=float)
    return np.divide(float(d), bits, out=np.full(len(bits), np.nan), where=bits > 0)


def _gaps(x: np.ndarray, mask: int, lo: np.ndarray, hi: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Smallest possible squared distance from each query to each box; NaN when nothing is shared.

    Sums run in coordinate order like the kernel's, so rounding can never lift a bound above a distance.
    """
    out = np.empty((len(x), len(boxes)))
    common = boxes & mask
    for m in np.unique(common):
        at = np.flatnonzero(common == m)
        total = np.zeros((len(x), len(at)))
        for j in range(x.shape[1]):
            if m >> j & 1:
                gap = np.maximum(np.maximum(lo[at, j][None, :] - x[:, j, None], x[:, j, None] - hi[at, j][None, :]), 0.0)
                total += gap * gap
        out[:, at] = _shared_weight(np.array([m]), x.shape[1])[0] * total
    return out


def _merge(best_d: np.ndarray, best_i: np.ndarray, rows: np.ndarray, total: np.ndarray, at: np.ndarray) -> None:
    """Fold distances ``total`` (rows x donors ``at``) into each row's k best; ties go to the smaller donor place."""
    k = best_d.shape[1]
    limit = best_d[rows, k - 1]
    if total.shape[1] > k:
        limit = np.minimum(limit, np.partition(total, k - 1, axis=1)[:, k - 1])
    r, c = np.nonzero(total <= limit[:, None])
    old_r, old_c = np.nonzero(best_i[rows] >= 0)
    r, d, i = (np.concatenate(x) for x in (
        (r, old_r), (total[r, c], best_d[rows[old_r], old_c]), (at[c], best_i[rows[old_r], old_c])))
    keep = np.isfinite(d)
    r, d, i = r[keep], d[keep], i[keep]
    order = np.lexsort((i, d, r))
    r, d, i = r[order], d[order], i[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    top = place < k
    best_d[rows[r[top]], place[top]] = d[top]
    best_i[rows[r[top]], place[top]] = i[top]


def _search(x: np.ndarray, masks: np.ndarray, y: np.ndarray, donor_mask: int, dids: np.ndarray, k: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, donor row, distance) of the k nearest inside one box.

    A large box is cut once more, so that a query is compared with the few parts near it only: first its
    nearest part, then every part whose rectangle lies within the k-th distance found so far.
    """
    order = np.argsort(dids, kind="stable")  # places follow ids, so comparing places breaks ties by id
    y = y[order]
    depth = max(0, math.ceil(math.log2(max(1.0, len(y) / PART_ROWS))))
    flat = np.nan_to_num(y)
    leaf = _leaf(_median_tree(flat, depth), flat) if depth else np.zeros(len(y), dtype=np.int64)
    parts = [np.flatnonzero(leaf == n) for n in np.unique(leaf)]
    lo = np.array([y[p].min(axis=0) for p in parts])
    hi = np.array([y[p].max(axis=0) for p in parts])
    best_d, best_i = np.full((len(x), k), np.inf), np.full((len(x), k), -1, dtype=np.int64)
    for mask in np.unique(masks & donor_mask):
        weight = _shared_weight(np.array([mask]), x.shape[1])[0]
        if np.isnan(weight):
            continue
        mine = np.flatnonzero((masks & donor_mask) == mask)
        axes = [j for j in range(x.shape[1]) if mask >> j & 1]
        gap = _gaps(x[mine], int(mask), lo, hi, np.full(len(parts), donor_mask))
        home = gap.argmin(axis=1)
        for near in (True, False):
            for n, part in enumerate(parts):
                wanted = home == n if near else (home != n) & (gap[:, n] <= best_d[mine, k - 1])
                todo = mine[wanted]
                step = max(1, KERNEL_CELLS // len(part))
                for s in range(0, len(todo), step):
                    rows = todo[s:s + step]
                    total = np.zeros((len(rows), len(part)))
                    for j in axes:
                        diff = x[rows, j, None] - y[None, part, j]
                        diff *= diff
                        total += diff
                    total *= weight
                    _merge(best_d, best_i, rows, total, part)
    at, place = np.nonzero(best_i >= 0)
    return at, order[best_i[at, place]], best_d[at, place]


def _visit(queries: DataFrame, donors: DataFrame, dims: Sequence[str], carry: Sequence[str], k: int) -> DataFrame:
    """Search ``queries(id, dims, pattern, box)`` against the donors of their box: a slice of the queries and a part of the donors a task."""
    columns = list(dims)
    # a slice holds about as many visits as its box has donors, so donors repeat no more than visits do
    sizes = donors.groupBy("box").agg(F.count(F.lit(1)).alias("_donors"))
    plan = durable(queries.groupBy("box").agg(F.count(F.lit(1)).alias("_visits")).join(sizes, "box").select(
        "box", F.ceil(F.col("_donors") / PART_DONORS).cast("int").alias("_parts"),
        F.ceil(F.col("_visits") / F.greatest(F.least("_donors", F.lit(PART_DONORS)), F.lit(SLICE_QUERIES))).cast("int").alias("_slices")))
    shape = plan.agg(F.sum(F.col("_slices") * F.col("_parts")), F.max("_parts")).first()
    tasks, split = shape[0] or 0, (shape[1] or 1) > 1
    left = queries.join(F.broadcast(plan), "box").withColumns({  # a row per box
        "slice": F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))})
    right = donors.join(F.broadcast(plan), "box").withColumns({
        "slice": F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)), "part": F.pmod(F.xxhash64("id", F.lit(1)), F.col("_parts")).cast("int")})
    extra = [_carried(c) for c in carry]

    def search(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame(columns=["id", "did", "d2", *extra])
        at, to, d2 = _search(q[columns].to_numpy(dtype=float), q["pattern"].to_numpy(),
                             d[columns].to_numpy(dtype=float), int(d["pattern"].iloc[0]), d["id"].to_numpy(), k)
        return pd.DataFrame({"id": q["id"].to_numpy()[at], "did": d["id"].to_numpy()[to], "d2": d2,
                             **{c: d[c].to_numpy()[to] for c in extra}})

    pairs = ", ".join(["id bigint, did bigint, d2 double", *[f"{c} double" for c in extra]])
    base = slices(queries.sparkSession)
    parts = max(base, min(8 * base, tasks))  # several boxes per part even out
    cell = ["box", "slice", "part"]
    left, right = (spread(t, *cell, parts=parts) for t in (left, right))
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(search, pairs)
    return _nearest_pairs(found, k) if split else found  # without parts a box returns k pairs a query at most


def _nearest_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k best pairs per query; each task keeps its k best before the shuffle."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("d2", "did"))
    return pairs.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")


def _best(pairs: DataFrame, carry: Sequence[str], k: int) -> DataFrame:
    """k best pairs per query as one sorted array."""
    return _nearest_pairs(pairs, k).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("d2", "did", *[F.col(_carried(c)).alias(c) for c in carry]))).alias("near"))


class _Rectangles:
    """Boxes and blocks of boxes. A block is up to BLOCK_BOXES boxes in tree order, so its rectangle is small too; a query is
    compared with the blocks of its group, and with the boxes of those blocks only that it can reach."""

    def __init__(self, rects: pd.DataFrame, group: str, dims: Sequence[str]) -> None:
        self.box, self.size = rects["box"].to_numpy(), rects["n"].to_numpy()
        self.pattern = rects["pattern"].to_numpy(dtype=np.int64)
        self.lo, self.hi = (rects[[f"{c}_{e}" for c in dims]].to_numpy(dtype=float) for e in ("lo", "hi"))
        self.blocks: dict[str, list[np.ndarray]] = {}
        for (g, _), at in sorted(rects.groupby([group, "pattern"], sort=True).indices.items()):
            self.blocks.setdefault(g, []).extend(np.array_split(at, math.ceil(len(at) / BLOCK_BOXES)))
        self.edges = {g: (np.array([self.lo[b].min(axis=0) for b in own]), np.array([self.hi[b].max(axis=0) for b in own]),
                          np.array([self.pattern[b[0]] for b in own])) for g, own in self.blocks.items()}
        self.reach: dict[tuple[int, int], np.ndarray] = {}
        self.tests = 0  # boxes and blocks compared with a query so far

    def _to(self, x: np.ndarray, mask: int, lo: np.ndarray, hi: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        self.tests += len(x) * len(lo)
        return _gaps(x, mask, lo, hi, pattern)

    def _likely(self, mask: int, reach: int) -> np.ndarray:
        """About how far a query inside a box is from the ``reach``-th of its donors, if these lie evenly in the rectangle.

        A box of a rare pattern holds few donors in a wide rectangle: being inside it says little.
        """
        if (mask, reach) not in self.reach:
            out = np.full(len(self.box), np.inf)
            for m in np.unique(self.pattern & mask):
                axes = [j for j in range(self.lo.shape[1]) if m >> j & 1]
                if axes:
                    at = np.flatnonzero((self.pattern & mask) == m)
                    width = (self.hi - self.lo)[at][:, axes]
                    wide = (width > 0).sum(axis=1)
                    log = np.log(np.where(width > 0, width, 1.0)).sum(axis=1) + np.log(reach / np.maximum(self.size[at], reach))
                    out[at] = len(self.lo[0]) / len(axes) * wide * np.exp(2.0 * log / np.maximum(wide, 1))
            self.reach[mask, reach] = out
        return self.reach[mask, reach]

    def home(self, group: str, mask: int, x: np.ndarray, reach: int) -> np.ndarray | None:
        """The box of each query where near donors are likeliest, one with ``reach`` donors if its block has one; the second round
        makes up for a poor choice."""
        own = self.blocks.get(group)
        if not own:
            return None
        likely = self._likely(mask, reach)
        least = np.array([likely[b].min() for b in own])
        out = np.empty(len(x), dtype=np.int64)
        step = max(1, KERNEL_CELLS * 4 // len(own))
        for s in range(0, len(x), step):
            gap = self._to(x[s:s + step], mask, *self.edges[group])
            block = np.where(np.isnan(gap), np.inf, gap + least).argmin(axis=1)
            for n in np.unique(block):
                rows, boxes = s + np.flatnonzero(block == n), own[n]
                near = self._to(x[rows], mask, self.lo[boxes], self.hi[boxes], self.pattern[boxes])
                near = np.where(np.isnan(near), np.inf, near + likely[boxes])
                near = np.where(self.size[boxes][None, :] >= reach, near, near + np.finfo(float).max / 4)
                out[rows] = self.box[boxes[near.argmin(axis=1)]]
        return out

    def within(self, group: str, mask: int, x: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, box of each) for every box within its query's limit."""
        own = self.blocks.get(group, [])
        step = max(1, KERNEL_CELLS * 4 // max(len(own), 1))
        for s in range(0, len(x) if own else 0, step):
            gap = self._to(x[s:s + step], mask, *self.edges[group])
            reached = gap <= limit[s:s + step, None]
            for n in np.flatnonzero(reached.any(axis=0)):
                rows, boxes = s + np.flatnonzero(reached[:, n]), own[n]
                near = self._to(x[rows], mask, self.lo[boxes], self.hi[boxes], self.pattern[boxes])
                r, c = np.nonzero(near <= limit[rows, None])
                yield rows[r], self.box[boxes[c]]


# ---- public ---------------------------------------------------------------------------------------------


def _tidy(df: DataFrame, dims: Sequence[str], group: str, carry: Sequence[str] = (), everywhere: bool = False) -> DataFrame:
    mine = F.lit("") if everywhere or group == "_all" else F.col(group).cast("string")
    return df.select(F.col("id").cast("bigint").alias("id"), mine.alias(group), *[F.col(c).cast("double").alias(c) for c in dims],
                     *[F.col(c).cast("double").alias(_carried(c)) for c in carry]).withColumn("pattern", _pattern(dims))


@dataclass(frozen=True)
class Index:
    """Donors in boxes, built once and searched any number of times, within each query's group or everywhere.

    ``reach`` is the largest number of neighbours that a search may ask for (one more with ``exclude_self``): of equal points in a
    group no more are kept. ``save`` writes the boxes; ``load`` reads them again and only sums up their rectangles.
    """

    placed: DataFrame
    rects: pd.DataFrame
    dims: tuple[str, ...]
    carry: tuple[str, ...]
    group: str
    reach: int

    @classmethod
    def fit(cls, donors: DataFrame, dims: Sequence[str], reach: int, by: str | None = None, carry: Sequence[str] = (),
            box_rows: int = BOX_ROWS) -> Index:
        """``donors`` hold ``id``, ``dims`` (doubles, NULL allowed), ``carry`` (numbers) and the group ``by`` (never NULL)."""
        group = by or "_all"
        nth = F.row_number().over(Window.partitionBy(group, *dims).orderBy("id"))
        # the rank filter is applied per task before the shuffle too, so copies of a point never travel together
        pool = _tidy(donors, dims, group, carry).withColumn("_nth", nth).where(F.col("_nth") <= reach).drop("_nth")
        # filtered once stored: as part of the plan above, a condition over all coordinates makes planning explode
        pool = durable(spread(pool, "id")).where(F.col("pattern") != 0)
        placed = durable(_boxes(pool, dims, group, carry, box_rows))
        return cls(placed, _rectangles(placed, dims, group), tuple(dims), tuple(carry), group, reach)

    def save(self, root: str, name: str) -> None:
        tables.write_stage(self.placed, root, name)
        facts = {"dims": self.dims, "carry": self.carry, "group": self.group, "reach": self.reach}
        tables.save_state(self.placed.sparkSession, facts, root, name)

    @classmethod
    def load(cls, spark: SparkSession, root: str, name: str) -> Index:
        facts, placed = tables.load_state(spark, root, name), tables.read_stage(spark, root, name)
        rects = _rectangles(placed, facts["dims"], facts["group"])
        return cls(placed, rects, tuple(facts["dims"]), tuple(facts["carry"]), facts["group"], facts["reach"])

    def nearest(self, queries: DataFrame, k: int, exclude_self: bool = False, carry: Sequence[str] | None = None,
                everywhere: bool = False) -> DataFrame:
        """``(id, near)`` as of ``nearest``; ``everywhere`` ignores the groups, ``carry`` narrows what is brought along."""
        dims, group, placed = list(self.dims), self.group, self.placed
        carry = list(self.carry if carry is None else carry)
        reach = k + 1 if exclude_self else k
        if reach > self.reach:
            raise ValueError(f"the index keeps {self.reach} equal points, {reach} are needed")
        rects = self.rects.assign(**{group: ""}) if everywhere else self.rects
        rows = _tidy(queries, dims, group, everywhere=everywhere)
        point = [group, *dims]
        points = rows.groupBy(*point, "pattern").agg(F.min("id").alias("id"))  # equal points share one search
        shared = queries.sparkSession.sparkContext.broadcast(_Rectangles(rects, group, dims))  # a rectangle per box

        layout = f"id bigint, {group} string, {', '.join(f'{c} double' for c in dims)}, pattern bigint, box bigint"

        def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for (g, mask), at in f.groupby([group, "pattern"], sort=False).indices.items():
                    box = shared.value.home(g, int(mask), f[dims].to_numpy(dtype=float)[at], reach)
                    if box is not None:
                        yield f.iloc[at].assign(box=box)[["id", group, *dims, "pattern", "box"]]

        start = durable(spread(points, "id").select("id", group, *dims, "pattern").mapInPandas(home, layout))
        first = durable(_visit(start, placed, dims, carry, reach))
        limit = first.groupBy("id").agg(F.max("d2").alias("_worst"), F.count(F.lit(1)).alias("_got"))
        bounded = start.join(limit, "id", "left").withColumn(
            "_worst", F.when(F.col("_got") >= reach, F.col("_worst"))).drop("_got")

        def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                f = f.reset_index(drop=True)
                worst = f["_worst"].fillna(np.inf).to_numpy()
                done = f["box"].to_numpy()
                for (g, mask), at in f.groupby([group, "pattern"], sort=False).indices.items():
                    for r, box in shared.value.within(g, int(mask), f[dims].to_numpy(dtype=float)[at], worst[at]):
                        r, box = at[r][box != done[at[r]]], box[box != done[at[r]]]
                        yield f.iloc[r].assign(box=box)[["id", group, *dims, "pattern", "box"]]

        more = durable(spread(bounded, "id").select("id", group, *dims, "pattern", "box", "_worst").mapInPandas(others, layout))
        second = _visit(more, placed, dims, carry, reach)
        answers = _best(first.unionByName(second), carry, reach)
        keyed = start.select("id", *point).join(answers, "id")
        same = F.lit(True)
        for c in point:
            same = same & rows[c].eqNullSafe(keyed[c])
        out = rows.join(keyed.drop("id"), same).select(rows["id"], "near")  # AQE splits hot points
        if exclude_self:
            out = out.withColumn("near", F.slice(F.filter("near", lambda p: p["did"] != F.col("id")), 1, k))
        return out


def nearest(queries: DataFrame, donors: DataFrame, dims: Sequence[str], k: int, by: str | None = None,
            exclude_self: bool = False, carry: Sequence[str] = (), box_rows: int = BOX_ROWS) -> DataFrame:
    """``(id, near)`` for every query row: ``near`` is an array of (d2, did, carry...), nearest first.

    Both tables hold ``id`` and ``dims`` (doubles, NULL allowed). ``by`` restricts neighbours to rows with
    the same value of that column; ``exclude_self`` leaves a row out of its own answer; ``carry`` names
    numeric donor columns to bring along, which saves joining them back by donor id.
    """
    return Index.fit(donors, dims, k + 1 if exclude_self else k, by, carry, box_rows).nearest(queries, k, exclude_self)
