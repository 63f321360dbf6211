"""The prefix trie of conversations: ternary search trees over shards of sorted conversations, merged where shards meet.

A turn is a code of 128 bits, a conversation the array of its turns' codes. Conversations are sorted by their codes, then by id,
and cut into ranges of about equal size, so that a prefix or a whole conversation that very many share is spread over shards. A
task numbers the codes of its shard and inserts its distinct conversations into a ternary search tree, the median of each run
first, which keeps the tree balanced. One traversal without recursion adds up members, children, leaves and savings. Only nodes
on the path of a shard's first or last conversation can go on in another shard: they are merged afterwards, in one pass along
the shards; all other nodes are complete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.shared import small_side, stored, tasks

#: Conversations of a shard, about.
SHARD_ROWS = 50_000
#: Ids of a piece of the list that a boundary node's members are digested from.
PIECE = 4096
OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: What a task returns: whole nodes, boundary nodes' shares and pieces of their lists. ``key`` and ``parent`` are digests of the
#: turns up to the node, where it or its parent is a boundary node.
PART = f"kind string, shard int, place long, key binary, parent binary, size long, list string, {OUT}"
NAMES = [c.strip().split(" ")[0] for c in PART.split(",")]
MERGED = "key binary, parent binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
EDGE = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")


def turn_code(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn; a null role or text is an empty one."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def head_length(conv_id: Column, folds: int = 9) -> Column:
    """The turns that a conversation takes over from its base."""
    return F.crc32(conv_id.cast("string").cast("binary")) % folds


def rebuilt(conversations: DataFrame, group: int = 5, folds: int = 9) -> DataFrame:
    """(conv_id, codes, sizes): each conversation after the first turns of its base, ``conv_id - conv_id % group`` (also below 0).

    Turns follow ``turn``, null first, equal ones their code. A base that is absent gives no turn. Rows without conv_id belong to
    no conversation. A conversation's turns travel as 24 bytes each, without their texts.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), turn_code(F.col("role"), F.col("text")).alias("code"),
                    F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("size"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    whole = stored(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")), "conversations")
    heads = whole.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, folds - 1).alias("head"))
    own = whole.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(group))).withColumn("h", head_length(F.col("conv_id"), folds).cast("int"))
    none = F.filter("turns", lambda t: F.lit(False))
    rest = F.when(F.size("turns") > F.col("h"), F.expr("slice(turns, h + 1, size(turns))")).otherwise(none)
    head = F.when(F.col("h") > 0, F.expr("slice(head, 1, h)"))
    turns = F.concat(F.coalesce(head, none), rest)
    return own.join(heads, "base", "left").select("conv_id", turns["code"].alias("codes"), turns["size"].alias("sizes"))


class Tree:
    """A ternary search tree: node v has code, next smaller and larger sibling, and the first of its children."""

    def __init__(self) -> None:
        self.code, self.low, self.high, self.down, self.up = [-1], [-1], [-1], [-1], [-1]

    def insert(self, codes: list[int]) -> int:
        """The node of a conversation; node 0 is the root."""
        at = 0
        for c in codes:
            parent, links, slot, v = at, self.down, at, self.down[at]
            while v >= 0 and self.code[v] != c:
                links = self.low if c < self.code[v] else self.high
                slot, v = v, links[v]
            if v < 0:
                v = len(self.code)
                links[slot] = v
                self.code.append(c)
                self.up.append(parent)
                for column in (self.low, self.high, self.down):
                    column.append(-1)
            at = v
        return at

    def order(self) -> list[int]:
        """All nodes, parents before children, siblings by code."""
        out, stack = [], [(0, False)]
        while stack:
            v, met = stack.pop()
            if not met and v:
                if self.high[v] >= 0:
                    stack.append((self.high[v], False))
                stack.append((v, True))
                if self.low[v] >= 0:
                    stack.append((self.low[v], False))
                continue
            out.append(v)
            if self.down[v] >= 0:
                stack.append((self.down[v], False))
        return out


def median_first(n: int) -> Iterator[int]:
    """0 to n - 1, the median of each run before its halves."""
    stack = [(0, n)]
    while stack:
        lo, hi = stack.pop()
        if lo < hi:
            middle = (lo + hi) // 2
            yield middle
            stack += [(middle + 1, hi), (lo, middle)]


def digest(before: bytes, code: bytes) -> bytes:
    return hashlib.blake2b(before + code, digest_size=16).digest()


def listed(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard, whose rows come sorted by codes and id."""
    shard = TaskContext.get().partitionId()
    paths: list[tuple] = []  # distinct conversations in order
    spans: list[tuple] = []
    ids: list[list[int]] = []
    for batch in batches:
        for i, codes, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "codes", "sizes")), strict=True):
            codes = tuple(codes)
            if not paths or paths[-1] != codes:
                paths.append(codes)
                spans.append(tuple(sizes))
                ids.append([])
            ids[-1].append(i)
    if not paths:
        return
    names = sorted({c for p in paths for c in p})
    number = {c: k for k, c in enumerate(names)}
    coded = [[number[c] for c in p] for p in paths]
    tree, ends, size = Tree(), {}, [0]
    for k in median_first(len(coded)):
        v = tree.insert(coded[k])
        size += [0] * (len(tree.code) - len(size))
        ends[v] = k
        for s in reversed(spans[k]):
            if size[v] or not v:
                break  # a conversation that went this way has named the rest
            size[v] = s
            v = tree.up[v]
    n = len(tree.code)
    depth, order = [0] * n, tree.order()
    for v in order[1:]:
        depth[v] = depth[tree.up[v]] + 1
    edge: dict[int, bytes] = {0: b""}
    for path in (coded[0], coded[-1]):
        v = 0
        for c in path:
            parent, v = v, tree.down[v]
            while tree.code[v] != c:
                v = tree.low[v] if c < tree.code[v] else tree.high[v]
            edge[v] = digest(edge[parent], names[c])
    first, members, children, leaves, saved = [2**63 - 1] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for v in reversed(order):
        if v in ends:
            own = ids[ends[v]]
            members[v] += len(own)
            first[v] = min(first[v], own[0])
        if v not in edge:  # complete: an edge node's own leaf and savings follow from the merge
            leaves[v] += not children[v]
            saved[v] += (members[v] - 1) * size[v]
        if v:
            u = tree.up[v]
            members[u] += members[v]
            first[u] = min(first[u], first[v])
            if v not in edge:  # what edge nodes have below them passes up in the merge
                children[u] += 1
                leaves[u] += leaves[v]
                saved[u] += saved[v]
    out: list[tuple] = []
    for place, v in enumerate(order):
        u = tree.up[v]
        own = ids[ends[v]] if v in ends else []
        base = (depth[v], first[u] if v else None, members[v], children[v], leaves[v], saved[v])
        if v in edge:
            out.append(("edge", shard, place, edge[v], edge[u] if v else None, size[v], None, first[v], *base, None))
            out += [("list", shard, at, edge[v], None, None, listed(own[at : at + PIECE]), None, depth[v], *[None] * 6) for at in range(0, len(own), PIECE)]
        else:
            out.append(("node", shard, place, None, edge.get(u), size[v], None, first[v], *base, hashlib.sha256(listed(own).encode()).hexdigest()))
        if len(out) >= 10_000 or v == order[-1]:
            yield _batch(out, PART)
            out = []


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [c.strip().split(" ") for c in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], [c for c, _ in columns])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary nodes whole, from their shares along the shards: all shares of a node's subtree follow its first one.

    At most two paths a shard come here; a node is passed on when a node beside or above it comes.
    """
    done: list[tuple] = []
    path: list[dict] = []  # from the root to the last node

    def close() -> None:
        v = path.pop()
        v["leaves"] += v["children"] == 0
        v["saved"] += (v["members"] - 1) * v["size"]
        if path:
            path[-1]["leaves"] += v["leaves"]
            path[-1]["saved"] += v["saved"]
        done.append((v["key"], v["parent"], v["first"], v["depth"], v["members"], v["children"], v["leaves"], v["saved"]))

    for batch in batches:
        for r in batch.to_pylist():
            d = r["depth"]
            if len(path) > d and path[d]["key"] == r["key"]:  # it goes on in this shard, as may what is open below it
                v = path[d]
                v["first"] = min(v["first"], r["conv_id"])
            else:
                while len(path) > d:
                    close()
                if path:
                    path[-1]["children"] += 1
                v = {"key": r["key"], "parent": r["parent"], "first": r["conv_id"], "depth": d, "size": r["size"]}
                v |= {"members": 0, "children": 0, "leaves": 0, "saved": 0}
                path.append(v)
            for name, column in (("members", "n_convs"), ("children", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens")):
                v[name] += r[column]
    while path:
        close()
    if done:
        yield _batch(done, MERGED)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's list, whose pieces come in order; only the running digest is held."""
    key, state, out = None, None, []
    for batch in batches:
        for k, part in zip(*(batch.column(c).to_pylist() for c in ("key", "list")), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
    if key is not None:
        out.append((key, state.hexdigest()))
        yield _batch(out, "key binary, ends_sha256 string")


def trie(conversations: DataFrame, group: int = 5, folds: int = 9, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations (see ``rebuilt``); columns as OUT names them.

    A node is a distinct sequence of turns; its members start with it, ``conv_id`` is the smallest. Null roles and texts are empty
    ones, rows without conv_id are left out, a turn given twice is two turns, other columns are not read. An empty table has no
    node. Long conversations and texts make no difference: a shard holds codes only.
    """
    whole = stored(rebuilt(conversations, group, folds), "rebuilt")
    n = whole.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("codes")), F.lit(0)).alias("turns")).first()
    shards = max(tasks(whole.sparkSession), -(-n["rows"] // shard_rows), -(-n["turns"] // (10 * shard_rows)))
    ranges = whole.repartitionByRange(shards, "codes", "conv_id").sortWithinPartitions("codes", "conv_id")
    parts = stored(ranges.mapInArrow(_shard, PART), "trie")
    # two paths a shard at most; the pass goes along the shards
    edges = parts.where("kind = 'edge'").select("shard", "place", "key", "parent", "size", *EDGE)
    edges = edges.repartition(1).sortWithinPartitions("shard", "place")
    edges = stored(edges.mapInArrow(_merged, MERGED), "edges")
    lists = parts.where("kind = 'list'").select("key", "shard", "place", "list").repartition(shards, "key")
    lists = small_side(stored(lists.sortWithinPartitions("key", "shard", "place").mapInArrow(_digested, "key binary, ends_sha256 string"), "lists"))
    above = small_side(edges.select(F.col("key").alias("_key"), F.col("conv_id").alias("_first")))
    bound = edges.join(lists, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    bound = bound.withColumn("parent_conv_id", F.lit(None).cast("long"))
    both = parts.where("kind = 'node'").select(*bound.columns).unionByName(bound)
    both = both.join(above, F.col("parent") == F.col("_key"), "left").withColumn("parent_conv_id", F.coalesce("_first", "parent_conv_id"))
    return both.select(*NAMES[7:])
