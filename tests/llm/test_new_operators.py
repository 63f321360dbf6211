"""Token counts, whitening and the prefix trie: against the library, a dense eigensolver and a brute-force trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from riskframe.llm import prefix_trie, rank_merge, spectrum
from riskframe.llm.queries import QUERIES, tokenizer_file

BYTES = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(BYTES))


@pytest.fixture(scope="module")
def merger():
    return rank_merge.Merger(tokenizer_file(BYTES))


def counted(merger, texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return merger.texts(np.frombuffer(b"".join(data), np.uint8), offsets).tolist()


def test_counts_of_the_tables(spark, sf_dir, library):
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op11_rank_merge"](spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        n = len(library.encode(want[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(want[r.doc_id].encode()), n, n > 1024)


def test_counts_of_awkward_rows(spark, awkward, nothing, library):
    rows = awkward.collect()
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rank_merge.token_counts(awkward, tokenizer_file(BYTES)).collect()))
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    assert got == want
    assert rank_merge.token_counts(nothing, tokenizer_file(BYTES)).count() == 0


def test_counts_of_all_cuts(merger, library):
    """Blanks, apostrophes, special strings whole and cut off, characters of every class, long runs; texts end anywhere."""
    parts = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "'ll", "l", "s", "1", "23", "!", "?!", "<|endoftext|>", "<|endof", "é", "中", " ", "　",
             "\t", "😀", " the", "x" * 1501, "abc" * 700, "́", "²", "Ⅷ", "\x85", "​", "\r\n", "\x00"]
    r = random.Random(1)
    for _ in range(60):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(40)]
        assert counted(merger, texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_and_unordered_merging_agree(merger, library):
    """One round per pair (as for files whose merges are not in order), all pairs at once, and the linked list."""
    r = random.Random(4)
    texts = ["".join(r.choice("aabcdeinrst") for _ in range(n)) for n in (1, 2, 3, 50, 999, 1001, 4000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    symbols = [merger.base[np.frombuffer(t.encode(), np.uint8)] for t in texts]
    sizes = np.array([len(s) for s in symbols])
    assert merger.merge(np.concatenate(symbols), sizes).tolist() == want
    assert [merger.merge_long(s) for s in symbols[1:]] == want[1:]
    try:
        merger.ordered = False
        assert merger.merge(np.concatenate(symbols), sizes).tolist() == want
    finally:
        merger.ordered = True


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        rank_merge.Merger(tokenizer_file("word_bpe_49k.json"))


def whitened_by_brute_force(rows):
    """Dense, by numpy: x per row, fit statistics, eigenpairs."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    y = (n * fit - total) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return kept, x, n, total, values[::-1], vectors[:, ::-1]


def check_whitening(got, rows, most=16):
    kept, x, n, total, values, vectors = whitened_by_brute_force(rows)
    rank = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == rank * len(kept)
    by = defaultdict(lambda: defaultdict(list))
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-6 * r.explained
        by[r.vec_id][r.component].append((r.whitened, r.deviation))
    gaps = np.abs(np.subtract.outer(values, values) + np.diag(np.full(len(values), np.inf))).min(1) > 1e-6 * values[0]
    for k in range(rank):
        want = (x - total / n) @ vectors[:, k] / values[k] ** 0.5
        own = np.array([by[i][k + 1][0][0] for i, _ in kept])
        if gaps[k]:
            assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-6
    for (i, _), row in zip(kept, x, strict=True):
        assert all(d == sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, total, strict=True)) for _, d in by[i][1])


def test_whitening_of_the_tables(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op12_spectrum_slicing"](spark, sf_dir).collect(), rows)


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 6)) * [9, 7, 5, 3, 2, 1]
    base[:, 5] = base[:, 0]  # rank 5
    rows = [(i, list(map(float, v))) for i, v in enumerate(base)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(None, rows[1][1])]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (205, [1.0, 2.0]),
           (206, [1e300] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, x string, n int").repartition(5)
    check_whitening(spectrum.whiten(df).collect(), rows)
    assert spectrum.whiten(df.limit(0)).count() == 0
    assert spectrum.whiten(df.where("vec_id >= 100 and vec_id < 140")).count() == 0  # one distinct vector has no variance


def test_eigenvalues_are_counted():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    apart = rng.standard_normal((500, 64)) * np.linspace(1, 9, 64)
    equal = q @ np.diag([5.0] * 4 + [3.0] * 20 + [1.0] * 16) @ q.T
    for matrix in (apart.T @ apart / 500, (equal + equal.T) / 2, np.diag([3.0, 2.0, 0.0]), np.array([[0.0, 1.0], [1.0, 0.0]]) + 2 * np.eye(2)):
        want = np.linalg.eigvalsh(matrix)
        for s in rng.uniform(want[0] - 1, want[-1] + 1, 40):
            assert spectrum.inertia(matrix, s) == (want < s).sum()
        values, vectors = spectrum.leading(matrix)
        k = len(values)
        assert k == min(16, (want > 1e-12).sum())
        assert np.allclose(values, want[::-1][:k], rtol=1e-13) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-13)
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12


def nodes_by_brute_force(rows):
    turns = defaultdict(list)
    for i, turn, role, text in rows:
        if i is not None:
            role, text = role or "", text or ""
            code = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[i].append((turn is not None, turn or 0, code, role, text))
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = [t[3:] for t in sorted(turns.get(c - c % 5, []))[:h] + sorted(own)[h:]]
    members = defaultdict(list)
    for c, path in sorted(whole.items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, own in members.items():
        below = [m for m in members if m[: len(node)] == node]
        leaf = [m for m in below if not any(len(o) == len(m) + 1 and o[: len(m)] == m for o in members)]
        ends = ",".join(str(c) for c in own if len(whole[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(len(m) == len(node) + 1 for m in below), len(leaf),
                    sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n):
    """Few texts and roles, so that prefixes, whole conversations and shards meet; gaps, nulls, repeated turns."""
    r = random.Random(seed)
    out = []
    for c in range(n):
        for k in range(r.choice((0, 1, 2, 3, 9, 12))):
            out.append((c, r.choice((k, k, k, k, None)), r.choice(("user", "user", None)), r.choice(("a", "a", "a", "bé", "", None))))
    return out + [(n + 4, 1, "user", "a"), (n + 4, 1, "user", "b"), (n + 4, 1, "user", "a"), (None, 0, "user", "a")] + [(n + 20 + k, 0, "user", "a") for k in range(60)]


@pytest.mark.parametrize("shard_rows", [3, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed, shard_rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = conversations(seed, 70)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, codes string").repartition(4)
    got = prefix_trie.trie(df, shard_rows=shard_rows)
    assert sorted(map(tuple, got.collect()), key=str) == nodes_by_brute_force(rows)
    assert prefix_trie.trie(df.limit(0)).count() == 0


def test_tree_is_balanced():
    tree = prefix_trie.Tree()
    for k in prefix_trie.median_first(1000):
        tree.insert([k])
    depth, stack = 0, [(tree.down[0], 1)]
    while stack:
        v, d = stack.pop()
        if v >= 0:
            depth = max(depth, d)
            stack += [(tree.low[v], d + 1), (tree.high[v], d + 1)]
    assert depth == 10 and [tree.code[v] for v in tree.order()][1:] == list(range(1000))
