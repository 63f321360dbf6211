"""Token counts by rank-synchronous merging: many pre-tokens at once as ragged numpy arrays.

A block of texts is cut into pre-tokens by whole-array comparisons of character classes. The distinct ones that a worker has not
met before lie end to end in one array of symbols; each round finds every sequence's lowest-rank pair and merges it wherever the
sequence has it, and sequences without a pair that merges leave. A text has as many tokens as its pre-tokens have symbols left.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import words as W

#: Distinct pre-tokens whose counts a Python worker keeps, 16 bytes each; a full store starts again.
KEPT = 4_000_000
#: Bytes of texts that are cut and merged at once; a longer text is a block of its own.
BLOCK = 1 << 20
#: Symbols from which a sequence is merged by itself, as a linked list.
LONG = 1000
NEVER = np.int64(2**62)
#: Character classes: letters, numbers, white space, all others.
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Endings that are pre-tokens of their own after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> dict[str, int]:
    """The byte that each printable letter of a byte-level vocabulary stands for: itself, or the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def character_classes(whole) -> np.ndarray:
    """The class of every code point, by the tokenizer's own cuts.

    Code points in a row that the standard library puts in one class are asked for together: after a mate of that class they must
    make one piece. Where they don't, each is asked for alone; what joins no mate is white space.
    """
    def pieces(text: str) -> list[tuple[int, int]]:
        return [span for _, span in whole.pre_tokenizer.pre_tokenize_str(text)]

    mates = {LETTER: "a", NUMBER: "1", OTHER: "!"}
    guess = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        group = unicodedata.category(chr(c))[0]
        guess[c] = LETTER if group == "L" else NUMBER if group == "N" else SPACE if group == "Z" else OTHER
    edges = np.flatnonzero(np.diff(guess)) + 1
    out = np.full(0x110000, SPACE, np.uint8)
    for lo, hi in zip([0, *edges], [*edges, 0x110000], strict=True):
        for a, b in ((lo, min(hi, 0xD800)), (max(lo, 0xE000), hi)):  # surrogates are no characters
            kind = int(guess[lo])
            if a < b and kind != SPACE and pieces(mates[kind] + "".join(map(chr, range(a, b)))) == [(0, b - a + 1)]:
                out[a:b] = kind
            elif a < b:
                for c in range(a, b):
                    out[c] = next((k for k, mate in mates.items() if pieces(mate + chr(c)) == [(0, 2)]), SPACE)
    return out


class Merger:
    """Token counts of texts by a byte-level BPE vocabulary file, equal to the library's own."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._must_be_plain(spec)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.base = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab["".join(m)] for m in pairs], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        self.ordered = self._is_ordered(left, right, made)
        # a pair given twice keeps its later rank, as the library's table does
        keys, last = np.unique((left * self.width + right)[::-1], return_index=True)
        self.keys, self.rank = keys, len(pairs) - 1 - last
        self.made = made[self.rank]
        marks = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.marks = re.compile(b"|".join(re.escape(m.encode()) for m in marks)) if marks else None
        self.kinds = character_classes(Tokenizer.from_file(path))
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    @staticmethod
    def _must_be_plain(spec: dict) -> None:
        """Only what is followed here exactly: another file stops the job instead of giving other counts."""
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("normalizer", "truncation", "padding") if spec.get(k)]
        odd += [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex") or odd:
            raise ValueError(f"not a plain byte-level BPE file: {model['type']}, {cut}, {odd}")

    def _is_ordered(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> bool:
        """Whether each pair's symbols are made by earlier pairs: then merging a pair never makes one of lower rank."""
        born = np.full(int(self.width), len(made), np.int64)
        np.minimum.at(born, made, np.arange(len(made)))
        born[self.base] = -1
        at = np.arange(len(made))
        return bool(((born[left] < at) & (born[right] < at)).all())

    def starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each code point of texts laid end to end; ``first`` marks the texts' first ones."""
        n = len(codes)
        kind = self.kinds[codes]
        space = kind == SPACE
        before = np.concatenate([[np.uint8(255)], kind[:-1]])
        blank = np.concatenate([[False], codes[:-1] == 0x20]) & ~first  # a plain space belongs to what follows it
        last = np.concatenate([first[1:], [True]])
        follow = np.concatenate([~space[1:], [False]]) & ~last  # another character than white space follows in the text
        start = first | (~space & (kind != before) & ~blank) | (space & (before != SPACE))
        start |= space & (before == SPACE) & follow  # the last of several blanks stands apart
        mark = np.flatnonzero((codes == 0x27) & ((before != OTHER) & ~blank | first))
        for ending in ENDINGS:
            size = len(ending)
            own = mark[mark + size < n]
            fits = np.ones(len(own), bool)
            for k, letter in enumerate(ending, 1):
                fits &= (codes[own + k] == ord(letter)) & ~first[own + k]
            own = own[fits]
            start[own + 1] = False
            after = own + size + 1
            start[after[after < n]] = True
        return start

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, NEVER if no merge has it, and the symbol that it becomes."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER), self.made[at]

    @staticmethod
    def _every_other(pick: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Of places that follow one another, as ``joined`` says of each and the one before, every other one from the left."""
        run = np.flatnonzero(~joined)
        return pick[(np.arange(len(pick)) - np.repeat(run, np.diff(np.append(run, len(pick))))) % 2 == 0]

    def merge_long(self, symbols: np.ndarray) -> int:
        """Symbols left of one long sequence, as a linked list whose pairs are filed by rank: a round touches only what merges."""
        n = len(symbols)
        left, symbols, after, before = n, symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, made = self._ranks(symbols[:-1], symbols[1:])
        rank, made = np.append(rank, NEVER), np.append(made, 0)
        filed: dict[int, list[np.ndarray]] = {}

        def file(places: np.ndarray) -> None:
            places = places[rank[places] < NEVER]
            order = places[np.argsort(rank[places], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(rank[order])) + 1) if len(order) else ():
                key = int(rank[part[0]])
                if key not in filed:
                    filed[key] = []
                    heapq.heappush(heap, key)
                filed[key].append(part)

        heap: list[int] = []
        file(np.arange(n - 1))
        while heap:
            now = heapq.heappop(heap)
            pick = np.unique(np.concatenate(filed.pop(now)))
            pick = pick[rank[pick] == now]
            if not len(pick):
                continue
            pick = self._every_other(pick, np.append(False, after[pick[:-1]] == pick[1:]))
            gone = after[pick]
            symbols[pick] = made[pick]
            after[pick] = after[gone]
            inner = after[pick] < n
            before[after[pick[inner]]] = pick[inner]
            rank[gone] = NEVER
            touched = np.unique(np.concatenate([pick, before[pick]]))
            touched = touched[touched >= 0]
            ends = after[touched] >= n
            rank[touched[ends]] = NEVER
            touched = touched[~ends]
            rank[touched], made[touched] = self._ranks(symbols[touched], symbols[after[touched]])
            file(touched)
            left -= len(pick)
        return left

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence; the sequences, ``sizes`` long, lie end to end in ``symbols``."""
        left = sizes.copy()
        bounds = np.cumsum(sizes)
        long = (sizes > LONG) & self.ordered
        for k in np.flatnonzero(long):
            left[k] = self.merge_long(symbols[bounds[k] - sizes[k] : bounds[k]])
        many = (sizes > 1) & ~long
        live, keep = np.flatnonzero(many), np.repeat(many, sizes)
        symbols, owner = symbols[keep], np.repeat(np.arange(len(live)), sizes[live])
        while len(live):
            joint = owner[:-1] == owner[1:]
            rank, made = self._ranks(symbols[:-1], symbols[1:])
            rank, made = np.append(np.where(joint, rank, NEVER), NEVER), np.append(made, 0)
            lowest = np.minimum.reduceat(rank, np.flatnonzero(np.concatenate([[True], ~joint])))
            going = lowest < NEVER
            pick = np.flatnonzero((rank == lowest[owner]) & going[owner])
            if self.ordered:
                pick = self._every_other(pick, np.append(False, np.diff(pick) == 1)) if len(pick) else pick
            else:  # one pair at a time, as merging it may make one of lower rank
                pick = pick[np.unique(owner[pick], return_index=True)[1]]
            symbols = symbols.copy()
            symbols[pick] = made[pick]
            stay = going[owner]  # finished sequences leave
            stay[pick + 1] = False
            counts = np.bincount(owner, minlength=len(live))
            left[live[~going]] = counts[~going]
            live = live[going]
            renumber = np.cumsum(going) - 1
            symbols, owner = symbols[stay], renumber[owner[stay]]
        return left

    def _sections(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts without the special strings: bytes, first bytes of the sections between them, texts' n + 1 bounds, special strings per text."""
        special = np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        if self.marks is None or not self.marks.search(raw):
            return data, offsets, offsets, special
        cuts, keep = [offsets], np.ones(len(data), bool)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            for m in self.marks.finditer(raw, a, b):  # one that lies within one text
                special[i] += 1
                keep[m.start() : m.end()] = False
                cuts.append(np.array([m.start(), m.end()]))
        place = np.concatenate([[0], np.cumsum(keep)])
        return data[keep], place[np.unique(np.concatenate(cuts))], place[offsets], special

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each of the texts laid end to end, ``offsets`` their n + 1 first bytes (the first 0)."""
        data, cuts, offsets, special = self._sections(data, offsets)
        if not len(data):
            return special
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))
        at = np.concatenate([[0], at[:-1]])
        first = np.zeros(len(codes), bool)
        first[np.searchsorted(at, cuts[cuts < len(data)])] = True
        begin = at[self.starts(codes, first)]
        tokens = self._counted(data, begin, np.diff(np.append(begin, len(data))))
        total = np.concatenate([[0], np.cumsum(tokens)])
        return special + np.diff(total[np.searchsorted(begin, offsets)])

    def _counted(self, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; each distinct one is merged once."""
        within = np.arange(len(data)) - np.repeat(begin, sizes)
        value = W._BYTE[data] * W.powers(W._BASE, int(sizes.max()))[within]
        hashes = W.mix(np.add.reduceat(value, begin) + sizes.astype(np.uint64))
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > KEPT:
            self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            start, size = begin[first[new]], sizes[first[new]]
            upto = np.cumsum(size) - size
            source = np.repeat(start - upto, size) + np.arange(int(size.sum()))
            left = self.merge(self.base[data[source]], size)
            self.counts = np.insert(self.counts, at[new], left)
            self.known = np.insert(self.known, at[new], unique[new])
            at = np.searchsorted(self.known, unique)
        return self.counts[at][which]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            tokens = [np.zeros(0, np.int64)]
            for lo, hi in W.blocks(offsets, BLOCK):
                own = offsets[lo : hi + 1]
                tokens.append(merger(path).texts(data[own[0] : own[-1]], own - own[0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(np.concatenate(tokens), pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text), as the byte-level BPE file counts them.

    A row's result depends on its text alone: null ids stay, repeated rows are returned as often, null and empty texts have no
    token, other columns are not read. Special strings inside a text are one token each, as the library has it by default.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(_count(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
