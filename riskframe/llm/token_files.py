"""Token files: flat unsigned integers and 64-bit document offsets, one pair of files per range of document ids.

Documents are dealt by ranges of their id, so file k holds smaller ids than file k + 1. A task tokenizes its range and writes the
ids as they come; the files' sizes then give each file's base by a prefix sum. A reader maps a file into memory and finds document
d of it at ``base + offsets[d]`` of the whole corpus.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm import words as W
from riskframe.llm.files import Written, mapped, place
from riskframe.llm.shared import new_folder, stored, tasks

END = 2
#: What the file of document ids holds for a null id.
NULL_ID = -(2**63)
#: Distinct words whose ids a Python worker keeps, about 30 bytes each; a full store starts again.
KEPT_WORDS = 3_000_000
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
_IN_PLAIN = re.compile(r"[a-z0-9ß-öø-ÿ!-&(-/:;=-@\[-`{-~]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}


class Encoder:
    """Ids of words by a tokenizer file, each distinct word encoded once.

    White space always ends a token of the vocabularies meant here, so a text's ids are those of its words in turn. Words of
    plain letters, digits and ASCII marks are cut as the tokenizer's own pattern cuts them and go straight to its model; every
    other word goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.direct = self._is_plain()
        self.forget()

    def _is_plain(self) -> bool:
        """Whether the cuts made here are the tokenizer's, by its own answers."""
        probe = ["abc", "l'eau", "café,", "x=1;y", "12a", "a--b.c", "üß*"]
        return all(self._direct(w) == self.whole.encode(w, add_special_tokens=False).ids for w in probe if _IN_PLAIN.fullmatch(w))

    def _direct(self, word: str) -> list[int]:
        return [t.id for piece in _PLAIN.findall(word) for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def forget(self) -> None:
        self.known, self.at, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def word(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        low = text if text.isascii() else unicodedata.normalize("NFC", text)
        low = low.lower()
        if self.direct and len(low) < 200 and _IN_PLAIN.fullmatch(low):
            return self._direct(low)
        return self.whole.encode(text, add_special_tokens=False).ids

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, each followed by END, and the n + 1 places where they start."""
        raw = data.tobytes()
        # a special token is matched before letters are lowered
        found = W.words(data, offsets, fold=np.arange(256, dtype=np.uint8) if b"<|" in raw else W.LOWER)
        unique, first, which = np.unique(found.hash, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > KEPT_WORDS:
            self.forget()
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            got = [self.word(raw[found.start[k] : found.end[k]]) for k in first[new]]
            sizes = np.array([len(g) for g in got], np.int64)
            flat = np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum()))
            self.at = np.insert(self.at, at[new], len(self.flat) + np.cumsum(sizes) - sizes)
            self.n = np.insert(self.n, at[new], sizes)
            self.known = np.insert(self.known, at[new], unique[new])
            self.flat = np.concatenate([self.flat, flat])
            at = np.searchsorted(self.known, unique)
        start, size = self.at[at][which], self.n[at][which]
        upto = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(start - upto[:-1], size) + np.arange(upto[-1])
        ends = upto[found.bounds[1:]]
        out = np.insert(self.flat[source], ends, END)
        return out, np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _width(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _write(folder: str, path: str, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, files, total, docs = task.partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files = {kind: Written(system, f"{root}/part-{part:06d}.{kind}", task.taskAttemptId()) for kind in ("ids", "offsets", "docs")}
                files["offsets"].write(np.zeros(1, "<i8").tobytes())
            data, offsets = W.utf8(batch.column("text"))
            for lo, hi in W.blocks(offsets, 2 << 20):
                own = offsets[lo : hi + 1]
                ids, starts = encoder(path).texts(data[own[0] : own[-1]], own - own[0])
                files["ids"].write(ids.astype(dtype).tobytes())
                files["offsets"].write((total + starts[1:]).astype("<i8").tobytes())
                total += len(ids)
            files["docs"].write(batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            docs += batch.num_rows
        if files:
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([docs], pa.int64()),
                                              "n_tokens": pa.array([total], pa.int64())})

    return run


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, parts: int | None = None, order: list[str] | None = None
          ) -> tuple[str, str, DataFrame]:
    """Write ``docs`` (doc_id, text) as token files; returns the folder, the files' number type and their manifest.

    The manifest has a row per file: part, n_docs, n_tokens and ``base``, the ids of all files before. Null ids come first, rows
    with equal ids follow their text's hash; null and empty texts hold the end id alone; an empty table writes no file. Ids take
    16 bits where the vocabulary fits, else 32. ``order`` names other columns whose order the files follow.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    dtype = _width(tokenizer)
    keys = [F.col(c).alias(f"key{k}") for k, c in enumerate(order)] if order else [F.col("doc_id").cast("long").alias("key0")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys)
    names = [f"key{k}" for k in range(len(keys))]
    rows = rows.repartitionByRange(parts or tasks(spark), *names).sortWithinPartitions(*names, F.xxhash64("text"), "text").drop(*names)
    done = stored(rows.mapInArrow(_write(folder, tokenizer, dtype), "part int, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return folder, dtype, done.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _read(folder: str, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids, offsets, docs = (mapped(system, f"{root}/part-{part:06d}.{kind}", t)
                                      for kind, t in (("ids", dtype), ("offsets", "<i8"), ("docs", "<i8")))
                for at in range(0, len(docs), 5000):
                    own = np.array(docs[at : at + 5000])
                    cut = np.array(offsets[at : at + len(own) + 1])
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(base + cut[:-1], pa.int64()), pa.array(np.diff(cut), pa.int64()),
                         pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(folder: str, dtype: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    rows = manifest.select("part", "base").repartition(tasks(manifest.sparkSession), "part")
    return rows.mapInArrow(_read(folder, dtype), "doc_id long, start long, n_tokens long, ids_crc32 long")
