"""Every operator on awkward rows and on empty tables, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import hamming_join, longest_factor, pairwise_quality, quality_rules, recurrent, schedule, tiling, token_files, warc_index, weak_toxicity
from riskframe.llm.shared import stored
from riskframe.llm.queries import tokenizer_file
from llm_rows import awkward_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
ROWS = [(r[0], r[1], r[2], r[3]) for r in awkward_rows()]


def test_quality_counts(awkward, nothing):
    got = quality_rules.quality_rules(awkward, least_group=5).collect()
    assert len(got) == len(ROWS)
    want = Counter()
    for i, text, *_ in ROWS:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        n = Counter(windows)
        cover = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(cover) > 20 * len(words)
        want[i, len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules.quality_rules(nothing).count() == 0


def near_brute(rows, percent=75):
    sets = []
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets.append((i, frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])))
    real = sorted({(i, s) for i, s in sets if s and i is not None}, key=lambda x: x[0])
    label = {i: i for i, _ in real}
    moved = True
    while moved:
        moved = False
        for x, (i, s) in enumerate(real):
            for j, t in real[:x]:
                if label[i] != label[j] and 100 * len(s & t) >= percent * len(s | t):
                    low = min(label[i], label[j])
                    label = {k: low if v in (label[i], label[j]) else v for k, v in label.items()}
                    moved = True
    return sets, label


def test_near_duplicates(awkward, nothing):
    unique = [(i, t) for i, t, *_ in ROWS if i not in (7, 15)]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in hamming_join.near_duplicates(awkward).collect()}
    sets, label = near_brute(unique)
    for i, s in sets:
        assert got[i, len(s)] == ((label[i], label[i] == i) if i in label else (i, True))
    assert hamming_join.near_duplicates(awkward).count() == len(ROWS)
    assert hamming_join.near_duplicates(nothing).count() == 0


def test_longest_factor(awkward, nothing):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in longest_factor.deduplicated(awkward).collect())
    text = lambda t: (t or "").encode()
    order = sorted(((i is None, i or 0, hashlib.sha256(text(t)).hexdigest(), i, text(t)) for i, t, *_ in ROWS), key=lambda x: x[:3])
    seen, want = set(), Counter()
    for _, _, _, i, b in order:
        cover = bytearray(len(b))
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                cover[k : k + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        runs = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        want[i, len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()] += 1
    assert got == want
    assert longest_factor.deduplicated(nothing).count() == 0


def test_token_files(awkward, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    got = token_files.read(*token_files.write(awkward, tokenizer_file(), parts=4)).orderBy("start").collect()
    want = Counter()
    for i, text, *_ in ROWS:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and got[0].doc_id is None
    assert token_files.read(*token_files.write(nothing, tokenizer_file())).count() == 0


def test_encoder_agrees_with_the_whole_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from riskframe.llm import words as W

    texts = ["Don't stop. it's I'll WE'VE", "<|endoftext|> a<|ENDOFTEXT|>b <|startoftext|>", "a.b,c;d!!??--x_y", "naïve é É ÇA ßß", "12 3.45 1/2 ²",
             "日本語 text", " x　y", "ﬁ İstanbul ΑΣ", "", "###$$$%%% |a|", "x" * 500, "≠ ≮"]
    whole = Tokenizer.from_file(tokenizer_file())
    data, offsets = W.utf8(pa.array(texts))
    ids, at = token_files.Encoder(tokenizer_file()).texts(data, offsets)
    assert [ids[a : b - 1].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("wanted", [1, 7])
def test_mix(awkward, nothing, wanted):
    pieces = schedule.mix(awkward, block=wanted).collect()
    by = Counter()
    for r in pieces:
        by[r.source] += r.taken
    rows = schedule.taken(awkward).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted((i is None, i or 0, len(WORD.findall(t or ""))) for i, t, *_ in ROWS)
    target = {r.source: (r.source_size, r.target) for r in pieces}
    total = sum(s for s, _ in target.values())
    names = sorted((s for s in target), key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    stopped = set()
    while True:
        level = (total - sum(3 * target[s][0] for s in stopped)) / max(sum(weight[s] for s in names if s not in stopped), 1e-9)
        more = {s for s in names if s not in stopped and level * weight[s] > 3 * target[s][0]}
        if not more:
            break
        stopped |= more
    for s in names:
        want = 3 * target[s][0] if s in stopped else level * weight[s]
        assert abs(target[s][1] - want) < 1e-6 and abs(by[s] - target[s][1]) <= 5 * (wanted or 1) and by[s] <= 3 * target[s][0]
    assert all(r.taken <= 3 * r.size for r in rows)
    assert schedule.taken(nothing).count() == 0


def test_mixed_rows_hold_the_words_taken(awkward):
    out = schedule.mixed(awkward)
    assert out.columns == awkward.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in schedule.taken(awkward).collect())


def test_numbers_by_ranges(spark, monkeypatch):
    rows = spark.range(200_000).select(F.when(F.col("id") != 77, F.col("id") % 150_000).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    kept = []
    monkeypatch.setattr(longest_factor, "stored", lambda df, label: (kept.append(stored(df, label)), kept[-1])[1])
    found = longest_factor._numbered(rows).toPandas()
    sizes = [r["count"] for r in kept[0].groupBy("range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 100_000
    ordered = found.sort_values("doc").reset_index(drop=True)
    assert ordered["doc"].tolist() == list(range(1, 200_001)) and ordered["doc_id"].isna().tolist() == [False] * 199_999 + [True]
    pairs = list(zip(ordered["doc_id"][:-1], ordered["digest"][:-1], strict=True))
    assert pairs == sorted(pairs)


def test_leaks_in_blocks(spark, awkward, monkeypatch):
    bench = spark.createDataFrame([(i, f"{w} two three four five six seven") for i, w in enumerate("abcdefgh")] + [(8, "w " * 40), (8, "w " * 40)],
                                  "item_id int, text string")
    docs = spark.createDataFrame([(i, f"x {w} two three four five six seven") for i, w in enumerate("abcdefgh")] + [(9, "w " * 50), (None, None)],
                                 "doc_id long, text string")
    whole = Counter(map(tuple, tiling.leaks(docs, bench).collect()))
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 100)
    blocks, n = tiling._blocks(bench.withColumn("item_id", F.col("item_id").cast("long")))
    sizes = blocks.groupBy("block").agg(F.sum(F.octet_length("text")).alias("b"), F.count_distinct("item_id").alias("n")).collect()
    assert len(sizes) == n > 2 and blocks.count() == bench.count() and all(r.b <= 100 or r.n == 1 for r in sizes)
    assert Counter(map(tuple, tiling.leaks(docs, bench).collect())) == whole and len(whole) >= 9
    assert tiling.leaks(docs, bench.where("false")).count() == 0


def test_leaks(spark, awkward, nothing):
    text = dict((i, t) for i, t, *_ in ROWS)[9].split()
    items = [(1, " ".join(text[100:140])), (2, " ".join(text[520:540] + text[500:520])), (3, " ".join(text[10:20]) + " no no no no no no no no no"),
             (4, None), (5, ""), (6, "one!"), (7, "One, two. THREE"), (None, " ".join(text[100:140])), (1, " ".join(text[100:140]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_words, r.n_covered, r.n_tiles) for r in tiling.leaks(awkward, bench).collect())
    assert got == Counter({(9, 1, 40, 40, 1): 2, (9, None, 40, 40, 1): 1, (9, 2, 40, 40, 2): 1, (7, 6, 1, 1, 1): 2, (8, 6, 1, 1, 1): 1, (8, 7, 3, 3, 1): 1})
    assert tiling.leaks(nothing, bench).count() == 0 and tiling.leaks(awkward, bench.where("false")).count() == 0
    assert {r.doc_id: r.n_items for r in tiling.contaminated(awkward, bench).collect()} == {9: 2, 7: 1, 8: 2}


def test_archives(spark):
    big, other = "<p>é</p>" * 300, "<p>x</p>" * 200
    rows = [(1, "http://a", big, 0), (2, "http://b c\n", big, 1), (3, None, big, 2), (4, "u", "small", 3), (5, "u", "small", 4), (6, "u", None, 5), (7, "u", "", 6),
            (None, "u", big, 7), (8, "u", other, 8), (8, "u", other, 9), (9, "u", "y" * 2_000_000, 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kept long").repartition(3)
    folder, index = warc_index.write(pages)
    got = warc_index.read(folder, index).collect()
    want = Counter()
    for i, _, html, _ in rows:
        body = (html or "").encode()
        refers = 3 if html == big and i != 3 else None
        want[i, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers, body if refers is None else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    some = warc_index.read(folder, index.where("page_id in (2, 9)")).collect()
    assert sorted(r.page_id for r in some) == [2, 9] and {r.url for r in some} == {"http://b%20c%0A", "u"}
    folder, index = warc_index.write(pages.where("false"))
    assert warc_index.read(folder, index).count() == 0


@pytest.mark.parametrize("score, label", [(weak_toxicity.toxicity, "toxic"), (pairwise_quality.quality, "quality")])
def test_scores_of_awkward_rows(spark, awkward, nothing, score, label):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, *_) in enumerate(ROWS)] + [(1, None), (99, 1)], f"doc_id long, {label} int")
    for known in (labels, labels.where("false")):
        got = score(awkward, known).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert score(nothing, labels).count() == 0


def test_stated_rates_of_lost_pairs():
    """What the module says of pairs of similarity 0.75 is the binomial tail, and the chance to share no key."""
    from math import comb
    from pathlib import Path

    n, wide, said = hamming_join.SYMBOLS, hamming_join.WIDTH, Path(hamming_join.__file__).read_text()
    far = sum(comb(n, k) * 0.25**k * 0.75 ** (n - k) for k in range(hamming_join.FARTHEST + 1, n + 1))
    meets = sum(comb(wide, k) * 0.25**k * 0.75 ** (wide - k) for k in range(hamming_join.ERRORS + 1))
    for rate in (far, (1 - meets) ** hamming_join.CHUNKS):
        assert f"with probability {rate:.1e}".replace("e-0", "e-") in said


def test_network_trains_on_all_learning_documents(spark, monkeypatch):
    """Every token of every document that is not held out passes backpropagation in the averaged round."""
    texts = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1 + i % 5))) for i in range(300)]
    seen = spark.sparkContext.accumulator(0)
    trained = recurrent._trained

    def counted(known, weights, rate, passes):
        run = trained(known, weights, rate, passes)

        def count(batches):
            for out in run(batches):
                if passes == 1:
                    seen.add(out.column("tokens")[0].as_py())
                yield out

        return count

    monkeypatch.setattr(recurrent, "_trained", counted)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    counts = docs.where(recurrent.learned()).mapInArrow(recurrent._counts, "word long, spelling byte, n long")
    counts = counts.groupBy("word").agg({"spelling": "first", "n": "sum"}).toDF("word", "spelling", "n").cache()
    known, _ = recurrent.vocabulary(counts, 1)
    recurrent.fit(docs, spark.sparkContext.broadcast(known))
    want = sum(len(WORD.findall(t)) + 1 for i, t in texts if zlib.crc32(str(i).encode()) % recurrent.FOLDS != recurrent.HELD)
    assert seen.value == want


def test_language_scores(awkward, nothing):
    got = recurrent.language_scores(awkward).collect()
    token = {k: [*WORD.findall((t or "").translate(LOW)), None] for k, (_, t, *_) in enumerate(ROWS)}
    train = [k for k, (i, *_) in enumerate(ROWS) if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for k in train for w in token[k])
    total, kinds = sum(c.values()), len(c)
    want = Counter()
    for k, (i, *_) in enumerate(ROWS):
        base = sum(np.log10((c[w] + 1) / (total + kinds + 1)) for w in token[k])
        want[i, k not in train, len(token[k]), sum(c[w] > 0 for w in token[k]), total, round(base, 3)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert recurrent.language_scores(nothing).count() == 0


def test_a_long_text_does_not_train_alone():
    """One long text among short ones takes no more steps than its share, and every token is still in one piece."""
    bounds = np.cumsum([0, 30_000, *[60] * 500])
    cut = recurrent.pieces(bounds, recurrent.TRAIN_PIECE)
    assert set(bounds) <= set(cut) and np.diff(cut).max() <= recurrent.TRAIN_PIECE and np.diff(cut).min() > 0
    n = int(bounds[-1])
    found = recurrent.Tokens(*(np.zeros(n, np.int16) for _ in range(3)), np.zeros(n, np.int32), np.zeros(n, np.uint64), bounds)
    state = recurrent._adam()
    recurrent.Network(np.zeros(recurrent.Network.size(), np.float32)).train(found, 0.001, state)
    assert state["t"] <= 2 * recurrent.TRAIN_PIECE / recurrent.STEPS


def test_words_are_looked_up_by_their_upper_bits():
    rng = np.random.default_rng(1)
    for size in (0, 1, 3, 5000):
        hashes = np.unique(np.concatenate([rng.integers(0, 2**64, size, np.uint64), np.array([0, 7, 8, 2**64 - 1], np.uint64)[:size]]))
        none = np.zeros(0)
        known = recurrent.Vocabulary(hashes, none, none, 0, 0, 0, none, recurrent._starts(hashes))
        asked = np.concatenate([hashes, hashes + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
        place = {int(h): k for k, h in enumerate(hashes)}
        assert known.lookup(asked).tolist() == [place.get(int(h), -1) for h in asked]


def test_texts_are_worked_on_in_parts(monkeypatch):
    """A batch's work is bounded by bytes, not by the rows of a batch; parts hold all rows in order, empty and null texts too."""
    import pyarrow as pa

    monkeypatch.setattr(longest_factor, "PART", 1000)
    texts = ["x" * 300, None, "", "é" * 900, *["y" * 90] * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc", "text"])
    parts = list(longest_factor._parts(iter([batch.slice(0, 0), batch, batch.slice(3, 5)])))
    assert [r for p in parts for r in p.to_pylist()] == [*batch.to_pylist(), *batch.slice(3, 5).to_pylist()]
    assert max(p.num_rows * 90 for p in parts if p.column("text")[0].as_py() == "y" * 90) <= 1000
    many = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([f"{i} " * 200 for i in range(50)])], ["doc", "text"])
    assert len(list(longest_factor._sketch(4)(iter([many])))) >= 10


def test_suffixes_that_are_alone_are_not_ranked_again(monkeypatch):
    """Ranks against sorted prefixes, and later copies against brute force; each doubling sorts only what still shares a rank."""
    r = np.random.default_rng(5)
    words = [bytes(r.integers(97, 123, 6, dtype=np.uint8)) for _ in range(400)]
    data = b" ".join(words[i] for i in r.integers(0, 400, 500))
    data = np.frombuffer(data + data[200:900] + b"\0" * 130 + data[700:1200], np.uint8)
    sizes, sort = [], np.argsort
    monkeypatch.setattr(longest_factor.np, "argsort", lambda a, *more, **named: (sizes.append(len(a)), sort(a, *more, **named))[1])
    rank = longest_factor.suffix_ranks(data)
    monkeypatch.undo()
    assert sizes[0] == len(data) + longest_factor.LENGTH and all(n < 0.7 * sizes[0] for n in sizes[1:]) and len(sizes) == 5
    whole = data.tobytes() + b"\0" * 100
    prefixes = [whole[i:i + 100] for i in range(len(data))]
    names = {p: i for i, p in enumerate(sorted(set(prefixes)))}
    assert np.unique(rank, return_inverse=True)[1].tolist() == [names[p] for p in prefixes]
    start = np.arange(len(data) - 99)
    doc, place = start // 1000, start % 1000
    first = {}
    for i in start:
        first.setdefault(prefixes[i], i)
    assert longest_factor.later_copies(data, start, doc, place).tolist() == [first[prefixes[i]] != i for i in start]
    assert longest_factor.suffix_ranks(data[:0]).tolist() == [] and not longest_factor.later_copies(data, start[:0], doc[:0], place[:0]).size
