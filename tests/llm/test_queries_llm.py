"""The registered queries over the given tables: against DuckDB, brute force, exact round trips and held-out labels."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from llm_rows import prose

import corpus_pipeline
from riskframe.llm import hamming_join, longest_factor, pairwise_quality, quality_rules, schedule, tiling, weak_toxicity
from riskframe.llm.oracles import ORACLES
from riskframe.llm.queries import QUERIES, tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
LARGER = os.path.join(os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), "sf0.01")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir):
    con = connect(sf_dir)
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


def test_quality_query_is_native_and_keeps_clean_documents(spark):
    plan = QUERIES["op1_quality_rules"](spark, LARGER)
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().toString())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [r for r in plan.collect() if r.doc_id in labels and not r.base_failed]
    clean, junk = [r for r in rows if labels[r.doc_id] == 1], [r for r in rows if labels[r.doc_id] == 0]
    assert all(r.kept for r in clean) and sum(not r.kept for r in junk) >= 0.9 * len(junk)


def test_estimates_withstand_a_third_of_outliers(spark):
    rng = np.random.default_rng(3)
    good = rng.multivariate_normal([2, 1, 1, 1, 1], np.diag([1, 2, 1, 1, 3]) + 0.3, 4000)
    bad = rng.normal(30, 0.1, (1500, 5))
    rows = [(["g"], *map(float, x)) for x in np.concatenate([good, bad])]
    names = quality_rules.NAMES
    df = spark.createDataFrame([(r[0][0], *r[1:]) for r in rows], f"key string, {', '.join(f'{n} double' for n in names)}")
    found = quality_rules.estimates(df, quality_rules.Groups(1)).collect()[0]
    assert np.allclose([found[f"m_{i}"] for i in range(5)], good.mean(0), atol=0.1)


def test_chi_square():
    assert abs(quality_rules.chi2_quantile(0.975, 5) - 12.8325) < 1e-3 and abs(quality_rules.chi2_share(7.0, 4) - 0.864112) < 1e-5


def tile_brute(text, item, least):
    """Greedy string tiling as it is defined: scan for the longest unmarked match, mark it, repeat."""
    used_t, used_i, covered = [False] * len(text), [False] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for q in range(len(item)):
            for p in range(len(text)):
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and not used_t[p + n] and not used_i[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return covered
        for k in range(n):
            used_t[p + k] = used_i[q + k] = True
        covered += n


def test_tiling_is_greedy(spark):
    rng = np.random.default_rng(5)
    for trial in range(40):
        text, item = [list(rng.integers(0, 4, n)) for n in (60, 25)]
        pairs = [(p, q) for p in range(56) for q in range(21) if text[p : p + 5] == item[q : q + 5]]
        assert sum(n for _, _, n in tiling.tiles(pairs, 5)) == tile_brute(text, item, 5)


def test_leaks_of_the_tables(spark, sf_dir, texts):
    found = {(r.doc_id, r.item_id) for r in tiling.leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                                                         spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    cut = lambda t: re.findall(r"[^\x20\x09-\x0d!-/:-@\[-`{-~]+", t.translate(LOW))
    items = {r.item_id: cut(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for i, t in texts.items():
        words = cut(t)
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for j, item in items.items():
            hits = [k for k in range(len(item) - 4) if tuple(item[k : k + 5]) in grams]
            if hits and len({m for k in hits for m in range(k, k + 5)}) >= 0.75 * len(item) and 100 * tile_brute(words, item, 5) >= 75 * len(item):
                want.add((i, j))
    assert found == want


def covers(texts):
    """By brute force: for each text, which bytes a 100-byte string covers that also starts earlier."""
    seen = set()
    for i, t in sorted(texts.items()):
        b = t.encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cover[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        yield i, cover


def runs(cover):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(cover), np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def test_longest_factor_of_the_tables(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op3_longest_factor"](spark, sf_dir).collect()}
    for i, cover in covers(texts):
        b = texts[i].encode()
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        assert got[i] == (len(b), sum(cover), len(runs(cover)), hashlib.sha256(kept).hexdigest())


def test_common_anchor_is_spread(spark, monkeypatch):
    """One passage in many documents, with other text around it each time, and more segments than one bucket takes."""
    monkeypatch.setattr(longest_factor, "SHARED", 7)
    passage = prose(0, 40)
    rows = [(i, f"{prose(100 + i, 12)} {passage} {prose(500 + i, 12)}") for i in range(80)]
    got = {r.doc_id: r for r in longest_factor.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, cover in covers(dict(rows)):
        assert got[i].n_removed == sum(cover) and [tuple(x) for x in got[i].spans or []] == runs(cover)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(longest_factor, "PIECE", 1000)
    monkeypatch.setattr(longest_factor.W, "blocks", lambda offsets, size=0: ((i, i + 1) for i in range(len(offsets) - 1)))
    base = prose(3, 2000)
    data = [np.frombuffer(t.encode(), np.uint8) for t in (base,)]
    parts = list(longest_factor._pieces(data[0], np.array([0, len(data[0])])))
    assert len(parts) > 5
    starts = [at + k for _, _, at, own, _ in parts for k in range(len(own) - 99)]
    assert starts == list(range(len(data[0]) - 99))


def test_near_copies_of_one_text(spark):
    """A large family of near copies, linked or not by a few words: the components of all pairs."""
    rng = np.random.default_rng(8)
    base = prose(1, 150).split()
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.integers(0, len(words), rng.integers(0, 9)):
            words[k] = f"w{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(words)))
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    got = {r.doc_id: r.component_id for r in hamming_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == label


def test_pairs_within_the_distance_share_a_key():
    """The pigeonhole guarantee: signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 65536, hamming_join.SYMBOLS).astype(np.uint16)
        b = a.copy()
        for k in rng.choice(hamming_join.SYMBOLS, hamming_join.CHUNKS * (hamming_join.ERRORS + 1) - 1, replace=False):
            b[k] ^= 1
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([0, 1], pa.int64()), "sign": pa.array([a.tobytes(), b.tobytes()], pa.binary())})
        keys = [set(), set()]
        for out in hamming_join._keys(iter([batch])):
            for key, i in zip(out.column("key").to_pylist(), out.column("doc_id").to_pylist(), strict=True):
                keys[i].add(key)
        shared = keys[0] & keys[1]
        assert shared
        assert min(k & 63 for k in shared) == hamming_join._first_slot(a[None], b[None])[0]


def test_token_files_of_the_tables(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_token_files"](spark, sf_dir).collect()}
    at = 0
    for i, t in sorted(texts.items()):
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_mix_of_the_tables(spark, sf_dir):
    q = QUERIES["op6_low_discrepancy_mix"](spark, sf_dir)
    rows, again = q.collect(), QUERIES["op6_low_discrepancy_mix"](spark, sf_dir).collect()
    assert sorted(rows) == sorted(again)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()}
    took, target = Counter(), {}
    for r in rows:
        took[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(took[s] - target[s]) <= 5 for s in target)  # blocks of one word here
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-6


def test_schedule_spreads_every_source(spark):
    """Any run of slots holds each source near its share."""
    goals = spark.createDataFrame([(0, 0.0, 0.2), (1, 0.2, 0.5), (2, 0.5, 1.0), (3, 1.0, 1.0)], "place int, low double, high double")
    plan = sorted((r.slot, r.place, r["rank"]) for r in schedule.slots(goals, 1000).collect())
    assert [s for s, _, _ in plan] == list(range(1000))
    for place, share in ((0, 0.2), (1, 0.3), (2, 0.5)):
        ranks = [k for _, p, k in plan if p == place]
        assert ranks == list(range(len(ranks))) and abs(len(ranks) - 1000 * share) < 4
        own = np.cumsum([p == place for _, p, _ in plan])
        assert np.abs(own - share * np.arange(1, 1001)).max() < 4


def test_the_sequence_makes_the_mix(spark, sf_dir, monkeypatch):
    """Another sequence gives other words: all points at 0 give every slot to the first source; slots order the mixed rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = schedule.taken(docs).collect()
    found = sorted((r.slot, r.doc_id) for r in schedule.mix(docs).groupBy("doc_id", "turn").agg({"slot": "min"}).toDF("doc_id", "turn", "slot")
                   .where("slot is not null").collect())
    assert [r.doc_id for r in schedule.mixed(docs).collect()] == [i for _, i in found]
    monkeypatch.setattr(schedule, "GOLDEN", 0.0)
    other = schedule.taken(docs).collect()
    first = min(r.source for r in docs.select("source").collect() if r.source is not None)
    source = {r.doc_id: r.source for r in docs.collect()}
    assert sum(r.taken for r in other if source[r.doc_id] != first) == 0 < sum(r.taken for r in rows if source[r.doc_id] != first)
    assert all(r.taken <= 3 * r.size for r in other)


def test_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op7_pairwise_quality"](spark, LARGER).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) >= 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_toxicity(spark):
    """Caught at 0.90 of the clean left alone, in all and in every language: a constant answer catches none."""
    folder = os.path.join(os.path.dirname(LARGER), "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    label = {r.doc_id: r.toxic for r in labels.collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in weak_toxicity.toxicity(docs, labels).collect() if r.held_out]
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    clean = np.sort([r.score for r in rows if label[r.doc_id] == 0])
    cut = clean[int(0.9 * len(clean))]
    for own in (None, "en", "de", "fr", "es"):
        toxic = [r.score > cut for r in rows if label[r.doc_id] == 1 and own in (None, lang[r.doc_id])]
        assert np.mean(toxic) >= 0.9, own


def test_label_model_finds_rates_and_correlations():
    """Simulated voters: two languages that never meet, some voters that copy another, wrong labels among the given."""
    r = np.random.default_rng(7)
    n = 8000
    truth, second = r.random(n) < 0.15, r.random(n) < 0.2
    rate = np.array([0.7, 0.6, 0.5, 0.6, 0.7, 0.6])
    own = np.where(np.arange(6)[None] < 3, ~second[:, None], second[:, None])
    votes = (r.random((n, 6)) < np.where(truth[:, None], rate, 0.01)) & own
    copies = votes[:, :2] & (r.random((n, 2)) < 0.95)
    label = np.where(r.random(n) < 0.02, ~truth, truth)
    votes = np.column_stack([votes, copies])
    given = np.column_stack([votes, label, ~label, ~votes.any(1)])
    model = weak_toxicity.LabelModel(label.mean(), plain=3).fit(given, 0.05 + 0.9 * label)
    found = model.posterior(given)
    assert np.mean((found > 0.5) == truth) > 0.96
    assert np.mean(found[truth & second] > 0.5) > 0.9 and np.mean(found[truth & ~second] > 0.5) > 0.9  # neither language takes the class
    assert {frozenset(p) for p in enumerate(model.parent) if p[1] >= 0} >= {frozenset((0, 6)), frozenset((1, 7))}
    rates = np.exp(model.rates[:, 0, :3])  # those without a parent's vote
    assert (rates[1] > 10 * rates[0]).all()


def test_covering_gives_rare_texts_their_voters():
    """Many terms for 100 texts, two for 5 others: both groups are covered before any has its tenth voter."""
    pairs = [(t, k) for t in range(100) for k in range(30)] + [(100 + t, 30 + k) for t in range(5) for k in range(2)]
    text, term = (np.array(x) for x in zip(*pairs, strict=True))
    chosen = weak_toxicity.covering(text, term, np.ones(32), 10)
    assert {30, 31} <= set(chosen.tolist()) and len(chosen) <= 10
    assert len(weak_toxicity.covering(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 5)) == 0


def test_sample_is_one_row_per_id(spark):
    """A hot id among the labelled ones does not widen the sample."""
    from riskframe.llm import labelled

    docs = spark.range(4000).selectExpr("id % 4 as doc_id", "concat('t', id) as text")
    labels = spark.range(4).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    got = labelled.sample(docs, labels, "toxic", rows=2).collect()
    assert len(got) == len({r.doc_id for r in got}) == 2


def test_language_scores_beat_the_base(spark):
    rows = QUERIES["op10_recurrent_scores"](spark, LARGER).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)  # both are negative
    assert np.mean([r.score > r.base_score for r in held]) > 0.95


def test_backpropagation_agrees_with_differences():
    from riskframe.llm import recurrent as R

    rng = np.random.default_rng(0)
    n = 40
    group = rng.integers(0, R.CLASSES, n).astype(np.int16)
    word = rng.integers(0, R.CLASS_WORDS, n).astype(np.int16)
    entry = (group * R.CLASS_WORDS + word).astype(np.int16)
    found = R.Tokens(group, word, entry, group, group, np.array([0, 9, 10, 25, 40]))
    flat = (0.3 * rng.standard_normal(R.Network.size())).astype(np.float64)
    dealt = R.lanes(found.bounds, 3)
    place = dealt.place[: R.STEPS]

    def loss(w):
        net = R.Network(w)
        real = place >= 0
        before, _, _ = net.steps(np.where(real, entry[place], 0), dealt.fresh[: R.STEPS], dealt.active[: R.STEPS], np.zeros((place.shape[1], R.STATE)))
        return -net.output(before[real].astype(float), group[place[real]], word[place[real]])[0].sum() / real.sum()

    net, state = R.Network(flat.copy()), {"t": 0, "m": np.zeros(R.Network.size()), "v": np.zeros(R.Network.size())}
    short = R.Tokens(*found[:5], found.bounds)
    keep = R.STEPS
    try:
        R.STEPS = len(dealt.place)
        place = dealt.place
        net.train(short, 0.0, state)
        gradient = state["m"] * 10
        for k in rng.choice(np.flatnonzero(np.abs(gradient) > 1e-4), 25, replace=False):
            step = np.zeros_like(flat)
            step[k] = 1e-4
            assert abs((loss(flat + step) - loss(flat - step)) / 2e-4 - gradient[k]) < 2e-3 * max(1, abs(gradient[k]))
    finally:
        R.STEPS = keep


def test_pipeline_stages(spark, sf_dir, tmp_path):
    """Each stage on what its predecessor kept, against plain rules."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "token_output":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outs[name] = docs.collect()
    judged = {r.doc_id: r.kept for r in QUERIES["op1_quality_rules"](spark, sf_dir).collect()}
    assert {r.doc_id for r in outs["quality"]} == {i for i, kept in judged.items() if kept}
    words = {r.doc_id: WORD.findall((r.text or "").translate(LOW)) for r in outs["quality"]}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in words.items()}
    kept = {r.doc_id for r in outs["near_dedup"]}
    for i in sets:
        near = {j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
        assert (i in kept) or any(j < i for j in near) or near, i
        assert not (i in kept and any(j in kept for j in near))
    leaked = {r.doc_id for r in tiling.leaks(spark.read.parquet(str(tmp_path / "near_dedup")), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in outs["decontaminate"]} == kept - leaked and leaked & kept
    whole = {r.doc_id: r.text for r in outs["decontaminate"]}
    assert all(r.text == whole[r.doc_id] or whole[r.doc_id].split()[: len(r.text.split())] == r.text.split() for r in outs["mix_sources"])
    encoder = Tokenizer.from_file(tokenizer_file())
    want = Counter((r.doc_id, len(encoder.encode(r.text, add_special_tokens=False).ids) + 1) for r in outs["mix_sources"])
    assert Counter((r.doc_id, r.n_tokens) for r in outs["token_output"]) == want


def test_pipeline_of_awkward_rows(spark, awkward, nothing, sf_dir):
    for rows in (awkward, nothing):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert docs.count() >= 0


def test_token_files_follow_the_schedule(spark, sf_dir, tmp_path):
    mixed = corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    mixed.write.parquet(str(tmp_path / "mix"))
    order = [r.doc_id for r in mixed.select("doc_id").collect()]
    out = corpus_pipeline.token_output(spark, spark.read.parquet(str(tmp_path / "mix")), sf_dir).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == order


def test_pipeline_keeps_columns_of_any_name(spark, sf_dir):
    """Names that the stages use themselves keep their values; equal rows of one id are one document."""
    names = ["_text", "_n", "_id", "_source", "_hash", "_copy", "_taken", "_size", "row", "hash", "id", "slot", "taken", "row_hash", "from", "file_name"]
    docs = spark.createDataFrame([(i, prose(i, 60), "en", "ab"[i % 2], 5, *[f"{c}{i}" for c in names]) for i in range(12)],
                                 f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'`{c}` string' for c in names)}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count()
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in names), name
    twice = docs.unionByName(docs)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, twice, sf_dir).collect()) == list(range(12))
    assert corpus_pipeline.token_output(spark, docs, sf_dir).count() == 12


def test_quality_learns_from_every_label(spark, monkeypatch):
    """More labelled texts than the 20,000 that a sample once held: all that are not held out reach the fit, in groups."""
    docs = spark.range(27_000).selectExpr("id as doc_id", "concat('a text of ', id) as text")
    labels = spark.range(27_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    seen = []
    monkeypatch.setattr(pairwise_quality, "fit", lambda groups: seen.append(groups.selectExpr("count(*)", "sum(octet_length(label))").first()))
    assert pairwise_quality.quality(docs, labels).limit(1).count() == 1
    assert tuple(seen[0]) == (2, sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(27_000))) and seen[0][1] > 20_000


def test_quality_fit_over_groups(spark, monkeypatch):
    """Sums over groups are those of one group: the means are equal, and both rankings part the texts."""
    docs = spark.range(400).selectExpr("id as doc_id", "if(id % 3 = 0, concat('### $$$ ', id, ' | | |'), concat('plain words of row ', id)) as text")
    rows = docs.selectExpr("doc_id", "text", "cast(doc_id % 3 != 0 as int) as label")
    one = pairwise_quality.train(rows)
    monkeypatch.setattr(pairwise_quality, "GROUP_ROWS", 60)
    many = pairwise_quality.train(rows)
    assert np.allclose(one.mean, many.mean) and np.allclose(one.scale, many.scale)
    texts = pa.array([r.text for r in rows.orderBy("doc_id").collect()])
    for ranking in (one, many):
        assert [int(s >= 0.3) for s in ranking.score(pairwise_quality.features(texts))] == [int(i % 3 != 0) for i in range(400)]
    assert pairwise_quality.train(rows.where("label = 1")) is None and pairwise_quality.train(rows.limit(0)) is None
