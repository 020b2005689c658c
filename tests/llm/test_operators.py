"""Defined cases of every operator: nulls, empty and long texts, ties, repeated rows, no rows, clashing names."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import (
    bilinear_lm,
    byte_network,
    chat_snapshots,
    components,
    domain_mixing,
    flat_graph,
    minhash,
    packing,
    quality_rules,
    shuffle_shards,
    toxicity,
)
from tallywright.llm.queries import tokenizer_path

GOOD = "the river runs past the old mill and on to the quiet town where people meet and talk about the weather today"
BAD = "BUY!! NOW!! CHEAP!! CLICK!! HERE!! FREE!! $$$ *** BUY!! NOW!! WIN!! BIG!! PRIZE!! CALL!! FAST!! $$$ %%% OFF!!"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = np.random.default_rng(1)
    words = GOOD.split()
    rows = []
    for i in range(160):
        some = " ".join(rng.permutation(words * 4))
        toxic = i % 5 == 0
        poor = i % 4 == 1
        text = " ".join(rng.permutation(BAD.split() * 4)) if poor else some
        if toxic:
            text += " you idiot and worthless clown" * 3
        rows.append((i, text, "en" if i % 2 else "de", "src0", len(text)))
    rows.append((1000, None, None, None, None))
    rows.append((1001, "", "en", "src1", 0))
    rows.append((None, "a row without an id", "en", "src1", 3))
    rows.append((1002, "long " + "word thing " * 40000, "en", "src0", 1))
    rows.append((1003, rows[2][1], "en", "src0", 1))
    rows.append((2, rows[2][1], "de", "src0", rows[2][4]))  # a repeated id and text
    rows.append((1004, "é ÄÖ\x1cß 　 x\ny\ty", "de", "src0", 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    # ``row`` and ``n`` clash with names the operators use inside.
    spark.createDataFrame(corpus(), DOCS).withColumn("row", F.lit(1)).withColumn("n", F.lit("x")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 4 != 1), int(i % 5 == 0)) for i in range(160)] + [(None, 1, 1), (3, None, None), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def held(key, modulus, remainder):
    return zlib.crc32(("" if key is None else str(key)).encode()) % modulus == remainder


N = len(corpus())


def test_toxicity(docs, labels):
    rows = toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == N
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 160]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in known]) > 0.9
    same = [r.score for r in rows if r.doc_id in (2, 1003)]
    assert len(same) == 3 and len(set(same)) == 1


def test_byte_network(docs, labels):
    rows = byte_network.byte_quality(docs, byte_network.train(docs, labels)).collect()
    assert len(rows) == N
    assert all(r.held_out == held(r.doc_id, 4, 2) and r.predicted == (r.score >= 0.7) for r in rows)
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 160]
    assert np.mean([(r.score > 0.5) == (r.doc_id % 4 != 1) for r in known]) > 0.95


def test_network_sees_every_window():
    rng = np.random.default_rng(0)
    taps = rng.normal(size=(byte_network.WIDTH, byte_network.SYMBOLS, byte_network.FILTERS)).astype(np.float32)
    import pyarrow as pa

    text = bytes(rng.integers(97, 123, 1000, dtype=np.uint8))
    for part in byte_network.bw.slices(pa.array([text, b"", b"abc"], pa.binary())):
        windows, bounds = byte_network.chunks(part)
        peak = byte_network.responses(windows, taps).max(axis=1)
        stream = byte_network.symbols(part)[:1000]
        direct = np.max([sum(taps[k][stream[i + k]] for k in range(byte_network.WIDTH)) for i in range(1000 - byte_network.WIDTH + 1)], axis=0)
        assert np.allclose(peak[: bounds[1]].max(axis=0), direct, atol=1e-4)
        assert len(bounds) == 4 and (np.diff(bounds) >= 1).all()


def test_quality_rules(docs, labels):
    rules = quality_rules.train(docs, labels)
    rows = quality_rules.quality_rules(docs, rules).collect()
    assert len(rows) == N
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 160]
    assert np.mean([r.kept == (r.doc_id % 4 != 1) for r in known]) > 0.95
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1000].base_failed and by_id[1001].n_words == 0 and not by_id[None].kept
    assert by_id[1002].n_repeat_words == 80000 and by_id[1002].base_failed
    kept = quality_rules.without_failed(docs, rules)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_near_duplicates(spark, docs):
    found = {}
    for r in minhash.near_duplicates(docs, 4, 80).collect():
        found.setdefault(r.doc_id, []).append(r)
    texts = {}
    for key, text, *_ in corpus():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        texts[key] = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())
    ids = [k for k in texts if k is not None]
    parent = {k: k for k in ids}

    def top(k):
        return k if parent[k] == k else top(parent[k])

    for a in ids:
        for b in ids:
            if a < b and texts[a] and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    for key in ids:
        for r in found[key]:
            assert (r.n_shingles, r.component_id, r.kept) == (len(texts[key]), top(key), key == top(key))
    assert found[None][0].component_id is None and found[None][0].kept
    one = minhash.one_of_each(docs, 4, 80)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.where("doc_id IS NOT NULL").collect()) == sorted({top(k) for k in ids})


def test_near_duplicate_groups_around_a_hub(spark):
    """Copies that differ more from each other than from their original."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        words = list(base)
        for k in rng.choice(120, 3, replace=False):
            words[k] = f"x{i}_{k}"
        rows.append((i if i < 50 else i + 1, " ".join(words)))
    rows.append((50, " ".join(base)))
    texts = {k: {tuple(t.split()[i : i + 4]) for i in range(117)} for k, t in rows}
    parent = {k: k for k in texts}

    def top(k):
        return k if parent[k] == k else top(parent[k])

    for a in texts:
        for b in texts:
            if a < b and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: top(k) for k in texts}


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (2000, 2000)]
    parent = {}

    def top(k):
        parent.setdefault(k, k)
        return k if parent[k] == k else top(parent[k])

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {k: top(k) for k in parent if top(k) != k or any(top(j) == k and j != k for j in parent)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_language_model(docs):
    rows = bilinear_lm.score_texts(docs).collect()
    assert len(rows) == N
    counts = Counter()
    for key, text, *_ in corpus():
        if not held(key, 7, 2):
            counts.update([*(text or "").encode().lower().split(), None])
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(
        (str(key), len(tokens), sum(counts[t] > 0 for t in tokens), round(sum(log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens), 6))
        for key, text, *_ in corpus()
        for tokens in [[*(text or "").encode().lower().split(), None]]
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.train_tokens == total and r.held_out == held(r.doc_id, 7, 2) for r in rows)


def test_class_probabilities_are_normalised():
    rng = np.random.default_rng(6)
    counts = bilinear_lm.Counts(10, 5, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, int), rng.random(bilinear_lm.CLASSES) * 9, np.ones(24))
    model = bilinear_lm.Model(counts, bilinear_lm.start_parameters(counts.class_n))
    every = np.arange(bilinear_lm.CLASSES)
    scores = model.class_scores(every, np.full(len(every), 3), np.full(len(every), 5))
    assert abs(np.exp(scores).sum() - 1) < 1e-4


def test_packing(docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {}
    for key, text, *_ in corpus():
        ids[key] = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    repeats = Counter(key for key, *_ in corpus())
    covered = Counter()
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
    assert covered == Counter({(k, i): repeats[k] for k in ids for i in range(len(ids[k]))})
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048


def test_patterns_hold_every_piece():
    rng = np.random.default_rng(2)
    demand = np.zeros(65, np.int64)
    np.add.at(demand, rng.integers(1, 64, 3000), 1)
    held_by = np.zeros(65, np.int64)
    patterns = packing.plan_patterns(demand, 64)
    for p in patterns:
        assert sum(p.lengths) <= 64
        np.add.at(held_by, list(p.lengths), p.count)
    assert (held_by == demand).all()
    sequences = sum(p.count for p in patterns)
    assert sequences <= np.ceil((demand * np.arange(65)).sum() / 64) * 1.02
    assert packing.plan_patterns(np.zeros(65, np.int64), 64) == []


def test_sharding(spark, docs, tmp_path):
    rows = shuffle_shards.shard_digest(docs).collect()
    assert len(rows) == N
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in corpus()
    )
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    shuffle_shards.write_shards(docs, str(tmp_path / "out"), 4)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == N and set(docs.columns) <= set(written.columns)


def test_mixing(docs, labels):
    taught = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    mixed, domains = domain_mixing.mix(docs, taught, {"en": 3.0, "de": 1.0, "xx": 5.0})
    rows = mixed.collect()
    assert domains == ["de", "en"] and len(rows) == N
    assert all(abs(sum(r.p) - 1) < 1e-9 and r.rate >= 0 for r in rows)
    want = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for _, t, *_ in corpus())
    assert sorted(r.tokens for r in rows) == want
    drawn = domain_mixing.draw(mixed)
    assert drawn.columns == docs.columns and 0 < drawn.count() <= N


def test_mixing_meets_targets(spark):
    rows = [(i, ["abba", "zyzz"][i % 3 == 0] * (5 + i % 7), ["a", "z"][i % 3 == 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, domain string")
    mixed, domains = domain_mixing.mix(df.select("doc_id", "text"), df.select("doc_id", "domain"), {"a": 1.0, "z": 2.0})
    rows = mixed.collect()
    total = sum(r.tokens for r in rows)
    got = [sum(r.rate * r.tokens * r.p[k] for r in rows) / total for k in range(2)]
    assert domains == ["a", "z"] and np.allclose(got, [1 / 3, 2 / 3], atol=1e-3)


def soft_rows(spark, unsure):
    """Posteriors of which a share, ``unsure``, is the prior."""
    rng = np.random.default_rng(13)
    own = rng.choice(4, 4000, p=[0.55, 0.25, 0.15, 0.05])
    p = np.full((4000, 4), 0.01)
    p[np.arange(4000), own] = 0.97
    p[rng.random(4000) < unsure] = np.bincount(own, minlength=4) / 4000
    tokens = rng.integers(20, 300, 4000)
    return spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p)], "tokens bigint, p array<double>"), tokens, p


@pytest.mark.parametrize("unsure", [0.0, 0.7, 0.9])
def test_soft_posteriors_meet_targets(spark, unsure):
    rows, tokens, p = soft_rows(spark, unsure)
    wanted = np.sqrt(tokens @ p)
    wanted *= tokens.sum() / wanted.sum()
    fit = domain_mixing.fit_rates(rows, wanted.tolist())
    got = rows.select("p", "tokens", domain_mixing.rate(fit.steps).alias("r")).collect()
    sums = sum(r.r * r.tokens * np.array(r.p) for r in got)
    assert min(r.r for r in got) >= 0 and np.abs(sums - wanted).sum() <= 1e-3 * wanted.sum()
    assert np.allclose(sums - wanted, fit.misses, atol=1e-6 * wanted.sum())


def test_targets_out_of_reach_give_the_nearest_rates(spark):
    rows = spark.createDataFrame([(10, [0.6, 0.4]), (10, [0.4, 0.6])], "tokens bigint, p array<double>")
    fit = domain_mixing.fit_rates(rows, [18.0, 2.0])
    rates = [r.r for r in rows.select(domain_mixing.rate(fit.steps).alias("r")).collect()]
    # The least squares over nonnegative rates, on a grid.
    p, wanted = np.array([[0.6, 0.4], [0.4, 0.6]]) * 10, np.array([18.0, 2.0])
    grid = np.stack(np.meshgrid(np.arange(0, 4, 0.01), np.arange(0, 1, 0.01)), -1).reshape(-1, 2)
    ends = grid @ p - wanted
    best = grid[(ends**2).sum(axis=1).argmin()]
    assert np.allclose(rates, best, atol=0.02) and rates[1] == 0
    assert np.allclose(np.array(rates) @ p - wanted, fit.misses) and abs(fit.misses[0]) > 1


def test_mixing_of_empty_texts_and_no_rows(spark):
    rows = [(i, [None, ""][i % 2], "aaab"[i % 4]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, domain string")
    with pytest.warns(UserWarning, match="no rates meet the targets"):
        mixed, domains = domain_mixing.mix(df.select("doc_id", "text"), df.select("doc_id", "domain"))
    got = mixed.collect()
    assert domains == ["a", "b"] and len(got) == 6
    assert all(r.tokens == 1 and np.isfinite(r.rate) and r.rate >= 0 and r.miss > 0.01 for r in got)
    assert len({(tuple(r.p), r.rate) for r in got}) == 1
    empty, _ = domain_mixing.mix(df.limit(0).select("doc_id", "text"), df.select("doc_id", "domain"))
    assert empty.collect() == []


def test_posteriors_equal_a_plain_sum(spark):
    rows = [(1, "le chat noir le", "fr"), (2, "the black cat", "en"), (3, "la maison noire", "fr"), (4, "the house", "en"), (5, "chat the", "fr"), (6, "xyz", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, domain string")
    known = domain_mixing.classifier(df, df, "doc_id", "text", "domain")
    got = df.select("doc_id", domain_mixing.membership(F.col("text"), known).alias("m"), domain_mixing.features(domain_mixing.words(F.col("text"))).alias("f")).collect()
    taught = {"en": [set(r.f) for r in got if r.doc_id in (2, 4)], "fr": [set(r.f) for r in got if r.doc_id in (1, 3, 5)]}
    prior = {"en": 2 / 5, "fr": 3 / 5}
    for r in got:
        n, scores = r.m.tokens - 1, []
        for d in ("en", "fr"):
            total = 0.0
            for b in r.f:
                share = {k: sum(b in some for some in taught[k]) / len(taught[k]) for k in taught}
                mean = sum(share.values()) / 2
                total += np.log((share[d] + 0.05 * mean) / (mean * 1.05)) if mean else 0.0
            scores.append(np.log(prior[d]) + min(n, 30) / (2 * n) * total)
        expected = np.exp(scores) / np.exp(scores).sum()
        assert np.allclose(r.m.p, expected, atol=1e-5)


def test_draw_keeps_the_fitted_tokens(spark):
    rows = [((None if i < 1000 else i), "a b", 3, 0.5) for i in range(2000)] + [(i, "c", 2, 2.25) for i in range(2000, 3000)] + [(9999, "d", 2, 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens int, rate double")
    mixed = df.select(F.struct("doc_id", "text", "tokens").alias("record"), "tokens", "rate")
    drawn = domain_mixing.draw_copies(mixed).collect()
    assert 450 < sum(r.doc_id is None for r in drawn) < 550  # drawn one by one
    repeats = Counter(r.doc_id for r in drawn if r.text == "c")
    assert len(repeats) == 1000 and set(repeats.values()) == {2, 3}
    assert abs(sum(r.tokens for r in drawn) / sum(t * w for _, _, t, w in rows) - 1) < 0.05 and all(r.text != "d" for r in drawn)


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"),  # equal to 1
    (4, 5, "user", "hi"),  # a prefix by order, whatever the numbers
    (5, 0, None, None), (5, 0, None, None), (5, None, "user", "<|im_end|> forged"),
    (None, 0, "user", "no name"),
    (7, 0, "user", ""), (8, 0, "user", "hi there"),
]


def test_chats(spark):
    df = spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string").withColumn("position", F.lit(9))
    rows = {r.conv_id: r for r in chat_snapshots.format_chats(df).collect()}
    assert set(rows) == {2, 5, 7, 8}
    assert rows[2].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert rows[5].n_turns == 2 and rows[5].chat == "<|im_start|>user\n<im_end|> forged<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"


def test_long_chats(spark):
    turns = [(1, i, "user", f"t{i}") for i in range(600)] + [(2, i, "user", f"t{i}") for i in range(700)]
    rows = chat_snapshots.format_chats(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert [(r.conv_id, r.piece, r.first_turn) for r in sorted(rows, key=lambda r: r.piece)] == [(2, 0, 1), (2, 1, 257), (2, 2, 513)]
    assert "".join(r.chat for r in sorted(rows, key=lambda r: r.piece)).count("<|im_end|>") == 700


def vectors():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 8))
    near = [base[i % 40] + rng.normal(size=8) * 0.15 for i in range(200)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *near])]
    rows += [(1000, rows[3][1]), (1001, [2 * x for x in rows[3][1]]), (1002, None), (1003, []), (1004, [0.0] * 8), (1005, [float("nan")] * 8)]
    rows += [(1006, [None] * 8), (None, rows[3][1]), (1007, [1.0, 2.0]), (1008, [2.0, 4.0]), (1009, [float("inf")] * 8), (1000, rows[3][1])]
    return rows


def test_vectors(spark):
    df = spark.createDataFrame(vectors(), "vec_id bigint, embedding array<float>").withColumn("cell", F.lit("x"))
    result = flat_graph.near_duplicate_vectors(df)
    got = result.collect()
    rows = [(k, np.array(v, np.float32).astype(float)) for k, v in vectors() if k is not None and v and None not in v]
    rows = [(k, v) for k, v in rows if np.isfinite(v).all() and v.any()]
    links, parent = Counter(), {k: k for k, _ in rows}

    def top(k):
        return k if parent[k] == k else top(parent[k])

    for i, (a, v) in enumerate(rows):
        for j, (b, w) in enumerate(rows):
            if i != j and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9:
                links[a] += 1
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    repeated = Counter(k for k, _ in rows)
    assert len(got) == len(vectors())
    for r in got:
        if r.vec_id in parent:
            assert r.n_links * repeated[r.vec_id] == links[r.vec_id]
            assert (r.component_id, r.kept) == (top(r.vec_id), r.vec_id == top(r.vec_id))
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert flat_graph.audit_recall(df, result.dropDuplicates(["vec_id"]), sample=50) >= 0.9


def test_links_of_a_dense_group_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "BLOCK", 64)
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(1600, 64)), rng.normal(size=64) + rng.normal(size=(800, 64)) * 0.15]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    unit = flat_graph.normal(x)
    near = unit @ unit.T >= 0.9
    got = {r.vec_id: r for r in flat_graph.near_duplicate_vectors(df).collect()}
    assert near[1600:, 1600:].all()
    assert [got[i].n_links for i in range(2400)] == (near.sum(axis=1) - 1).tolist()
    assert {got[i].component_id for i in range(1600, 2400)} == {1600}


def test_links_count_at_both_ends(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "BLOCK", 32)
    rng = np.random.default_rng(12)
    base = flat_graph.normal(rng.normal(size=(1200, 32)))
    side = rng.normal(size=(1200, 32))
    side = flat_graph.normal(side - (side * base).sum(axis=1, keepdims=True) * base)
    x = np.concatenate([base, 0.905 * base + np.sqrt(1 - 0.905**2) * side]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    unit = flat_graph.normal(x)
    near = unit @ unit.T >= 0.9
    got = {r.vec_id: r for r in flat_graph.near_duplicate_vectors(df).collect()}
    assert (near.sum(axis=1) == 2).all() and all(near[i, i + 1200] for i in range(1200))
    assert all(got[i].n_links == got[i + 1200].n_links for i in range(1200))
    assert all((got[i].n_links == 1) == (got[i + 1200].component_id == i) for i in range(1200))
    assert sum(got[i].n_links for i in range(1200)) >= 0.95 * 1200


def test_graph_recall_in_dense_groups():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(1500, 32)), rng.normal(size=32) + rng.normal(size=(300, 32)) * 0.1]).astype(np.float32)
    lists = flat_graph.build(x, 1)
    graph = flat_graph.Lists(np.r_[0, np.cumsum([len(r) for r in lists])], np.concatenate(lists))
    unit = flat_graph.normal(x).astype(np.float32)
    q, k = flat_graph.range_search(unit, graph, unit, 0.9)
    assert len(q) >= 0.99 * (unit @ unit.T >= 0.9).sum()


def test_one_of_each_keeps_every_text_of_a_shared_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (5, a + " more"), (5, c), (5, c), (None, a), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("text_key", F.lit("mine"))
    got = [(r.doc_id, r.text) for r in minhash.one_of_each(df).collect()]
    copies = [(1, a), (2, a), (5, a + " more")]
    assert sum(g in copies for g in got) == 1  # which of them follows from the hashes of shared ids
    assert sorted((g for g in got if g not in copies), key=str) == sorted([(1, b), (5, c), (None, a), (7, None), (7, "")], key=str)


@pytest.mark.parametrize("made", ["toxicity", "network", "rules", "minhash", "lm", "packing", "sharding", "mixing", "chats", "vectors"])
def test_empty_tables(spark, made):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int, domain string")
    if made == "toxicity":
        out = toxicity.toxicity(docs, toxicity.train(docs, labels))
    elif made == "network":
        out = byte_network.byte_quality(docs, byte_network.train(docs, labels))
    elif made == "rules":
        out = quality_rules.quality_rules(docs, quality_rules.train(docs, labels))
    elif made == "minhash":
        out = minhash.near_duplicates(docs)
    elif made == "lm":
        out = bilinear_lm.score_texts(docs)
    elif made == "packing":
        out = packing.pack(docs, tokenizer_path())
    elif made == "sharding":
        out = shuffle_shards.shard_digest(docs)
    elif made == "mixing":
        out = domain_mixing.draw(domain_mixing.mix(docs, labels)[0])
    elif made == "chats":
        out = chat_snapshots.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    else:
        out = flat_graph.near_duplicate_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert out.count() == 0


def test_without_labels_everything_passes(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(docs, toxicity.train(docs, none)).where("predicted = 1").count() == 0
    rows = quality_rules.quality_rules(docs, quality_rules.train(docs, none)).collect()
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert byte_network.byte_quality(docs, byte_network.train(docs, none)).where("score <> 0.5").count() == 0
