"""The ten operators against brute force, round trips and held-out labels, and on awkward tables."""

import binascii
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lattica.llm import covertree, graph, matroska, mixing, neardup, packing, pii, quality, queries, sharding, token_counts, toxicity
from lattica.llm.learning import fold
from lattica.llm.text import span_hashes
from lattica.llm.vocabulary import run_table

SF = "/root/testdata/sf0.001"
BPE = queries.GPT_VOCABULARY
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
EDGE = [
    (1, "", "src0"), (2, None, "src0"), (3, "one two three four five six seven", None), (4, "one two three four five six seven", "src1"),
    (5, " \n\t ", "src1"), (6, "word " * 30_000, "src2"), (7, "mail a.b@c.de now", "src0"), (None, "null id", "src0"), (3, "one two three four five six seven", None),
    (9, "ÄÖ é 日本語 <|endoftext|> x", "src2"),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", s, len(t or ""), 0.5, 7, "x", 3) for i, t, s in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, label string, size int").repartition(3)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 and 3: classifiers


@pytest.mark.parametrize(("module", "target", "of", "held"), [(quality, "quality", 3, 1), (toxicity, "toxic", 5, 0)])
def test_classifier_learns_from_its_folds_only(spark, module, target, of, held):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in module.score_documents(docs, marks, of, held).collect()}
    assert len(found) == docs.count()
    rows = [(found[r["doc_id"]], r[target]) for r in marks.collect()]
    assert all(r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % of == held) for r, _ in rows)
    own = [(r["predicted"], y) for r, y in rows if r["held_out"]]
    assert np.mean([p == y for p, y in own]) > 0.95
    # Labels of the held-out fold don't matter.
    flipped = marks.withColumn(target, F.when(fold("doc_id", of) == held, 1 - F.col(target)).otherwise(F.col(target)))
    again = {r["doc_id"]: r["score"] for r in module.score_documents(docs, flipped, of, held).collect()}
    assert all(again[i] == r["score"] for i, r in found.items())


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_on_awkward_tables(spark, edge, empty, labels, module):
    found = module.score_documents(edge, labels).collect()
    assert len(found) == len(EDGE) and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (1, 2)}) == 1
    assert module.score_documents(empty, labels).count() == 0
    assert module.score_documents(edge, labels.limit(0)).count() == len(EDGE)


def plain_attention(model, x, count):
    """The scores of bags, one passage and one unit at a time."""
    project, shift, v, u, w, c, b = model.parts(model.flat)
    out, at = [], 0
    for n in count:
        bag = [(row - model.mean) / model.scale for row in x[at : at + n]]
        h = [np.array([np.tanh(sum(p[i] * project[i, j] for i in range(len(p))) + shift[j]) for j in range(len(shift))]) for p in bag]
        logit = [sum(w[k] * np.tanh(one @ v[:, k]) / (1 + np.exp(-(one @ u[:, k]))) for k in range(len(w))) for one in h]
        weight = np.exp(logit) / np.exp(logit).sum()
        z = sum(a * one for a, one in zip(weight, h, strict=True))
        out.append(1 / (1 + np.exp(-(z @ c + b[0]))))
        at += n
    return np.array(out)


def attention_model(rng):
    n = sum(int(np.prod(s)) for s in quality.AttentionModel.SHAPES)
    return quality.AttentionModel(rng.standard_normal(n) * 0.1, rng.standard_normal(quality.FEATURES), rng.random(quality.FEATURES) + 0.5)


def test_attention_equals_a_plain_version():
    rng = np.random.default_rng(0)
    x, count = rng.standard_normal((9, quality.FEATURES)), np.array([2, 3, 4])
    model = attention_model(rng)
    assert np.allclose(np.add.reduceat(model.attention(x, count), [0, 2, 5]), 1)
    assert np.allclose(model.score(x, count), plain_attention(model, x, count))


def test_gradient_of_attention_is_numeric(monkeypatch):
    rng = np.random.default_rng(1)
    x, count, label = rng.standard_normal((9, quality.FEATURES)), np.array([2, 3, 4]), np.array([0.0, 1.0, 1.0])
    held = {}
    monkeypatch.setattr(quality, "adam", lambda gradient, start, *_: held.update(gradient=gradient) or start)
    model = quality.AttentionModel.fit(x, count, label)
    flat = rng.standard_normal(len(model.flat)) * 0.2

    def loss(at):
        own = quality.AttentionModel(at, model.mean, model.scale)
        p = own.score(x, count)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)) + quality.RIDGE / 2 * (at @ at)

    found = held["gradient"](flat)
    for i in rng.choice(len(flat), 60, replace=False):
        step = np.zeros(len(flat))
        step[i] = 1e-5
        assert found[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-5, rel=1e-3, abs=1e-6)


def test_long_documents_train_on_spaced_passages(spark):
    long = " ".join(f"w{i}" for i in range(64 * 1000))
    docs = spark.createDataFrame([(1, long), (2, "good words here."), (1, "other text"), (3, long + " bad")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, marks, F.lit(True)) is not None and toxicity.fit(docs, marks, F.lit(True)) is not None
    bag = np.stack([np.arange(100_000), np.arange(100_000) // 10], 1)
    short = toxicity.shortened(bag)
    assert len(short) <= 3 * toxicity.TRAIN_WORDS and short[:, 1].max() + 1 == len(np.unique(short[:, 1])) > 500
    assert len(quality.spaced(np.arange(1000), 400)) == 400


def plain_noisy_or(model, text):
    """(score, places of the offending sentences) of a text, word by word."""
    raw = text.encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    one = lambda part: int(span_hashes(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))[0]) >> (64 - toxicity.BITS)
    clean, at, found = 1.0, 0, []
    for part in re.split(rb"[\n!.?]", raw):
        words = [(m.start() + at, m.end() + at) for m in re.finditer(rb"[A-Za-z\x80-\xff]+", part)]
        if words:
            logit = model.bias
            for a, b in words:
                logit += model.weights[one(low[a:b])] + sum(model.weights[one(low[a : a + k])] for k in toxicity.STEMS if b - a > k)
            p = 1 / (1 + np.exp(-logit))
            clean *= 1 - p
            found.append((p, len(raw[: words[0][0]].decode()), len(raw[: words[-1][1]].decode())))
        at += len(part) + 1
    score = 1 - clean
    bad = [f for f in found if f[0] >= 0.5] or ([max(found, key=lambda f: f[0])] if found else [])
    return score, ",".join(f"{a}:{b}" for _, a, b in bad) if score >= 0.5 else ""


def test_toxicity_equals_a_plain_version(spark, edge):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, marks, fold("doc_id", 5) != 0)
    rows = toxicity.score_documents(docs, marks).collect()
    by_id = dict(texts(docs))
    for r in sorted(rows, key=lambda r: -r["score"])[:60] + rows[:60]:
        score, places = plain_noisy_or(model, by_id[r["doc_id"]] or "")
        assert r["score"] == pytest.approx(score, abs=1e-4) and r["sentences"] == places
    assert any(r["sentences"] for r in rows)


def test_planted_sentences_are_the_ones_located(spark):
    """The offending word is in one sentence of a toxic document: that one is located, in held-out documents too."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, marks, at = [], [], {}
    for i in range(600):
        sentences = [" ".join(word() for _ in range(6)) + "." for _ in range(rng.randrange(2, 9))]
        if i % 2:
            k = rng.randrange(len(sentences))
            sentences[k] = "these zzvile words " + sentences[k]
            at[i] = sum(len(s) + 1 for s in sentences[:k])
        rows.append((i, " ".join(sentences)))
        marks.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.score_documents(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).where("held_out").collect()
    hits = [r["sentences"].startswith(f"{at[r['doc_id']]}:") and "," not in r["sentences"] if r["doc_id"] in at else r["sentences"] == "" for r in found]
    assert len(hits) > 80 and np.mean(hits) > 0.95


def test_offending_sentences_are_located(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), F.lit(True))
    by_id = dict(texts(docs))
    found = toxicity.offending_sentences(docs, model).collect()
    assert found and all(by_id[r["doc_id"]][r["start"] : r["end"]] == r["sentence"] for r in found)


# 2: sharding


def test_sharding_balances_and_counts_slots(documents, edge, empty):
    rows = sharding.shard(documents, 24).collect()
    load, slots = Counter(), defaultdict(list)
    by_id = dict(texts(documents))
    for r in rows:
        raw = (by_id[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(by_id) and set(load) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) <= sum(load.values()) / 24 * 1.01 + max(r["size"] for r in rows)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(documents.repartition(5), 24).collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    assert sharding.shard(edge, 4).count() == len(EDGE) and sharding.shard(empty, 4).count() == 0


def plain_placement(rows, shards, points=sharding.POINTS, slack=sharding.SLACK):
    """Shard of every (key, cell, class, size), by a row-at-a-time walk over the ring: homes first, then the overflow, largest class first."""
    nodes = sharding.ring(shards, points)
    totals = defaultdict(list)
    for key, cell, kind, size in sorted(rows):
        totals[cell, kind].append((key, size))
    most, load, where, over = sum(r[3] for r in rows) / shards * (1 + slack), Counter(), {}, []
    clockwise = lambda cell: list(dict.fromkeys(s for c, s in [n for n in nodes if n[0] >= cell] + nodes))
    for (cell, kind), own in sorted(totals.items()):
        home, size = clockwise(cell)[0], sum(s for _, s in own)
        if load[home] + size <= most:
            load[home] += size
            where.update((k, home) for k, _ in own)
        else:
            over.append((kind, cell))
    for kind, cell in sorted(over, reverse=True):
        way, own = clockwise(cell), totals[cell, kind]
        size = sum(s for _, s in own)
        whole = [s for s in way if load[s] + size <= most]
        if whole:
            load[whole[0]] += size
            where.update((k, whole[0]) for k, _ in own)
            continue
        at = 0
        starts = np.cumsum([0, *(s for _, s in own)])
        for s in way:
            end = size if load[s] + size - at <= most else min(size, at + int(most - load[s]) - 2**kind)
            if end > at:
                where.update((k, s) for (k, _), x in zip(own, starts, strict=False) if at <= x < end)
                load[s] += end - at
                at = end
        if at < size:
            least = min(way, key=lambda s: (load[s], s))
            where.update((k, least) for (k, _), x in zip(own, starts, strict=False) if at <= x)
            load[least] += size - at
    return where


def test_sharding_equals_a_plain_walk(spark, documents):
    key = F.xxhash64("doc_id", "size", "text_crc32")
    for docs, shards in ((documents, 24), (documents.unionAll(documents.withColumn("doc_id", F.lit(-1)).withColumn("text", F.lit("same"))), 5)):
        found = sharding.shard(docs, shards).withColumn("key", key)
        rows = [(r["key"], (r["key"] % 2**64) >> 52, r["size"].bit_length(), r["size"], r["shard"]) for r in found.collect()]
        if shards == 24:
            assert plain_placement([r[:4] for r in rows], shards) == {r[0]: r[4] for r in rows}
        else:  # a third of the bytes or more under one key: that key is cut
            load = Counter()
            for r in rows:
                load[r[4]] += r[3]
            assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / shards + 2 * max(r[3] for r in rows)


def test_production_slack_balances_and_moves_little():
    """At the production slack, a 25th shard takes about a 25th of the rows, and few others move."""
    rng = random.Random(5)
    sizes = defaultdict(list)
    for _ in range(40_000):
        size = int(2 ** rng.gauss(10, 1.5)) + 8
        sizes[rng.randrange(sharding.CELLS), size.bit_length()].append(size)
    totals = [(c, k, len(s), sum(s)) for (c, k), s in sizes.items()]

    def placed(shards):
        parts, where, load = defaultdict(list), {}, Counter()
        for cell, kind, lo, hi, shard in sharding.walk(totals, shards):
            parts[cell, kind].append((lo, hi, shard))
        for key, own in sizes.items():
            at = 0
            for i, size in enumerate(own):
                where[key, i] = next(s for lo, hi, s in parts[key] if lo <= at < hi)
                load[where[key, i]] += size
                at += size
        return where, load

    (a, load), (b, _) = placed(24), placed(25)
    mean = sum(load.values()) / 24
    assert max(load.values()) <= mean * (1 + sharding.SLACK) and min(load.values()) > 0.99 * mean
    moved, new = sum(a[k] != b[k] for k in a) / len(a), sum(s == 24 for s in b.values()) / len(b)
    assert 0.03 < new < 0.05 and moved < 0.08


def test_a_total_larger_than_a_shard_is_cut():
    load = Counter()
    for _, _, lo, hi, shard in sharding.walk([(3, 10, 10_000, 10_000 * 600), (9, 10, 100, 100 * 600)], 4):
        load[shard] += hi - lo
    assert max(load.values()) - min(load.values()) < 0.02 * 10_100 * 600


# 4: exact search


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((1500, 16)) / 4
    base[100:400] = base[50] + rng.standard_normal((300, 16)) * 0.01
    base[500:900] = base[0]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(base.astype(np.float32))]
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 14), (2100, [float("nan")] * 16), (None, [1.0] * 16), (2150, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(4)
    found = defaultdict(list)
    for r in covertree.top_k(df, 5, 50, 256, slab=512).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    x = np.floor(256 * base.astype(np.float32).astype(np.float64)).astype(np.int64)
    assert set(found) == set(range(0, 1500, 50))
    for q in found:
        score = x @ x[q]
        score[q] = -(1 << 40)
        order = np.lexsort((np.arange(len(x)), -score))[:5]
        assert found[q] == [(int(i), int(score[i])) for i in order]
    assert covertree.top_k(df.limit(0)).count() == 0


def test_search_prunes_clusters(spark):
    """Clusters over many slabs: a query meets few of them, and the results are those of brute force."""
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((40, 8)) * 3
    x = np.concatenate([c + rng.standard_normal((100, 8)) * 0.05 for c in centers])
    order = rng.permutation(len(x))
    x = x[order]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = defaultdict(list)
    for r in covertree.top_k(df, 5, 50, 256, slab=200).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = np.floor(256 * x).astype(np.int64)
    for q in range(0, len(x), 50):
        score = whole @ whole[q]
        score[q] = -(1 << 40)
        best = np.lexsort((np.arange(len(x)), -score))[:5]
        assert found[q] == [(int(i), int(score[i])) for i in best]
    pairs = covertree.pairs_compared(df, 5, 50, 256, slab=200)
    assert 0 < pairs < 0.25 * 80 * 4000


# 5: mixing


def test_mix_meets_targets(documents, edge, empty):
    by_id = {r["doc_id"]: r for r in documents.collect()}
    rows = mixing.mix(documents).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(by_id)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        d = by_id[r["doc_id"]]
        assert r["size"] == len(WORD.findall((d["text"] or "").encode())) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
        target[d["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(target[s] <= 2 * sizes[s] and abs(taken[s] - target[s]) <= mixing.BLOCK for s in sizes)
    assert {tuple(r) for r in mixing.mix(documents.repartition(7)).collect()} == {tuple(r) for r in rows}
    assert mixing.mix(edge).count() == len(EDGE) and mixing.mix(empty).count() == 0


def plain_mix(rows):
    """taken of every (doc_id, source, words), slot by slot: the parts end to end, a block at a time."""
    from lattica.llm.mixing import BLOCK, PARTS, SEED

    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    words = [[] for _ in sources]  # the document of each word, in the order of the layout
    for i, s, n in sorted(rows, key=lambda r: (rows_part[r[0]], r[0])):
        words[sources.index(s)] += [i] * n
    goal = mixing.targets([len(w) for w in words])
    blocks = [[w[at : at + BLOCK] for at in range(0, len(w), BLOCK)] for w in words]
    slots = [min(2 * len(b), round(g * len(b) / len(w))) if w else 0 for w, g, b in zip(words, goal, blocks, strict=True)]
    taken = Counter()
    for group, first, count in mixing.group_draws(slots, SEED):
        for s, lo, hi in mixing.shard_draws(group, first, count, SEED):
            for slot in range(lo, hi):
                turn, index = divmod(slot, len(blocks[s]))
                taken.update(blocks[s][int(mixing.permuted(np.array([index]), len(blocks[s]), SEED + 1000003 * s + turn)[0])])
    return taken


rows_part: dict = {}


def test_mix_equals_a_plain_version(spark, documents):
    part = documents.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(mixing.PARTS)).alias("p"))
    rows_part.update({r["doc_id"]: r["p"] for r in part.collect()})
    rows = [(r["doc_id"], r["source"], len(WORD.findall((r["text"] or "").encode()))) for r in documents.collect()]
    taken = plain_mix(rows)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(documents).collect()} == {i: taken[i] for i, _, _ in rows}


def test_draws_give_every_slot_once(monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 7)
    monkeypatch.setattr(mixing, "SHARDS_AT_ONCE", 3)
    slots, seen, sizes = [100, 0, 33, 1], defaultdict(list), Counter()
    for group, first, count in mixing.group_draws(slots):
        assert sum(count) <= 21
        for s, lo, hi in mixing.shard_draws(group, first, count):
            seen[s] += range(lo, hi)
    assert [sorted(seen[s]) for s in range(4)] == [list(range(n)) for n in slots]


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert sum(mixing.targets([10, 1000, 3, 77])) == pytest.approx(1.5 * 1090)


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutations(n):
    assert sorted(mixing.permuted(np.arange(n), n, 17)) == list(range(n))


def test_mixed_documents_hold_the_words_taken(documents):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(documents).collect()}
    words = Counter()
    for r in mixing.mixed_documents(documents).collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert all(words[i] == n for i, n in taken.items())


# 6: Matroska


@pytest.mark.parametrize("lacing", ["none", "fixed", "xiph", "ebml"])
def test_matroska_round_trip(lacing):
    rng = random.Random(3)
    for n in (1, 2, 17, 300, 700):
        payload = rng.randbytes(576 * n)
        media = matroska.mux(payload, lacing=lacing, frames_per_block=1 if lacing == "none" else 16)
        movie = matroska.parse(media)
        assert b"".join(media[p[4] : p[4] + p[5]] for p in movie.packets) == payload
        assert [p[1] for p in movie.packets] == [i * 72_000_000 for i in range(n)]
        assert [(t, p) for t, _, p in movie.cues] == [(t, p) for p, t in movie.clusters]


def test_matroska_lacing_of_unequal_frames_and_unknown_sizes():
    rng = random.Random(4)
    frames = [rng.randbytes(n) for n in (3, 900, 0, 255, 510, 70_000, 1)]
    for lacing in ("xiph", "ebml"):
        body = matroska.block_body(5, -3, frames, lacing)
        track, relative, _, ranges = matroska.frames_of(body, 0, len(body))
        assert (track, relative, [body[a:b] for a, b in ranges]) == (5, -3, frames)
    block = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, matroska.block_body(1, 4, frames[:2], "xiph", simple=False)) + matroska.uint(matroska.BLOCK_DURATION, 10) + matroska.uint(matroska.REFERENCE_BLOCK, 1))
    cluster = matroska.uint(matroska.TIMESTAMP, 100) + block
    open_ = lambda key, body: key.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    media = matroska.element(matroska.EBML, b"") + open_(matroska.SEGMENT, open_(matroska.CLUSTER, cluster) + open_(matroska.CLUSTER, cluster))
    movie = matroska.parse(media)
    assert [(p[1], p[2], p[3], p[6]) for p in movie.packets] == [(104_000_000, 5_000_000, False, 0), (109_000_000, 5_000_000, False, 0), (104_000_000, 5_000_000, False, 1), (109_000_000, 5_000_000, False, 1)]
    with pytest.raises(ValueError):
        matroska.parse(media[:3])


def test_stored_documents(edge, empty):
    rows = matroska.store_documents(edge).collect()
    assert len(rows) == len(EDGE)
    for r, t in ((r, dict((i, t) for i, t, _ in EDGE)[r["doc_id"]]) for r in rows):
        n, payload = matroska.padded(t)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
    packets = matroska.packet_table(matroska.store_documents(edge)).groupBy("doc_id").agg(F.sum("size").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packets}[6] == len(matroska.padded("word " * 30_000)[1])
    assert matroska.store_documents(empty).count() == 0


# 7: packing


def test_packing(documents, edge, empty):
    library = Tokenizer.from_file(BPE)
    for docs in (documents, edge):
        ids = defaultdict(list)
        for i, t in texts(docs):
            ids[i].append([*library.encode(t or "", add_special_tokens=False).ids, 0])
        rows = packing.pack(docs, BPE).collect()
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        assert sum(r["length"] for r in rows) == sum(len(x) for own in ids.values() for x in own)
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        least = -(-sum(r["length"] for r in rows) // 2048)
        assert len(sequences) <= least * 1.02 + 1
    assert packing.pack(empty, BPE).count() == 0


def test_packing_plan_holds_every_piece():
    rng = np.random.default_rng(6)
    for _ in range(3):
        counts = np.bincount(rng.integers(1, 65, 4000), minlength=65)
        plan = packing.pack_counts(counts, 64)
        held = sum(np.bincount(c, minlength=65) * n for c, n in plan)
        assert (held == counts).all() and all(sum(c) <= 64 for c, _ in plan)
        _, bound = packing.solve(np.where(np.arange(65) == 64, 0, counts), 64)
        used, plain = sum(n for _, n in plan), sum(n for _, n in packing.best_fit(counts.copy(), 64))
        assert bound + counts[64] - 1e-6 <= used <= plain * 1.01 + 1
        table = packing.places(plan)
        assert len(np.unique(table[:, :2], axis=0)) == len(table)


# 8: near duplicates


def brute_components(rows, width, percent):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(lower).split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    return sorted((key, len(sets[i]), min(k for k in least[find(i)] if k is not None) if any(k is not None for k in least[find(i)]) else None) for i, (key, _) in enumerate(rows) if key is not None)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, documents, edge, empty, width, percent):
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(200)]
    rows = texts(documents)
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(200)] = f"v{rng.randrange(9)}"
        rows.append((10_000 + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, width, percent).collect())
    assert found == brute_components(rows, width, percent)
    some = neardup.near_duplicates(edge, width, percent).collect()
    assert len(some) == len(EDGE) and {r["component_id"] for r in some if r["doc_id"] in (3, 4)} == {3}
    assert all(r["component_id"] == r["doc_id"] for r in some if r["n_shingles"] == 0)
    assert neardup.near_duplicates(empty, width, percent).count() == 0


@pytest.mark.parametrize("hub", [True, False])
def test_large_buckets_and_components_go_by_chunks(spark, monkeypatch, hub):
    """Groups of many chunks: copies of one text, and a chain in which only neighbours are linked."""
    monkeypatch.setattr(neardup, "CHUNK", 8)
    monkeypatch.setattr(neardup, "EXACT_CHUNK", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        if hub:
            copy[rng.randrange(120)] = f"x{i}"
            rows.append((i, " ".join(copy)))
        else:
            rows.append((i, " ".join([f"w{j}" for j in range(4 * i, 4 * i + 120)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 3, 85).collect())
    assert found == brute_components(rows, 3, 85)


def test_posterior_tests_rarely_miss():
    tests = neardup.least_matches(0.85, 120)
    rng = np.random.default_rng(0)
    matches = rng.random((20_000, 120)) < 0.85
    lost = np.zeros(20_000, bool)
    for n, least in tests:
        lost |= matches[:, :n].sum(1) < least
    assert lost.mean() < 1e-3


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r["node"]: r["label"] for r in graph.components(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# 9: personal data

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    found = [(m.start(), m.end(), 0) for m in _EMAIL.finditer(t)]
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a", "B", ".", "@", "_", "-", "+", "1", "23", "255", "0", " ", "(", ")", "é", "%", ".com", "4111111111111111", "12"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_base_spans_of_long_runs_take_linear_time():
    for t in ("0" * 5000 + ".1.1.1", "(212) 555-0123 " * 100_000, "+1 (212) 555-0123, " * 100_000, "\n" * 2_000_000, "a[at]b[dot]com " * 50_000, "1" * 2_000_000):
        assert pii.described(t) is not None
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 5006, 1)]
    for t in ("a" * 300_000 + "@", "1" * 300_000, "@" * 100_000, "1." * 100_000, "a@" * 100_000):
        pii.base_spans(t)


def test_detection(spark, documents, edge, empty):
    for docs in (documents, edge):
        by_id = dict(texts(docs))
        for r in pii.detect(docs).collect():
            own = plain_spans(by_id[r["doc_id"]] or "")
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == i for s in own) for i in range(4)]
            assert r["base_sha256"] == hashlib.sha256(pii.joined(own).encode()).hexdigest()
            assert set(filter(None, pii.joined(own).split(","))) <= set(r["spans"].split(","))
    assert pii.detect(empty).count() == 0
    assert "[EMAIL]" in {r["doc_id"]: r["text"] for r in pii.redact(edge).collect()}[7]


def test_em_tells_reliable_labelers_from_noise():
    rng = np.random.default_rng(3)
    truth = rng.random(5000) < 0.3
    vote = np.stack([np.where(rng.random(5000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.85, 0.5, 0.8)], 1)
    posterior, table = pii.reliabilities(np.zeros(5000, int), vote, np.ones(5000))
    assert ((posterior > 0.5) == truth).mean() > 0.95
    assert table[0, 0, 1] > 0.9 and abs(table[0, 3, 1] - 0.5) < 0.1


def test_spans_beyond_the_base_ones_are_found(spark):
    """Planted loose spans: national numbers and obfuscated addresses; look-alikes: impossible numbers, failed checksums, order numbers."""
    rng = random.Random(4)
    rows, wanted, refused = [], {}, {}
    for i in range(2000):
        digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        national = f"({rng.choice('23456789')}{rng.choice('023456789')}{digits(1)}) {rng.choice('23456789')}{digits(2)}-{digits(4)}"
        card = digits(15)
        check = next(c for c in "0123456789" if pii.luhn(card + c))
        kind, head, span = rng.choice([
            ("base", "call ", f"+1 {national}"), ("base", "mail ", f"a{i}.b@mail{i % 9}.com"), ("base", "card ", "4" + digits(15)), ("base", "host ", "10.2.3.4"),
            ("yes", "phone ", national), ("yes", "words ", national), ("yes", "contact ", f"a{i}[at]mail[dot]com"),
            ("no", "version ", f"({rng.choice('01')}{digits(2)}) {rng.choice('01')}{digits(2)}-{digits(4)}"), ("no", "order ", card + rng.choice("0123456789".replace(check, ""))),
        ])
        rows.append((i, f"some {head}{span} and more"))
        (wanted if kind == "yes" else refused if kind == "no" else {})[i] = f":{5 + len(head)}:{5 + len(head) + len(span)}"
    found = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = {i: r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for i, r in found.items()}
    caught = [found[i]["spans"].endswith(place) for i, place in wanted.items()]
    wrong = [found[i]["spans"] != "" for i in refused if not base[i]]
    recall, precision = np.mean(caught), sum(caught) / (sum(caught) + sum(wrong))
    assert len(caught) > 400 and len(wrong) > 200 and recall > 0.95 and precision > 0.95


def test_loose_spans_overlap_nothing():
    rng = random.Random(6)
    parts = ["(212) 555-0123", "212 555 0123", "4111 1111 1111 1111", "4111111111111112", "a[at]b[dot]com", "a@b.com", "+1 212 555 0123", "10.2.3.4", " ", "-", "x", "12"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        base = pii.base_spans(t)
        loose = pii.loose_spans(t, base)
        assert all(b <= x or a >= y for a, b, _ in loose for x, y, _ in base)
        assert all(p[1] <= q[0] for p, q in zip(loose, loose[1:], strict=False))


# 10: token counts


def test_token_counts_equal_the_library(documents, edge, empty):
    library = Tokenizer.from_file(BPE)
    for docs in (documents, edge):
        by_id = dict(texts(docs))
        rows = token_counts.count_tokens(docs, BPE).collect()
        assert len(rows) == docs.count()
        for r in rows:
            t = by_id[r["doc_id"]] or ""
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)
    assert token_counts.count_tokens(empty, BPE).count() == 0


def test_runs_are_cut_where_the_pre_tokenizer_cuts():
    library, rng = Tokenizer.from_file(BPE), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "é", "1", "22", "!", " ", "\x1c", "　", "'s", "don't", "<|endoftext|>", "。", "\r\n", "x y", "🙂", "\x85"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    ids = [library.encode(t, add_special_tokens=False).ids for t in cases]
    table = run_table(BPE, False)
    assert [sum(table.sizes(table.pre_tokens(t))) for t in cases] == list(map(len, ids))
    assert packing.document_ids(cases, BPE, 0) == [np.array([*x, 0], "<u4").tobytes() for x in ids]


def test_a_full_run_table_starts_anew(monkeypatch):
    from lattica.llm import vocabulary

    monkeypatch.setattr(vocabulary, "TABLE_ENTRIES", 10)
    table = vocabulary.RunTable(BPE, True)
    for i in range(5):
        runs = {f"w{i}{j}" for j in range(20)}
        table.learn(runs)
        assert runs <= table.table.keys() and len(table.table) <= 20


# awkward input of all


LONG = ["\n" * 2_000_000, " " * 1_500_000, "0" * 5000 + ".1.1.1", "(212) 555-0123 " * 100_000, "x" * 1_000_000, "!" * 1_000_000, "7" * 1_000_000, "a b. " * 300_000, "é" * 500_000]
BIG = (1 << 53) + 1


@pytest.fixture(scope="module")
def long_texts(spark):
    """Very long texts of one kind each, and ids above 2 ** 53 beside a null."""
    return spark.createDataFrame([(BIG + 2 * i, t, "src0") for i, t in enumerate(LONG)] + [(None, "null id", None)], "doc_id long, text string, source string").repartition(2)


def test_very_long_texts_and_large_ids(spark, long_texts, labels):
    library = Tokenizer.from_file(BPE)
    by_id = dict(texts(long_texts))
    ids = sorted(i for i in by_id if i is not None)
    results = {
        "quality": quality.score_documents(long_texts, labels), "shard": sharding.shard(long_texts, 4), "toxic": toxicity.score_documents(long_texts, labels), "mix": mixing.mix(long_texts),
        "media": matroska.store_documents(long_texts).drop("media"), "near": neardup.near_duplicates(long_texts, 3, 85), "pii": pii.detect(long_texts), "tokens": token_counts.count_tokens(long_texts, BPE),
    }
    for name, df in results.items():
        rows = df.collect()
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == ids and len(rows) == len(LONG) + 1, name
        if name == "tokens":
            assert all(r["n_tokens"] == len(library.encode(by_id[r["doc_id"]], add_special_tokens=False).ids) for r in rows)
    held = Counter()
    for r in packing.pack(long_texts, BPE).collect():
        held[r["doc_id"]] += r["length"]
    assert held == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in by_id.items()}
    kept = {r["doc_id"]: r["text"] for r in pii.redact(long_texts).collect()}
    assert kept[BIG] == LONG[0] and kept[None] == "null id" and "[PHONE]" in kept[BIG + 6]


def test_row_wise_operators_on_awkward_tables(spark, edge, empty, labels):
    """keep_good, drop_near_duplicates, redact and mixed_documents keep columns, whatever their names, and null ids."""
    odd = edge.withColumn("_row", F.lit(1)).withColumn("_mix_row", F.lit("m")).withColumn("_near_row", F.lit(2)).withColumn("_spans", F.lit(3)).withColumn("_mix_spans", F.lit(4)).withColumn("_text", F.lit(5)).withColumn("_check", F.lit(6))
    for operator in (lambda d: quality.keep_good(d, labels), neardup.drop_near_duplicates, pii.redact, mixing.mixed_documents):
        out = operator(odd)
        assert out.columns == odd.columns
        rows = out.collect()
        assert rows and all((r["_row"], r["_mix_row"], r["_near_row"], r["_spans"], r["_mix_spans"]) == (1, "m", 2, 3, 4) for r in rows)
        assert operator(odd.limit(0)).count() == 0
    kept = [r["doc_id"] for r in neardup.drop_near_duplicates(odd).collect()]
    assert Counter(kept)[3] == 2 and 4 not in kept and None in kept and {1, 2, 5} <= set(kept)
    assert len(pii.redact(odd).collect()) == len(EDGE)
    assert toxicity.offending_sentences(empty, toxicity.NoisyOr(np.zeros(1 << toxicity.BITS), -6.0)).count() == 0
    assert toxicity.offending_sentences(edge, toxicity.NoisyOr(np.zeros(1 << toxicity.BITS), 6.0)).count() > 5


def test_near_copies_without_ids(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(60)] + [(None, " ".join(base)), (7, " ".join(base))]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert len(found) == 62 and {r["component_id"] for r in found} == {7}


# the pipeline


def test_pipeline(spark, documents):
    rows = corpus_pipeline.run(spark, SF).collect()
    lengths = Counter()
    for r in rows:
        lengths[r["sequence_id"]] += r["length"]
    assert rows and max(lengths.values()) <= 2048
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == documents.columns, name
        if name in ("quality_classifier", "near_dedup"):
            assert 0 < after.count() < docs.count()
        if name == "personal_data":
            assert all(not pii.base_spans(r["text"]) for r in after.collect())
        docs = spark.createDataFrame(after.collect(), after.schema)


@pytest.mark.parametrize("hub", [0, 900])
def test_components_match_union_find(spark, hub):
    """Random edges, loops and repeats; with a node that meets a large part of all edges."""
    rng = np.random.default_rng(hub)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 2000, (1000, 2))] + [(int(x), 7) for x in rng.integers(0, 2000, hub)]
    edges += [*edges[:20], (5, 5), (9999, 9999)]
    above = {x: x for e in edges for x in e}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        above[high] = low
    found = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: top(x) for a, b in edges if a != b for x in (a, b)}
