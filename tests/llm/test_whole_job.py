"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np
import pyarrow as pa

from tokenizers import Tokenizer

from lattica.llm import matroska, neardup, quality, queries, token_counts, worker


def test_near_duplicates_go_row_by_row(spark):
    """Rows that share an id, or have none, with texts of different components."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(3, b), (5, a), (5, b + " x"), (9, a + " x"), (None, c), (None, b + " y"), (None, d), (7, d + " z"), (11, ""), (11, b + " z"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = neardup.drop_near_duplicates(docs)
    assert found.columns == docs.columns
    wanted = [(3, b), (5, a), (None, c), (7, d + " z"), (11, ""), (None, "")]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in found.collect()))) == sorted(map(repr, wanted))


def test_passages_and_scores_do_not_hang_on_neighbours():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "C", "d1", "e.", "the"]) for _ in range(rng.randrange(1, 300))) for _ in range(50)]
    texts += ["", " " * 1000, "  x y x y\n", " \n a b c", "a b", "c a b c"]
    g = np.random.default_rng(0)
    n = sum(int(np.prod(s)) for s in quality.AttentionModel.SHAPES)
    model = quality.AttentionModel(g.standard_normal(n), g.random(quality.FEATURES), g.random(quality.FEATURES) + 0.1)

    def encoded(part):
        raw, offsets = quality.utf8(pa.array(part))
        features, count = quality.passages(raw, offsets)
        bags = [x.tobytes() for x in np.split(features, np.cumsum(count)[:-1])]
        return list(zip(bags, quality.scores(pa.array(part), model).tolist(), strict=True))

    alone = {t: encoded([t])[0] for t in texts}
    for size in (2, 9, 60, 200):
        part = [rng.choice(texts) for _ in range(size)]
        assert encoded(part) == [alone[t] for t in part]
    # All bytes of a row are its own, the white space before its first word too.
    assert alone["  x y x y\n"][0] != encoded(["x y x y"])[0][0]
    assert not np.frombuffer(alone[" " * 1000][0], np.float32).any()


def test_each_distinct_pre_token_is_counted_once(spark):
    """Through the query, with all that the pre-tokenizer cuts oddly, and with what its parts hand on."""
    library, rng = Tokenizer.from_file(queries.GPT_VOCABULARY), random.Random(3)
    parts = [" ", "  ", "   ", "\n", "\t", "a", "é", "1", "22", "!", "\x1c", "\x85", "　", "'s", "don't", "<|endoftext|>", "<|endo", "。", "日本", "\r\n", "🙂", "\u0558", "\u058b", "\U0001fae9", "\u088f"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(1500)] + [(None, None), (None, "a b"), (3, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(repr, ((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs, queries.GPT_VOCABULARY).collect())))
    assert found == sorted(repr((i, len(library.encode(t or "", add_special_tokens=False).ids))) for i, t in rows)
    tokens, ends, at, times = token_counts.places(["a a  b<|endoftext|>", "", "a b"], queries.GPT_VOCABULARY)
    assert tokens.to_pylist() == [" ", " a", " b", "<|endoftext|>", "a"]
    assert (ends.tolist(), at.tolist(), times.tolist()) == ([5, 5, 7], [0, 1, 2, 3, 4, 2, 4], [1] * 7)


def test_every_cue_is_checked_whatever_their_number():
    payload = bytes(576 * 20)
    movie = matroska.parse(matroska.mux(payload))
    real = len(movie.cues)
    movie.cues += [(-1, 1, 0)] * 1000
    assert real and f";cues={real};" in matroska.feature(movie, payload)


def test_batches_are_bounded_by_bytes(spark):
    """The bound holds for a session without one, a session's own stays, and no row is lost."""
    docs = spark.range(6000).selectExpr("repeat('abcdefgh ', 300) AS text").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "size"])

    before = spark.conf.get(worker._BATCH, None)
    try:
        spark.conf.unset(worker._BATCH)
        worker.bound_batches(spark)
        found = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in found) == 6000 and max(r["size"] for r in found) < 2 * worker.BATCH_BYTES
        spark.conf.set(worker._BATCH, "1000000")
        worker.bound_batches(spark)
        assert spark.conf.get(worker._BATCH) == "1000000"
    finally:
        spark.conf.set(worker._BATCH, before) if before else spark.conf.unset(worker._BATCH)
