"""The attention model: probabilities that add up, gradients, windows, training on every word, partitions, held-out likelihood."""

import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("weftline.llm")
import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from weftline.llm import byte_bpe, language_id, lm_score, queries  # noqa: E402


def scored(docs, held):
    return {r["doc_id"]: r for r in lm_score.scores(docs, held, queries.RANKS, P.PATTERN).collect()}


def table(n=300, seed=0, texts=20):
    r = np.random.default_rng(seed)
    a, b = r.integers(-1, n, 4000), r.integers(-1, n, 4000)
    key = np.unique((a + 1) * (n + 1) + b + 1)
    a, b = key // (n + 1) - 1, key % (n + 1) - 1
    some = (a >= 0) | (b >= 0)
    return lm_score.Table(n, a[some], b[some], r.integers(1, 50, some.sum()), texts)


@pytest.mark.parametrize("model", [lm_score.Model(table()), lm_score.Model(lm_score.Table(40, *(np.zeros(0, np.int64),) * 3, 0))], ids=["counts", "nothing"])
def test_probabilities_of_a_next_id_add_up_to_one(model):
    n, r = model.end, random.Random(1)
    p = {k: v + np.random.default_rng(2).normal(0, 0.3, v.shape).astype(v.dtype) for k, v in lm_score.beginning().items()}
    for size in (0, 1, 20, 70):
        before = [r.randrange(n) for _ in range(size)]
        total = 0.0
        for i in range(n + 1):  # each next id, or the end
            ids = np.array([*before, i] if i < n else before)
            total += math.exp(lm_score.id_scores(p, ids, np.array([len(ids)]), model)[size])
        assert abs(total - 1) < 1e-3


def test_windows_and_gradients():
    model, r = lm_score.Model(table()), np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lm_score.beginning().items()}
    p["out"] *= 20
    each = np.array([5, 40, 0, 70])
    ids = r.integers(0, 300, each.sum())
    given, wanted = lm_score.layout(ids, each, 300)

    def loss(q):
        return -lm_score.forward(q, given, wanted, model)["logp"].mean()

    grad, n, _ = lm_score.step(p, given, wanted, model)
    assert n == each.sum() + len(each)  # each id and end once
    used = np.unique(lm_score.forward(p, given, wanted, model)["at"])
    for k in p:
        for _ in range(4):
            i = tuple(r.choice(used) if k == "in" and j == 0 else r.integers(0, m) for j, m in enumerate(p[k].shape))
            a = p[k][i]
            p[k][i] = a + 1e-5
            up = loss(p)
            p[k][i] = a - 1e-5
            down = loss(p)
            p[k][i] = a
            assert abs((up - down) / 2e-5 - grad[k][i]) < 1e-6, k


def test_attention_brute():
    """Scores of each position by loops over all earlier ids that its window reaches."""
    model, r = lm_score.Model(table()), np.random.default_rng(3)
    p = {k: v.astype(np.float64) * (10 if k in ("out", "far") else 1) for k, v in lm_score.beginning().items()}
    p["far"] = r.normal(0, 1, p["far"].shape)
    ids = r.integers(0, 300, 75)
    got = lm_score.id_scores(p, ids, np.array([75]), model)
    w, b = lm_score.WIDTH, lm_score.BLOCK
    given = [300, *ids.tolist()]
    x = p["in"][model.embedded[given]]
    for t in range(76):
        goal = ids[t] if t < 75 else 300
        q = x[t] @ p["qkv"][:, :w]
        reach = range(max(0, (t // b - 1) * b), t + 1)
        s = np.array([q @ (x[j] @ p["qkv"][:, w : 2 * w]) / math.sqrt(w) + p["far"][t - j] for j in reach])
        a = np.exp(s - s.max())
        a /= a.sum()
        h = x[t] + sum(y * (x[j] @ p["qkv"][:, 2 * w :]) for y, j in zip(a, reach, strict=True))
        z = h @ p["out"] + p["bias"] + model.logq[model.row[given[t]]]
        want = z[model.cls[goal]] - np.log(np.exp(z).sum()) + model.inner(np.array([given[t]]), np.array([goal]))[0]
        assert abs(got[t] - want) < 1e-4


def test_score_does_not_depend_on_which_words_are_listed(spark, monkeypatch):
    texts = ["aa bb aa cc dd", "bb aa ee aa", "cc cc new aa bb", None, "", "aa", "zz yy xx aa bb dd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    every = scored(docs, F.col("doc_id") == 6)
    monkeypatch.setattr(lm_score, "TOP", 1)
    few = scored(docs, F.col("doc_id") == 6)
    for i, r in every.items():
        assert few[i]["n_known"] == r["n_known"]
        assert abs(few[i]["base_score"] - r["base_score"]) < 1e-9 and abs(few[i]["score"] - r["score"]) < 1e-4


def test_learns_from_all_words(spark):
    """Words that change places leave all counts as they are: only steps on that part of the text can tell."""
    r = random.Random(4)
    words = [r.choice("aa bb cc dd ee ff gg hh".split()) for _ in range(300)]
    other = "aa bb cc dd ee ff gg hh aa cc"

    def score(at):
        text = words[:]
        text[at : at + 8] = sorted(text[at : at + 8], reverse=at > 0)
        docs = spark.createDataFrame([(0, " ".join(text)), (1, other)], "doc_id long, text string").coalesce(1)
        return scored(docs, F.col("doc_id") == 1)[1]["score"]

    assert len({score(at) for at in (0, 100, 200, 290)}) == 4


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_WORDS", 4000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = language_id.remainder(F.col("doc_id"), 5) == 1
    one = scored(docs.coalesce(1), held)
    for n in (4, 32):
        other = scored(docs.repartition(n), held)
        assert one.keys() == other.keys()
        assert all(abs(one[i]["score"] - other[i]["score"]) <= 1e-4 * abs(one[i]["score"]) for i in one)


def test_shards_take_whole_texts_in_one_order(spark):
    rows = [(i % 40, f"text {i % 50}") for i in range(300)] + [(None, "same")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = [tuple(r) for r in lm_score.in_shards(docs.repartition(3), 5 * lm_score.SHARD_WORDS).collect()]
    again = [tuple(r) for r in lm_score.in_shards(docs.repartition(7), 5 * lm_score.SHARD_WORDS).collect()]
    assert sorted(t for _, t in dealt) == sorted(t for _, t in rows)
    assert [x for x in dealt if x[1] != "same"] == [x for x in again if x[1] != "same"]
    assert len({s for s, t in dealt if t == "same"}) == 5


def test_held_out_texts_are_likelier_than_by_word_counts(spark):
    d = "/root/testdata/sf0.1/documents.parquet"
    got = [r for r in scored(spark.read.parquet(d), language_id.remainder(F.col("doc_id"), 5) == 1).values() if r["held_out"]]
    words = sum(r["n_tokens"] for r in got)
    assert sum(r["score"] for r in got) / words > sum(r["base_score"] for r in got) / words


def test_pairs_of_ids(spark):
    key, data = byte_bpe._shipped(spark, queries.RANKS, P.PATTERN)
    words = {"tionhe": 3, "the": 5, "größe": 2, "x": 1}
    table = spark.createDataFrame([(w.encode(), c) for w, c in words.items()], "word binary, c long").repartition(3)
    got = {(r["a"], r["b"]): r["c"] for r in lm_score.count_pairs(table, key, data, P.PATTERN).collect()}
    bpe, want = byte_bpe.made(key, data, P.PATTERN), {}
    encoder = lm_score.Subwords(bpe)
    for w, c in words.items():
        ids = [-1, *encoder.encode([w.encode()])[0].tolist(), -1]
        for pair in zip(ids[:-1], ids[1:], strict=True):
            want[pair] = want.get(pair, 0) + c
    assert got == want
    assert re.fullmatch("[0-9a-f]{64}", key[0]) and zlib.crc32(b"") == 0


def test_all_pairs_of_ids_are_kept():
    n = 1100
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    c = 1 + (a * 7 + b) % 5
    held = lm_score.Table(n, a, b, c, 1)
    assert len(held.keys) == n * n and (held.pair_counts(a, b) == c).all()


def test_pairs_met_before_are_not_computed_again(monkeypatch):
    """F1 of round 2: pairs over words' borders are in no table; each is computed when it comes, not each time."""
    model, r = lm_score.Model(table()), np.random.default_rng(5)
    before, ids = r.integers(0, 301, 6000), r.integers(0, 301, 6000)
    want = model._inner(before, ids)
    sizes, plain = [], lm_score.Model._inner
    model._fill()
    monkeypatch.setattr(lm_score.Model, "_inner", lambda self, b, *more: sizes.append(len(b)) or plain(self, b, *more))
    for _ in range(3):  # places are shared, and the last pair of a place is kept
        assert np.abs(model.inner(before, ids) - want).max() < 1e-12
    assert sizes[2] < sizes[0] / 2


def test_scores_do_not_depend_on_the_batch(monkeypatch):
    model, r = lm_score.Model(table()), np.random.default_rng(6)
    p = {k: v + r.normal(0, 0.3, v.shape).astype(v.dtype) for k, v in lm_score.beginning().items()}
    each = r.integers(0, 90, 60)
    ids = r.integers(0, 300, each.sum())
    got = []
    for size in (1, 7, 128, 4096):
        monkeypatch.setattr(lm_score, "SCORED", size)
        got.append(lm_score.id_scores(p, ids, each, model))
    assert len(got[0]) == each.sum() + 60
    assert all(np.abs(x - got[0]).max() < 1e-4 for x in got)
