"""One row of each group of near copies: lost rows, names of columns, repeated rows."""

import random

import pytest

pytest.importorskip("weftline.llm")
from weftline.llm import simhash  # noqa: E402


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_ids_that_are_null_or_repeat_lose_nothing(spark, similarity):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcde"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (9, None), (10, ""), (11, texts[4]), (11, texts[4]), (11, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.keep_one(docs, 5, similarity).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted([("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("7", texts[3]), ("9", ""), ("11", texts[4])])


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_columns_may_have_any_names(spark, similarity):
    columns = ["doc_id", "text", "_simhash", "_component", "label", "key", "row", "text_key", "n", "a.b"]
    rows = [(i, f"word{i} " * 30, *range(8)) for i in range(5)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'string' if c == 'text' else 'long'}" for c in columns))
    got = simhash.keep_one(docs, 5, similarity)
    assert got.columns == columns and sorted(tuple(r) for r in got.collect()) == rows


def test_a_large_group_of_copies_and_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(300)] + [(1000 + i, " ".join([*base[:i % 50], f"x{i}", *base[i % 50 + 1 :]])) for i in range(300)]
    rows += [(5000 + i, " ".join(f"u{i}v{j}" for j in range(30))) for i in range(40)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 5, 0.8)
    ids = sorted(r["doc_id"] for r in got.collect())
    assert ids == [0, *range(5000, 5040)]


def test_long_texts_that_share_a_passage_are_not_compared(spark, monkeypatch):
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*(f"u{i}v{j}" for j in range(900)), *passage])) for i in range(40)]
    counts, similar = [], simhash.similar
    monkeypatch.setattr(simhash, "SAMPLE", 1)  # so few texts are sampled that the passage does not show
    monkeypatch.setattr(simhash, "similar", lambda pairs, *rest: (counts.append(pairs.count()), similar(pairs, *rest))[1])
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8)
    assert got.count() == 40 and sum(counts) == 0


def test_groups_are_those_of_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for g in range(25):
        base = [f"g{g}w{j}" for j in range(rng.randint(8, 120))]
        for _ in range(6):
            words = [w if rng.random() > 0.02 else f"x{rng.randrange(10**9)}" for w in base]
            texts.append(" ".join(words[rng.randint(0, len(words) // 6) :] + [f"t{j}" for j in range(rng.choice([0, 0, 6]))]))
    sets = [set(simhash.hashes(t, 5).tolist()) for t in texts]
    group = list(range(len(texts)))
    for a, x in enumerate(sets):
        for b in range(a):
            if 10 * len(x & sets[b]) >= 8 * len(x | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    got = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 5, 0.8)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(group)) and 25 < len(set(group)) < len(texts)
