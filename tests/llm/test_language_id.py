"""Counts and probabilities of naive Bayes against loops over n-grams."""

import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("weftline.llm")
from weftline.llm import language_id as L  # noqa: E402

M = 0xFFFFFFFF


def brute_buckets(text):
    c = [ord(x) for x in f" {text.lower()} "]
    out = Counter()
    for a, b in zip(c[:-1], c[1:]):
        h = ((a * 0x9E3779B1 + b) & M) * 0x85EBCA77 & M
        out[(h ^ (h >> 15)) & (L.BUCKETS - 1)] += 1
    for a, b, d in zip(c[:-2], c[1:-1], c[2:]):
        h = ((a * 0x9E3779B1 + b) & M) * 0x85EBCA77 & M
        out[(((h ^ (d * 0xC2B2AE3D & M)) * 0x9E3779B1 & M) >> 17) & (L.BUCKETS - 1)] += 1
    return out


def test_posteriors_brute(spark, monkeypatch):
    r = random.Random(1)
    words = {"en": "the house water with", "de": "das haus wasser über", "fr": "la maison eau où"}
    train = [(" ".join(r.choices(words[k].split(), k=12)), k) for k in r.choices(list(words), k=60)] + [(None, "en"), ("42", "de"), ("x", None)]
    model = L.fit(spark.createDataFrame(train, "text string, lang string").repartition(3))
    sums, rows = {k: Counter() for k in words}, Counter()
    for t, k in train:
        if t and k and any(x.isalpha() for x in t):
            sums[k] += brute_buckets(t)
            rows[k] += 1
    assert model["langs"] == sorted(words)
    texts = ["the water", "das wasser und mehr", "eau", "", None, "12 !", "Über maison", "the " * 50] * 3
    monkeypatch.setattr(L, "PRODUCT", 40)
    langs, shares = L.score_batch(texts, model)
    for t, lang, share in zip(texts, langs, shares, strict=True):
        if not t or not any(x.isalpha() for x in t):
            assert (lang, share) == ("und", 0.0)
            continue
        n, logs = brute_buckets(t), []
        for k in model["langs"]:
            total = sum(sums[k].values()) + 0.1 * L.BUCKETS
            logs.append(math.log(rows[k] / sum(rows.values())) + sum(c * math.log((sums[k][b] + 0.1) / total) for b, c in n.items()))
        p = np.exp(np.array(logs) - max(logs))
        assert lang == model["langs"][int(p.argmax())] and abs(share - p.max() / p.sum()) < 1e-9


def test_parts_of_long_texts_meet(monkeypatch):
    text = "".join(random.Random(2).choices("abcdé fgh", k=5000))
    whole = sum((Counter(x.tolist()) for x in L.buckets(text)), Counter())
    monkeypatch.setattr(L, "PART", 64)
    assert sum((Counter(x.tolist()) for x in L.buckets(text)), Counter()) == whole == brute_buckets(text)


def test_nothing_learned():
    assert L.score_batch(["a", None], {"langs": [], "prior": np.zeros(0), "table": np.zeros((L.BUCKETS, 0))}) == (["und", "und"], [0.0, 0.0])
