"""What weak supervision adds to the base spans: candidates, reliabilities, rejections."""

import random

import numpy as np
import pytest

pytest.importorskip("weftline.llm")
from weftline.llm import pii  # noqa: E402


def test_em_recovers_reliabilities():
    r = np.random.default_rng(5)
    n = 30_000
    kinds, truth = r.integers(0, 4, n), r.random(n) < 0.6
    yes_on_data, yes_on_rest = np.array([0.97, 0.9, 0.7, 0.8, 0.95]), np.array([0.06, 0.3, 0.5, 0.2, 0.4])
    v = np.where(r.random((n, 5)) < np.where(truth[:, None], yes_on_data, yes_on_rest), pii.YES, pii.NO)
    v[r.random((n, 5)) < 0.1] = pii.ABSTAIN
    codes, counts = np.unique(kinds * 3**5 + v @ 3 ** np.arange(5), return_counts=True)
    model = pii.fit(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
    assert np.abs(model["theta"][:, :, 1, pii.YES] - yes_on_data).max() < 0.06
    assert np.abs(model["theta"][:, :, 0, pii.YES] - yes_on_rest).max() < 0.08
    assert np.abs(model["share"] - 0.6).max() < 0.05
    got = pii.accepted((kinds * 3**5 + v @ 3 ** np.arange(5)).tolist(), model)
    assert (got == truth).mean() > 0.93


def test_posterior_brute():
    share, theta = np.array([0.5, 0.6, 0.3, 0.2]), np.ones((4, 5, 2, 3))
    r = random.Random(1)
    for k in range(4):
        for j in range(5):
            for c in range(2):
                x = r.uniform(0.1, 0.9)
                theta[k, j, c, :2] = x, 1 - x
    for _ in range(50):
        k, v = r.randrange(4), [r.randrange(3) for _ in range(5)]
        a, b = share[k], 1 - share[k]
        for j, x in enumerate(v):
            a, b = a * theta[k, j, 1, x], b * theta[k, j, 0, x]
        assert abs(pii.posterior(np.array([k]), np.array([v]), share, theta)[0] - a / (a + b)) < 1e-9


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8)))
    rows = []
    for i in range(600):
        card = [r.randrange(10) for _ in range(15)]
        good = next(d for d in range(10) if pii.luhn("".join(map(str, [*card, d]))))
        digit = good if i % 2 else (good + 5) % 10
        planted = [f"{word()}@{word()}.com", f"{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}", "".join(map(str, [*card, digit])), f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}"]
        planted += [f"{r.randrange(100, 999)}-555-{r.randrange(1000, 9999)}", f"{word()} at {word()} dot com", f"x{r.randrange(10**9, 10**10)}y", f"{r.randrange(300, 999)}.2.3.4"]
        rows.append((i, f"{word()} {word()} {planted[i % len(planted)]} {word()}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return pii.learn(docs), rows


def test_loose_candidates_are_added_or_rejected(model):
    learned, rows = model
    added, rejected = 0, 0
    for _, text in rows:
        base, every = pii.spans(text, learned)
        assert set(base) <= set(every)
        added += len(every) - len(base)
        rejected += len(pii.candidates(text)) - len(every)
    assert added >= 100 and rejected >= 150
    assert pii.hide("write to bob at mail dot example dot com now", learned) == "write to [EMAIL] now"
    assert pii.hide("call 212-555-0147 now", learned) == "call [PHONE] now"
    for clean in ("order 1234567890123457 shipped", "version 300.2.3.4 out", "id a1234567890b", "on 2024-01-05 we met"):
        assert pii.hide(clean, learned) == clean, clean


def test_candidates_brute():
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(["1", "23", "456.7", ".", " ", "-", "(", ")", "+", "a", "at ", " dot ", "x@y.z ", "4111111111111111 ", "10.0.0.1 "]) for _ in range(14))
        found = pii.candidates(text)
        base = [x[:3] for x in found if x[3]]
        assert base == pii.base_spans(text)
        loose, last = [], -1
        for a, b, k in sorted(pii.loose_spans(text), key=lambda x: (x[0], pii.KINDS.index(x[2]))):
            if a >= last and all(b <= x or y <= a for x, y, _ in base):
                loose.append((a, b, k))
                last = b
        assert [x[:3] for x in found if not x[3]] == loose


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a at " * 60_000, "a dot " * 50_000, "+1 " * 100_000, "1:" * 150_000, "x@" * 100_000, "10.0.0.1 " * 30_000):
        pii.candidates(text)
