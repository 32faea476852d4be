"""Targets of the mix against repeated resharing, for few and many sources."""

import random
from collections import Counter

import pytest

pytest.importorskip("weftline.llm")
from weftline.llm import mixing  # noqa: E402


def brute_targets(size, weights=(5, 2, 1)):
    """Shares by weight, cut at twice the size, and the excess shared again until none is above."""
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    cut, target = set(), {}
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in cut)
        total = sum(weight[s] for s in order if s not in cut)
        target = {s: 2.0 * size[s] if s in cut else rest * weight[s] / total for s in order}
        above = {s for s in order if s not in cut and target[s] > 2 * size[s]}
        if not above:
            return target
        cut |= above


@pytest.mark.parametrize("n", [1, 4, 20, 200])
def test_targets_of_many_sources(spark, n):
    r = random.Random(n)
    names = [None if i == 0 and n > 1 else f"s{i:03}" for i in range(n)]
    rows, size = [], Counter()
    for i in range(n * 12):
        s = names[i % n] if i < n else r.choices(names, [j % 7 * j % 11 + 1 for j in range(n)])[0]
        k = r.choice([0, 1, 3, 20, 90])
        rows.append((i, " ".join(["w"] * k), s))
        size[s] += k
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = brute_targets({s: size[s] for s in {x[2] for x in rows}})
    taken = Counter()
    for x in got:
        assert abs(x["_mix_target"] - want[x["source"]]) < 1e-6 and 0 <= x["_mix_copies"] <= 2
        taken[x["source"]] += x["_mix_copies"] * x["_mix_size"]
    assert abs(sum(want.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 180 for s in want)


def test_working_names_are_free(spark):
    rows = [(i, "a b c", "s", "mine", 5, 6) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_source string, _mix_bucket long, _mix_size long")
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.count() == 12 and {x["_mix_source"] for x in out.collect()} == {"mine"} and {x["_mix_size"] for x in out.collect()} == {6}
    assert {x["_mix_size"] for x in mixing.mix(docs).collect()} == {3}
