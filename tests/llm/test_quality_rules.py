"""The posterior of quality: reliabilities that EM recovers, single bad votes, length, labels."""

import random

import numpy as np
import pytest

pytest.importorskip("weftline.llm")
from weftline.llm import quality_rules as q  # noqa: E402

K = len(q.RULES)


def simulated(n, good, wrong_on_good, right_on_bad, votes=0.9, seed=1):
    r = np.random.default_rng(seed)
    truth = r.random(n) < good
    bad_vote = np.where(truth[:, None], r.random((n, K)) < wrong_on_good, r.random((n, K)) < right_on_bad)
    v = np.where(r.random((n, K)) < votes, np.where(bad_vote, q.BAD, q.GOOD), q.ABSTAIN)
    return truth, v


def counted(v):
    codes, n = np.unique(v @ 3 ** np.arange(K), return_counts=True)
    return dict(zip(codes.tolist(), n.tolist(), strict=True))


def test_em_recovers_reliabilities_and_single_bad_votes_do_not_decide():
    wrong, right = np.linspace(0.02, 0.2, K), np.linspace(0.9, 0.5, K)
    truth, v = simulated(40_000, 0.8, wrong, right)
    model = q.fit(counted(v))
    assert abs(model["prior"] - 0.8) < 0.02
    assert np.abs(model["theta"][:, 1, q.BAD] - wrong).max() < 0.02 and np.abs(model["theta"][:, 0, q.BAD] - right).max() < 0.05
    kept = q.posterior(v, model["prior"], model["theta"]) >= 0.5
    assert (kept == truth).mean() > 0.98
    one = (v == q.BAD).sum(1) == 1
    assert kept[one].mean() > 0.9  # all-must-pass would reject them all
    must_pass = ~(v == q.BAD).any(1)
    assert (kept == truth).mean() > (must_pass == truth).mean() + 0.1


def test_brute_posterior():
    truth, v = simulated(500, 0.7, 0.1, 0.7, seed=3)
    model = q.fit(counted(v))
    for row, p in zip(v[:50].tolist(), q.posterior(v[:50], model["prior"], model["theta"]), strict=True):
        good, bad = model["prior"], 1 - model["prior"]
        for j, x in enumerate(row):
            good, bad = good * model["theta"][j, 1, x], bad * model["theta"][j, 0, x]
        assert abs(p - good / (good + bad)) < 1e-9


def test_long_clean_text_is_kept(spark):
    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("an", "be", "ku", "lo", "mi") for b in ("ra", "to", "se") for c in ("n", "r", "st", "mos", "ve")]
    line = lambda n: " ".join(r.choices(words, k=n)) + "."
    rows = [(i, line(r.randint(40, 120))) for i in range(300)] + [(1000, "\n".join(line(40) for _ in range(3000)))]
    rows += [(2000 + i, "SALE!! $$$ 99 %%% | " * r.randint(10, 30) + line(60 + i)) for i in range(40)]
    got = {x["doc_id"]: x["kept"] for x in q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] for i in range(300)) and got[1000] and not any(got[2000 + i] for i in range(40))


def test_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id").quality
    judged = q.judge(spark.read.parquet(f"{d}/documents.parquet")).where("not base_failed").select("doc_id", "kept").toPandas()
    judged = judged[judged.doc_id.isin(labels.index)]
    good = labels.loc[judged.doc_id].to_numpy() == 1
    kept = judged.kept.to_numpy()
    assert kept[good].mean() > 0.98 and kept[~good].mean() < 0.1
