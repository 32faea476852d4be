"""The pipeline on documents of many sources: rows remain, and every stage's decisions take effect."""

import hashlib
import random
import re
from collections import Counter

import pytest

pytest.importorskip("weftline.llm")
import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label long, _mix_size long"


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9))) for _ in range(3000)]
    line = lambda n: " ".join(r.choices(words, k=n))
    rows = [(i, line(r.randint(30, 200)) + (" bob@mail.example.com" if i % 10 == 0 else ""), "en", f"s{i % 20:02}", i, 1, 2) for i in range(200)]
    rows += [(300 + i, rows[i][1], "en", "s01", 0, 1, 2) for i in range(30)]  # copies
    rows += [(400 + i, rows[i + 50][1] + " more", "en", None, 0, 1, 2) for i in range(20)]  # near copies
    rows += [(500, None, None, None, None, None, None), (501, "", None, None, None, None, None), (502, "word " * 400, "en", "s02", 0, 1, 2)]
    rows += [(None, line(80), "en", "s03", 0, 1, 2), (None, line(90), "en", "s03", 0, 1, 2), (None, line(100), None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    steps = {}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{len(steps)}")
        docs = spark.read.parquet(f"{path}/{len(steps)}")
        steps[name] = (docs.columns, docs.collect())
    return rows, path, steps


def test_stages(found):
    rows, _, steps = found
    assert list(steps) == ["quality rules", "near duplicates", "personal data", "mixing", "tokens"]
    for name in list(steps)[:-1]:
        assert ", ".join(steps[name][0]) == "doc_id, text, lang, source, n_chars, label, _mix_size"
    good = steps["quality rules"][1]
    assert {x["doc_id"] for x in good} == {r[0] for r in rows} - {500, 501, 502} and len(good) == len(rows) - 3
    one = steps["near duplicates"][1]
    assert Counter(x["doc_id"] for x in one) == Counter([*range(200), None, None, None])
    hidden = {x["doc_id"]: x["text"] for x in steps["personal data"][1]}
    assert all(hidden[i].endswith("[EMAIL]") for i in range(0, 200, 10)) and hidden[1] == rows[1][1]
    size = lambda t: len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    total, taken = sum(size(x["text"]) for x in steps["personal data"][1]), sum(size(x["text"]) for x in steps["mixing"][1])
    assert abs(taken - 1.5 * total) < 0.1 * total and max(Counter((x["doc_id"], x["text"]) for x in steps["mixing"][1]).values()) <= 2


def test_run_gives_the_last_stage(spark, found):
    rows, path, steps = found
    got = corpus_pipeline.run(spark, path).collect()
    assert len(got) == len(steps["mixing"][1]) > len(rows) // 2 and all(x["round_trip"] for x in got)
    want = Counter(hashlib.sha256(x["text"].encode()).hexdigest() for x in steps["mixing"][1])
    assert Counter(x["decoded_sha256"] for x in got) == want


def test_driver_tables_give_rows(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
