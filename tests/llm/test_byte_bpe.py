"""Bytes through the reversed byte table, offsets of split characters, any order of ids."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("weftline.llm")
import public_tokenizers as P  # noqa: E402
import tiktoken  # noqa: E402

from weftline.llm import byte_bpe, queries  # noqa: E402


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE(open(queries.RANKS, "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(open(queries.RANKS, "rb").read()), special_tokens={})


def test_any_ids_decode_like_tiktoken(bpe, other):
    r, known = random.Random(1), sorted(bpe.table)
    for _ in range(300):
        ids = r.choices(known, k=r.randint(0, 40))
        assert bpe.decode_bytes(ids) == other.decode_bytes(ids)
        assert bpe.decode(ids) == "".join(bpe.decode_stream(ids)) == other.decode_bytes(ids).decode("utf-8", "replace")
    assert sorted(bpe.byte_of[[ord(c) for c in byte_bpe.byte_characters()]].tolist()) == list(range(256))


def test_texts_and_offsets(bpe, other):
    r = random.Random(2)
    alphabet = "ab c\n.1é🙂👩‍👩‍👧ßñ中文字́\t🇩🇪"
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(400)] + ["word " * 30_000, ""]
    for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
        assert ids.tolist() == other.encode_ordinary(text)
        starts, ends = bpe.offsets(text, ids) if len(ids) else (np.zeros(0), np.zeros(0))
        at = 0
        for i, a, b in list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True))[:200]:
            size = len(bpe.table[i])
            head = text.encode()[: at + size]
            assert a == len(text.encode()[:at].decode("utf-8", "ignore")) and b == len((head + b"").decode("utf-8", "ignore")) + (head.decode("utf-8", "ignore").encode() != head)
            at += size


def test_digests_keep_columns(spark):
    rows = [(1, "a é 🙂", "s", 1.5), (2, None, None, None), (2, "", "t", 2.0)]
    got = byte_bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, source string, ids_sha string".replace("ids_sha string", "n double")), queries.RANKS, P.PATTERN, keep=("source", "n"))
    assert got.columns == ["doc_id", "source", "n", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "round_trip"]
    out = got.collect()
    assert all(x["round_trip"] for x in out) and sorted(x["decoded_sha256"] for x in out) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _, _ in rows)
