"""The training-data operators against brute force, and on nulls, empty texts, long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("weftline.llm")
from weftline.llm import byte_bpe, language_id, lm_score, media, mixing, pii, quality_rules, queries, sharding, simhash, suffix_dedup  # noqa: E402

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, votes int, unit long, rid long, at string, h long"
LONG = "word and other words here. " * 9000


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = ["the", "of", "Größe", "señal", "x", "and", "data pipe", "línea", "zz", "house", "tree"]
    texts = [None, "", " \t\n", "a", "é", "same text here", "same text here", LONG, "mail bob@x.org or +1 (555) 123-4567 card 4111 1111 1111 1111 ip 10.0.0.1"]
    base = " ".join(r.choices(vocabulary, k=120))
    texts += [base, base, base + " end", base.replace("house", "home", 1), "intro " + base[:400] + " outro", "# * $ % &\n" * 30, "A B C\n" * 40]
    texts += [" ".join(r.choices(vocabulary, k=r.randint(1, 80))) for _ in range(40)]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][i % 4 if i % 7 else 0], i, 1, 2, 3, 4, "x", 5) for i, t in enumerate(texts)]
    return [*out, out[9], (None, "null id text of some words", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_quality_brute(docs, rows, none):
    def want(i, t):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        win = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        n = Counter(win)
        rep = {k for j, x in enumerate(win) if n[x] > 1 for k in range(j, j + 8)}
        return i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)

    got = quality_rules.judge(docs)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_id(got, *cols) == sorted((want(r[0], r[1]) for r in rows), key=str)
    assert not [r for r in got.collect() if r["base_failed"] and r["kept"]]
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got.where("kept").collect())
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_quality_em_ranks_rules():
    good, bad = quality_rules.vote_pattern(quality_rules.features("plain words of some length here " * 1 + " ".join("word" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(60)))), quality_rules.vote_pattern(quality_rules.features("BUY!! NOW!! " * 40))
    model = quality_rules.fit({good: 90, bad: 10})
    votes = np.array([good, bad])[:, None] // 3 ** np.arange(len(quality_rules.RULES)) % 3
    p = quality_rules.posterior(votes, model["prior"], model["theta"])
    assert p[0] > 0.9 and p[1] < 0.1
    assert quality_rules.fit({})["theta"].shape == (len(quality_rules.RULES), 2, 3)


def test_bpe_like_tiktoken(docs, rows, none):
    import public_tokenizers as P
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(open(queries.RANKS, "rb").read()), special_tokens={})
    got = byte_bpe.digests(docs, queries.RANKS, P.PATTERN)
    want = []
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r[1] or "").encode())))
    assert by_id(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    encoded = byte_bpe.encode(docs, queries.RANKS, P.PATTERN)
    back = byte_bpe.decode(encoded, queries.RANKS, P.PATTERN)
    for r in back.collect():
        assert r["decoded"] == (r["text"] or "")
        assert all(0 <= a < b <= len(r["text"]) for a, b in zip(r["token_starts"], r["token_ends"]))
    assert byte_bpe.encode(none, queries.RANKS, P.PATTERN).count() == 0
    bpe = byte_bpe.ByteBPE(open(queries.RANKS, "rb").read(), P.PATTERN)
    (ids,) = bpe.encode_batch(["a 🙂 b"])
    assert "".join(bpe.decode_stream(ids)) == "a 🙂 b" and list(bpe.decode_stream(ids[:2]))[-1] is not None


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        assert r["_mix_size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["_mix_copies"] <= 2
        taken[r["source"]] += r["_mix_copies"] * r["_mix_size"]
        size[r["source"]] += r["_mix_size"]
        target[r["source"]] = r["_mix_target"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(target[s] <= 2 * size[s] for s in size)
    longest = max(r["_mix_size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= longest for s in size)
    assert mixing.mix(none).count() == 0
    assert mixing.emit(docs).count() == sum(r["_mix_copies"] for r in got)


def test_sharding(docs, rows, none):
    got = sharding.assign(docs, shards=5).collect()
    n = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n[s]))
    want = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    same = [r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"same text here")]
    assert len(set(same)) == 1
    assert sharding.assign(none, shards=5).count() == 0
    give, begin, upto = sharding.fill_plan([(0, 1, 3), (2, 1, 1), (1, 0, 1)], 3)
    assert (give, begin, upto) == ([0, 3, 0], [0, 0, 3], [2, 2, 3])


def test_sharding_swaps_where_all_texts_are_copies(spark):
    texts = [f"text {i // 2}" for i in range(400)]
    got = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=4).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {100}
    where = {r["doc_id"]: r["shard"] for r in got}
    assert sum(where[i] != where[i + 1] for i in range(0, 400, 2)) <= 8


def test_sharding_keeps_a_group_of_most_of_a_shard_together(spark):
    texts = ["one group"] * 80 + [f"text {i}" for i in range(320)]
    got = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=4).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {100}
    assert len({r["shard"] for r in got if r["doc_id"] < 80}) == 1


def test_admitted_moves_keep_counts():
    assert sharding.admit([(0, 1, 5), (1, 0, 3)], [0, 0]) == [(0, 1, 3), (1, 0, 3)]
    assert sharding.admit([(0, 1, 5)], [0, 2]) == [(0, 1, 2)]
    assert sharding.admit([(0, 2, 5), (1, 2, 5), (2, 0, 5)], [0, 0, 0]) == [(0, 2, 5), (2, 0, 5)]
    r = random.Random(1)
    wanted = [(a, b, r.randint(1, 9)) for a in range(6) for b in range(6) if a != b]
    free = [r.randint(0, 4) for _ in range(6)]
    moves = sharding.admit(wanted, free)
    for s in range(6):
        assert sum(n for _, b, n in moves if b == s) - sum(n for a, _, n in moves if a == s) <= free[s]


def test_language(spark, none):
    r = random.Random(1)
    words = {"en": "the house and with this that water", "de": "das haus und mit dieses wasser über", "fr": "la maison et avec cette eau où"}
    data = [(i, " ".join(r.choices(words[l].split(), k=30)), l) for i, l in enumerate(r.choices(list(words), k=300))]
    data += [(900, None, "en"), (901, "", "en"), (902, "123 !?", "de"), (903, "a", None), (904, "the water " * 60000, "en")]
    got = language_id.held_out_predictions(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    lang = {i: x for i, _, x in data}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert {r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.held_out_predictions(none).count() == 0


def brute_fingerprint(t, k=3):
    import xxhash

    w = [x.encode() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, rows, none):
    got = simhash.classify(docs)
    fp = {r[0]: brute_fingerprint(r[1]) for r in rows if r[0] is not None}
    parent = {i: i for i in fp}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fp:
        for j in fp:
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = sorted(((i, f"{fp[i]:016x}", root(i)) for i in [r[0] for r in rows if r[0] is not None]), key=str)
    assert by_id(got.where("doc_id is not null"), "doc_id", "fingerprint", "component_id") == want
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns
    assert one.count() == len({r["component_id"] for r in got.collect()})
    assert simhash.classify(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_keep_one_tells_components_of_null_and_repeated_ids_apart(spark):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcd"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_one(docs).collect()) == texts


@pytest.mark.parametrize("often", [1, 3])
def test_similar_sets_brute(spark, monkeypatch, often):
    """All groups by five-word Jaccard of 0.8, among near copies of which most are over two bits apart."""
    monkeypatch.setattr(simhash, "OFTEN", often)
    r = random.Random(8)
    texts = [None, "", "  ", "a b", "A  b", "a b c"]
    for _ in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(20, 200))]
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 4, 5, 6):
            copy = base[:]
            for i in r.sample(range(len(copy)), edits):
                copy[i] = f"w{r.randrange(3000)}"
            texts.append(" ".join(copy))
    words = [(t or "").lower().split() for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    assert sum((simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[j], 5)).bit_count() > 2 for i, j in linked) > 20
    for i, j in linked:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = simhash.keep_one(docs, words_each=5, similarity=0.8)
    assert sorted(x["doc_id"] for x in got.collect()) == [i for i in range(len(texts)) if root(i) == i]
    assert simhash.keep_one(docs.limit(0), words_each=5, similarity=0.8).count() == 0


def test_simhash_links(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    all_ = {x ^ sum(1 << b for b in r.sample(range(64), k)) for x in base for k in (0, 1, 2, 2, 3, 4)}
    signed = [x - (1 << 64) if x >> 63 else x for x in all_]
    got = {(x["a"], x["b"]) for x in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101)]
    got = {r["v"]: r["c"] for r in simhash.connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_media(docs, rows, none):
    got = {str(r["doc_id"]) + (r["payload_sha256"][:4]): r for r in media.digests(docs).collect()}
    for r in rows:
        b = (r[1] or "").encode()
        padded = b + b" " * (-len(b) % 192 if b else 192)
        x = got[str(r[0]) + sha(padded)[:4]]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(b), len(padded), sha(padded), zlib.crc32(padded[-16:]))
        assert x["media_sha256"] == sha(media.wrap(b)) and x["media_bytes"] == len(media.wrap(b))
    assert media.digests(none).count() == 0
    assert media.describe(media.store(docs)).where("bad > 0 or skipped > 0").count() == 0


def test_media_resynchronises():
    s = media.wrap(b"x" * 1000)
    found = media.probe(s)
    assert found["samples"] == 6 * 1152 and found["table"]["frames"] == 6 and found["bad"] == 0 and found["tags"] == {"stored_bytes": "1000"}
    at = found["offsets"][3]
    broken = media.probe(s[:at] + b"\xff\xfb junk \xff" + s[at:])
    assert len(broken["offsets"]) == 6 and broken["skipped"] == 9
    bad = bytearray(s)
    bad[at + 8] ^= 1  # a byte that the checksum covers
    assert media.probe(bytes(bad))["bad"] == 1
    assert len(media.probe(s[:-10])["offsets"]) == 5
    assert media.probe(None)["offsets"] == [] and media.probe(b"\xff" * 50)["offsets"] == []
    h = media.header(bytes([0xFF, 0xFB, 0x90, 0x64]))
    assert (h["kbits"], h["hz"], h["size"], h["samples"]) == (128, 44100, 417, 1152)


def test_lm(docs, rows, none):
    held = language_id.remainder(docs["doc_id"], 5) == 1
    import public_tokenizers as P

    got = lm_score.scores(docs, held, queries.RANKS, P.PATTERN).collect()
    lower = lambda t: [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for r in rows if not out(r[0]) for w in lower(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], out(r[0]), len(lower(r[1])), sum(c[w] > 0 for w in lower(r[1])), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in lower(r[1])), 3)) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got), key=str) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_score.scores(none, language_id.remainder(none["doc_id"], 5) == 1, queries.RANKS, P.PATTERN).count() == 0


def brute_repeats(data, length=200):
    n = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [None, 1])
def test_suffix_dedup(docs, rows, none, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(suffix_dedup.repeats, "__defaults__", (hot, suffix_dedup.BITS))
    rows = [r if r[1] != LONG else (*r[:1], LONG[:3000], *r[2:]) for r in rows]
    docs = docs.sparkSession.createDataFrame(rows, SCHEMA)
    data = [(r[1] or "").encode() for r in rows]
    want = []
    for r, b, gone in zip(rows, data, brute_repeats(data)):
        want.append((r[0], len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    assert by_id(suffix_dedup.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
    if not hot:
        assert suffix_dedup.digests(none).count() == 0


def test_transform_brute():
    r = random.Random(2)
    for _ in range(60):
        length, letters = r.choice([3, 5, 8]), r.choice([b"ab", b"abc", bytes(range(256))])
        base = bytes(r.choices(letters, k=60))
        parts = [base[r.randint(0, 20) : r.randint(30, 60)] + bytes(r.choices(letters, k=3)) for _ in range(r.randint(2, 7))]
        n = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        assert [list(x) for x in suffix_dedup.twice(parts, length)] == [[n[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] for p in parts]


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)] + [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_pii(docs, rows, none):
    got = pii.find(docs).collect()
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in got), key=str) == sorted(((r[0], sha(brute_pii(r[1] or "").encode())) for r in rows), key=str)
    for r in got:
        assert sum(r[f"n_{k}"] for k in pii.KINDS) <= (r["spans"].count(":") // 2)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[8] == "mail [EMAIL] or [PHONE] card [CARD] ip [IP]" and clean[0] is None
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0
    r = random.Random(4)
    for _ in range(4000):
        x = "".join(r.choice("a1@.+-( )_23.4@b %") for _ in range(40))
        assert brute_pii(x) == pii.written(pii.base_spans(x))
