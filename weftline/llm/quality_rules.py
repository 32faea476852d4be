"""Weak supervision for document quality.

Rules vote good, bad or abstain; expectation-maximisation estimates, for each rule, how often it votes so on
good and on bad documents; the posterior probability of "good" decides, instead of all rules having to pass.

The classes are told apart by where EM starts (a row with a bad vote is believed bad, at odds of 19 to 1) and by a prior
of counts for each rule, SEEN: of 100 good rows a rule has voted bad on one, of 5 bad rows on three. Both are small beside
any corpus, so votes alone decide how often a rule is wrong; nothing keeps a rule from outvoting another.

Only counts of vote patterns reach the driver: at most 3 ** len(RULES) rows, whatever the input. Null or empty texts have
no words and fail the base rule. Equal and repeated rows get equal verdicts, and a posterior at the threshold is kept. Texts
are read whole, however long: shares are over words, lines or characters, and the vocabulary is a mean over windows of
words. An empty table gives no rows; keep_good keeps all columns of docs, whatever their names, and judge has only its own.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, slices

BAD, GOOD, ABSTAIN = 0, 1, 2
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
LETTERS = bytes([*range(65, 91), *range(97, 123)])
NOT_LETTERS = bytes(sorted(set(range(256)) - set(LETTERS) - set(range(0xC0, 0x100))))
NOT_CAPITALS = bytes(sorted(set(range(256)) - set(range(65, 91))))
NOT_SMALL = bytes(sorted(set(range(256)) - set(range(97, 123))))
#: Votes (bad, good) of a rule that are taken as seen beforehand on bad rows and on good rows.
SEEN = ((3.0, 2.0), (1.0, 99.0))
#: Words in a window of the vocabulary rule, and the fewest in a last one that counts.
VOCABULARY, LAST = 100, 50
_PLAIN = re.compile(rb"(?<![^\x20\x09-\x0d])[A-Za-z\x80-\xff]+[.,;:!?]{0,2}(?![^\x20\x09-\x0d])")
_R = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeat_words(words: list[bytes], w: int = WINDOW) -> int:
    """Words that lie in w-word windows found twice or more."""
    n = len(words)
    if n <= w:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, n)
    if len(ids) == n:
        return 0
    a = (a + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(29)
    m = n - w + 1
    h = np.zeros(m, np.uint64)
    for j in range(w):
        h += a[j : j + m] * _R[j % WINDOW] * np.uint64(2 * (j // WINDOW) + 1)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():  # equal windows have equal hashes
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(twice).tolist():  # the words themselves decide
        seen.setdefault(tuple(words[i : i + w]), []).append(i)
    d = np.zeros(n + 1, np.int32)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                d[i] += 1
                d[i + w] -= 1
    return int((np.cumsum(d[:-1]) > 0).sum())


def vocabulary(words: list[bytes]) -> float:
    """Mean share of different words in windows; 1 where the text has no window."""
    shares = [len(set(w)) / len(w) for i in range(0, len(words), VOCABULARY) if len(w := words[i : i + VOCABULARY]) >= LAST]
    return sum(shares) / len(shares) if shares else 1.0


def features(text: str | None) -> dict[str, float]:
    text = text or ""
    b = text.encode()
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c"),
        "n_symbols": len(b) - len(b.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
        "n_lines": len(lines),
        "n_letters": len(b.translate(None, NOT_LETTERS)),
        "n_capitals": len(b.translate(None, NOT_CAPITALS)),
        "n_small": len(b.translate(None, NOT_SMALL)),
        "n_shouts": b.count(b"!"),
        "n_plain": sum(1 for _ in _PLAIN.finditer(b)),
        "vocabulary": vocabulary(words),
    }


def _above(x: float, good: float, bad: float) -> int:
    return BAD if x > bad else GOOD if x <= good else ABSTAIN


#: Each rule gives BAD, GOOD or ABSTAIN for the features of a text with words.
RULES = {
    "length": lambda f: BAD if f["n_words"] < 5 else GOOD if f["n_words"] >= 50 else ABSTAIN,
    "repetition": lambda f: _above(f["n_repeat_words"] / f["n_words"], 0.1, 0.3),
    "symbols": lambda f: _above(f["n_symbols"] / f["n_words"], 0.02, 0.2),
    "duplicate_lines": lambda f: _above(f["n_dup_lines"] / max(1, f["n_lines"]), 0.15, 0.35),
    "word_length": lambda f: BAD if not 3 <= f["word_chars"] / f["n_words"] <= 12 else ABSTAIN,
    "letters": lambda f: _above(-f["n_letters"] / f["word_chars"], -0.8, -0.6),
    "capitals": lambda f: _above(f["n_capitals"] / max(1, f["n_capitals"] + f["n_small"]), 0.2, 0.6),
    "shouting": lambda f: _above(f["n_shouts"] / f["n_words"], 0.05, 0.3),
    "vocabulary": lambda f: ABSTAIN if f["n_words"] < LAST else _above(-f["vocabulary"], -0.45, -0.25),
    "plain_words": lambda f: _above(-f["n_plain"] / f["n_words"], -0.95, -0.8),
}


def vote_pattern(f: dict[str, int]) -> int:
    """The rules' votes as digits to base 3; all abstain where there is no word."""
    if not f["n_words"]:
        return 3 ** len(RULES) - 1
    return sum(rule(f) * 3**j for j, rule in enumerate(RULES.values()))


def base_failed(f: dict[str, int]) -> bool:
    return f["n_words"] < MIN_WORDS or 100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"]


def fit(patterns: dict[int, int], rounds: int = 200) -> dict:
    """EM over counted vote patterns. Returns the prior of good and P(vote | class) of each rule where it votes. An empty
    table gives the prior's counts alone."""
    k = len(RULES)
    n = np.array(list(patterns.values()), float)
    codes = np.array(list(patterns), np.int64)
    votes = (codes[:, None] // 3 ** np.arange(k)) % 3 if len(codes) else np.zeros((0, k), np.int64)
    pseudo = np.array(SEEN)
    p = np.where((votes == BAD).any(1), 0.05, 0.95)
    theta = np.ones((k, 2, 3))  # an abstention says nothing of the class
    for _ in range(rounds):
        new = np.ones_like(theta)
        for c, weight in ((0, n * (1 - p)), (1, n * p)):
            for v in (BAD, GOOD):
                new[:, c, v] = (weight[:, None] * (votes == v)).sum(0) + pseudo[c, v]
        new[:, :, :2] /= new[:, :, :2].sum(2, keepdims=True)
        prior = float(np.clip(((n * p).sum() + 0.85) / (n.sum() + 1), 0.01, 0.99))
        moved = np.abs(new - theta).max()
        theta = new
        p = posterior(votes, prior, theta)
        if moved < 1e-9:
            break
    return {"prior": prior, "theta": theta}


def posterior(votes: np.ndarray, prior: float, theta: np.ndarray) -> np.ndarray:
    j = np.arange(theta.shape[0])
    odds = math.log(prior / (1 - prior)) + (np.log(theta[j, 1, votes]) - np.log(theta[j, 0, votes])).sum(-1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def probability(pattern, model: dict):
    """Posterior of good as a Column of the vote pattern."""
    w = np.log(model["theta"][:, 1]) - np.log(model["theta"][:, 0])
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for j in range(len(RULES)):
        digit = F.floor(pattern / F.lit(3**j)) % 3
        odds = odds + F.when(digit == 0, float(w[j, 0])).when(digit == 1, float(w[j, 1])).otherwise(float(w[j, 2]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes int"


def _score(cols: dict) -> dict:
    f = [features(t) for t in cols["text"]]
    return {"doc_id": cols["doc_id"], "votes": [vote_pattern(x) for x in f], "base_failed": [base_failed(x) for x in f]} | {
        k: [x[k] for x in f] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    }


def count_patterns(scored: DataFrame) -> dict[int, int]:
    return {r["votes"]: r["n"] for r in scored.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Features, votes, probability of good and verdict of each row (doc_id, text) of docs; other columns are left out."""
    scored, _ = materialize(map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _score, _OUT), "quality")
    model = fit(count_patterns(scored))
    p = probability(F.col("votes"), model)
    return scored.withColumn("quality", p).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Texts are scored twice rather than shuffled."""
    scored = map_rows(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), _score, _OUT).select("votes")
    model = fit(count_patterns(scored))
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                f = [features(t) for t in part.column(text).to_pylist()]
                votes = np.array([vote_pattern(x) for x in f], np.int64).reshape(-1, 1) // 3 ** np.arange(len(RULES)) % 3
                good = posterior(votes, model["prior"], model["theta"]) >= threshold
                yield part.filter(pa.array([bool(g) and not base_failed(x) for g, x in zip(good, f, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
