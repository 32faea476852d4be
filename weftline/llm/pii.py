"""Personal data by weak supervision.

Base spans are what four patterns find and their checks admit. Looser patterns propose more: addresses that are spelled
out, any four numbers between dots, any run of 7 to 19 digits however it is grouped. Many of these are no personal data.
Labelers of three kinds (regular expressions, gazetteers, context) vote yes or no on each candidate, base or not, or abstain;
none of them sees which candidates are base spans. For each kind of data, expectation-maximisation over the counts of vote
patterns estimates how often each labeler says yes on data and on the rest (it starts from the belief that a candidate is
data if its check says yes and at most one other labeler no, and from the prior counts SEEN); the posteriors then train the final classifier, a logistic one over votes of each kind. A candidate that it
accepts is added where it touches no base span; base spans always stay. Counts cover all documents and there are at most
4 * 3 ** 5 of them.

Null texts count as empty: no spans. Equal texts, and repeated rows, have equal spans. Offsets are code points, ends
exclusive; candidates that begin at one place come in order of their kinds. Texts are read whole, however long. Without any
candidate the prior decides; an empty table gives no rows. find() returns its own columns alone, redact() all of docs with
their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices

KINDS = ("email", "ip", "card", "phone")
NO, YES, ABSTAIN = 0, 1, 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:[\[({<] ?at ?[\])}>]|(?<= )at(?= )) ?[A-Za-z0-9-]++(?: ?(?:[\[({<] ?dot ?[\])}>]|(?<= )dot(?= )) ?[A-Za-z0-9-]++)++", re.I)
_NUMBER = re.compile(r"(?:\+|(?<![0-9]))\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
_QUAD = re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3}(?![0-9.]*[0-9])")
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
# How data of a kind is usually written.
_FORM = {
    "email": re.compile(r"[^@ ]+@[^@ ]+"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f:]+"),
    "card": re.compile(r"[0-9]{14,19}|[0-9]{4}(?:([ -])[0-9]{4}){2,3}(?:[ -][0-9]{1,4})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"),
    "phone": re.compile(r"\+.*|00[1-9].*|\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}"),
}

# Gazetteers (fixed values): common top-level domains, calling codes, first digits of card networks, words around data.
DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es it uk us eu ch at nl be pl se no dk fi pt ru cn jp kr in br mx ar ca au nz ie example test".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 358 420 421".split())
NETWORKS = ("34", "35", "36", "37", "38", "4", "5", "6", "22", "23", "24", "25", "26", "27")
WORDS_FOR = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|login|from", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|pay", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|sms|contact", re.I),
}
WORDS_AGAINST = re.compile(r"version|release|isbn|issn|serial|order|invoice|section|fig\b|table|commit|build", re.I)
CONTEXT = 32


def luhn(digits: str) -> bool:
    d = np.frombuffer(digits.encode(), np.uint8)[::-1] - 48
    twice = d[1::2].astype(int) * 2
    return (int(d[::2].sum()) + int((twice - 9 * (twice > 9)).sum())) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    last = 0
    q = text.find("@")
    while q >= 0:  # each match has one @, and begins where the characters before it do
        s = q
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < q and (m := _DOMAIN.match(text, q + 1)):
            found.append((s, m.end(), "email"))
            last = m.end()
        q = text.find("@", q + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if 14 <= len(m[0]) <= 37 and 14 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def loose_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower() if "ot" in text or "OT" in text or "Ot" in text or "oT" in text else ""
    if "dot" in low:
        found += [(m.start(), m.end(), "email") for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = len(_NOT_DIGITS.sub("", m[0])) if m.end() - m.start() >= 7 else 0
            if 7 <= n <= 19:
                found.append((m.start(), m.end(), "card" if n > 12 else "phone"))
        found += [(m.start(), m.end(), "ip") for m in _QUAD.finditer(text)]
        if ":" in text:
            found += [(m.start(), m.end(), "ip") for m in _SIX.finditer(text)]
    return found


def _gazetteer(kind: str, span: str, digits: str) -> int:
    if kind == "email":
        return YES if re.split(r"[^A-Za-z0-9-]+", span)[-1].lower() in DOMAINS else NO
    if kind == "card":
        return YES if digits.startswith(NETWORKS) else NO
    if kind == "phone":
        d = digits.lstrip("0")
        return YES if any(d[:n] in CALLING for n in (1, 2, 3)) else ABSTAIN
    return ABSTAIN if ":" in span else NO if span.startswith(("0.", "127.")) else YES


def _check(kind: str, span: str, digits: str) -> int:
    """Whether the numbers are possible."""
    if kind == "card":
        return YES if 14 <= len(digits) <= 19 and luhn(digits) else NO
    if kind == "phone":
        return YES if 10 <= len(digits) <= 15 and len(set(digits[-7:])) > 1 else NO
    if kind == "ip":
        return YES if ":" in span or all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split(".")) else NO
    end = re.split(r"[^A-Za-z0-9-]+", span)[-1]
    return YES if len(end) > 1 and not end.isdigit() else NO


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """Check, form, gazetteer, context, edges."""
    span = text[start:end]
    digits = _NOT_DIGITS.sub("", span)
    before, around = text[max(0, start - CONTEXT) : start], text[max(0, start - 1) : start] + text[end : end + 1]
    context = NO if WORDS_AGAINST.search(before) else YES if WORDS_FOR[kind].search(before) else ABSTAIN
    form = YES if _FORM[kind].fullmatch(span) else NO
    return (_check(kind, span, digits), form, _gazetteer(kind, span, digits), context, NO if any(c.isalnum() for c in around) else YES)


LABELERS = 5
#: Votes (no, yes) of each labeler that are taken as seen beforehand, on candidates that are no data and on data.
SEEN = np.array([[[95.0, 5.0], [1.0, 99.0]], [[8.0, 4.0], [1.0, 11.0]], [[3.0, 3.0], [2.0, 4.0]], [[5.0, 1.0], [1.0, 5.0]], [[6.0, 4.0], [1.0, 9.0]]])
#: Rows of each class (no data, data) seen beforehand.
ROWS = (5.0, 5.0)


def candidates(text: str | None) -> list[tuple[int, int, str, bool, tuple[int, ...]]]:
    """Base spans, and loose ones that touch none of them and no earlier loose one."""
    if not text:
        return []
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    begins, reach = [a for a, _ in taken], []
    for _, b in taken:
        reach.append(max(b, reach[-1]) if reach else b)
    loose = []
    last = -1
    for a, b, kind in sorted(loose_spans(text), key=lambda x: (x[0], KINDS.index(x[2]))):
        before = bisect_left(begins, b)  # base spans that begin before the end
        if a >= last and not (before and reach[before - 1] > a):
            loose.append((a, b, kind))
            last = b
    return [(*x, True, votes(text, *x)) for x in base] + [(*x, False, votes(text, *x)) for x in loose]


def pattern(kind: str, v: tuple[int, ...]) -> int:
    return KINDS.index(kind) * 3**LABELERS + sum(x * 3**j for j, x in enumerate(v))


def _unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and votes."""
    return codes // 3**LABELERS, codes[:, None] // 3 ** np.arange(LABELERS) % 3


def em(kinds: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Share of data of each kind, and P(vote | kind, labeler, data or not) where a labeler votes."""
    p = np.where((v[:, 0] == YES) & ((v == NO).sum(1) < 2), 0.9, 0.1)
    share, theta = np.full(len(KINDS), 0.5), np.ones((len(KINDS), LABELERS, 2, 3))
    for _ in range(rounds):
        before = theta.copy()
        for k in range(len(KINDS)):
            here = kinds == k
            for c, w in ((0, (n * (1 - p))[here]), (1, (n * p)[here])):
                for x in (NO, YES):
                    theta[k, :, c, x] = (w[:, None] * (v[here] == x)).sum(0) + SEEN[:, c, x]
            share[k] = ((n * p)[here].sum() + ROWS[1]) / (n[here].sum() + sum(ROWS))
        theta[..., :2] /= theta[..., :2].sum(-1, keepdims=True)
        p = posterior(kinds, v, share, theta)
        if np.abs(theta - before).max() < 1e-9:
            break
    return share, theta


def posterior(kinds: np.ndarray, v: np.ndarray, share: np.ndarray, theta: np.ndarray) -> np.ndarray:
    j = np.arange(LABELERS)
    each = np.log(theta[kinds[:, None], j, 1, v]) - np.log(theta[kinds[:, None], j, 0, v])
    return _sigmoid(np.log(share[kinds] / (1 - share[kinds])) + each.sum(1))


def fit(counts: dict[int, int], steps: int = 25) -> dict:
    """EM for the labelers' reliabilities, then weights of the classifier by Newton steps on the posteriors."""
    every = np.arange(len(KINDS) * 3**LABELERS)
    n = np.zeros(len(every))
    n[np.array(list(counts), np.int64).reshape(-1)] = list(counts.values())
    kinds, v = _unpack(every)
    seen = n > 0
    share, theta = em(kinds[seen], v[seen], n[seen])
    x, goal = _inputs(kinds, v), posterior(kinds, v, share, theta)
    weight = n / max(1.0, n.sum()) + 1e-5  # patterns that no text has count a little
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = _sigmoid(x @ w)
        slope = x.T @ (weight * (q - goal)) + 1e-7 * w
        w -= np.linalg.solve((x * (weight * np.maximum(q * (1 - q), 1e-3))[:, None]).T @ x + 1e-6 * np.eye(len(w)), slope)
    return {"share": share, "theta": theta, "weights": w}


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _inputs(kinds: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each kind: one, and each labeler's yes and no."""
    x = np.zeros((len(kinds), len(KINDS), 1 + 2 * LABELERS))
    at = np.arange(len(kinds))
    x[at, kinds, 0] = 1
    x[at, kinds, 1 : 1 + LABELERS], x[at, kinds, 1 + LABELERS :] = v == YES, v == NO
    return x.reshape(len(kinds), -1)


def accepted(codes: list[int], model: dict) -> np.ndarray:
    kinds, v = _unpack(np.array(codes, np.int64).reshape(-1))
    return _sigmoid(_inputs(kinds, v) @ model["weights"]) >= 0.5


def spans(text: str | None, model: dict) -> tuple[list, list]:
    """Base spans and all spans, each by start and kind."""
    found = candidates(text)
    if not found:
        return [], []
    yes = accepted([pattern(k, v) for _, _, k, _, v in found], model)
    base = [x[:3] for x in found if x[3]]
    both = base + [x[:3] for x, y in zip(found, yes, strict=True) if y and not x[3]]
    return base, sorted(both, key=lambda x: (x[0], KINDS.index(x[2])))


def learn(docs: DataFrame) -> dict:
    """The model from the candidates of all rows."""

    def run(cols):
        return {"code": [pattern(k, v) for t in cols["text"] for _, _, k, _, v in candidates(t)]}

    counted = map_rows(docs.select("text"), run, "code int").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return fit({r["code"]: r["n"] for r in counted.collect()})


def written(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row."""
    model = learn(docs)

    def run(cols):
        done = [spans(t, model) for t in cols["text"]]
        out = {f"n_{k}": [sum(x[2] == k for x in base) for base, _ in done] for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in done]
        return out | {"doc_id": cols["doc_id"], "spans": [written(x) for _, x in done]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def hide(text: str | None, model: dict) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in spans(text, model)[1]:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; n_chars, if there, is of the new text."""
    model = learn(docs)
    text = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                cols = list(part.columns)
                new = [hide(t, model) for t in part.column(text).to_pylist()]
                cols[text] = pa.array(new, part.schema.field(text).type)
                if chars is not None:
                    cols[chars] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(part.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
