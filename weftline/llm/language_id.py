"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of two and three lower-cased characters, with one space before and after the text, are hashed to BUCKETS
numbers. Their counts for each language are summed up over all training rows; the table of log probabilities is
BUCKETS times the number of languages, whatever the input, and goes to the executors as a broadcast: 256 KB for a
language, and no more than LARGEST languages. Texts are scored in batches: the sparse counts of a batch, as cells of text
and bucket, meet the table in one product.

A null text, or one without a letter, is `und` with score 0, and so is every text where nothing was learned. Rows with
null lang are not learned from. Ties go to the language that sorts first. Repeated rows count as often as they occur.
Texts are read whole, long ones in parts that overlap. An empty table gives no rows. identify() keeps the columns of docs
but for `lang_pred` and `score`, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices

BUCKETS, PART, UNKNOWN = 1 << 15, 1 << 18, "und"
#: Languages that a task sums up before it passes its counts on.
HELD = 64
#: Languages whose table is broadcast (1 GB), and n-grams in one product.
LARGEST, PRODUCT = 4096, 1 << 20
_LETTER = regex.compile(r"\p{L}")
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def buckets(text: str):
    """Hashes of all n-grams, in arrays of bounded size."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
    for i in range(0, len(c), PART):
        x = c[i : i + PART + 2]
        two = (x[:-1] * _A + x[1:]) * _B
        last = len(x) <= PART + 1
        first = two if last else two[:PART]
        yield (first ^ (first >> np.uint32(15))) & np.uint32(BUCKETS - 1)
        if len(x) > 2:
            three = (two[:-1] ^ (x[2:] * np.uint32(0xC2B2AE3D))) * _A
            yield (three >> np.uint32(17)) & np.uint32(BUCKETS - 1)
        if last:
            break


def count(train: DataFrame) -> DataFrame:
    """(lang, bucket, n) over rows (text, lang); bucket -1 counts the rows."""

    def run(batches):
        kinds = [pa.string(), pa.int32(), pa.int64()]

        def out(sums):
            for lang, (rows, n) in sums.items():
                at = np.flatnonzero(n)
                cols = [pa.array([lang] * (len(at) + 1), kinds[0]), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(n[at], rows))]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "bucket", "n"])

        sums: dict[str, list] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or lang is None or not _LETTER.search(text):
                    continue
                if lang not in sums and len(sums) >= HELD:
                    yield from out(sums)
                    sums = {}
                s = sums.setdefault(lang, [0, np.zeros(BUCKETS, np.int64)])
                s[0] += 1
                for x in buckets(text):
                    s[1] += np.bincount(x, minlength=BUCKETS)
        yield from out(sums)

    done = train.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    return done.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, smoothing: float = 0.1) -> dict:
    """Languages, log priors and log probabilities (bucket, language)."""
    table = count(train).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if len(langs) > LARGEST:
        raise ValueError(f"{len(langs)} languages: the table of log probabilities would not fit a broadcast")
    at = {x: i for i, x in enumerate(langs)}
    n, rows = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    col = np.array([at[x] for x in table.column("lang").to_pylist()], np.int64)
    bucket, number = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    real = bucket >= 0
    n[bucket[real], col[real]] = number[real]
    rows[col[~real]] = number[~real]
    n += smoothing
    return {"langs": langs, "prior": np.log(rows / max(1.0, rows.sum())), "table": np.log(n / n.sum(0, keepdims=True)) if langs else n}


def score_batch(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """Language and its probability for each text."""
    known = np.array([bool(t and model["langs"] and _LETTER.search(t)) for t in texts], bool)
    logs = np.tile(model["prior"], (len(texts), 1)) if model["langs"] else np.zeros((len(texts), 0))
    held, size = [], 0

    def product():
        cells, n = np.unique(np.concatenate([x.astype(np.int64) + i * BUCKETS for i, x in held]), return_counts=True)
        row, bucket = cells // BUCKETS, cells % BUCKETS
        for j in range(logs.shape[1]):
            logs[:, j] += np.bincount(row, n * model["table"][bucket, j], len(texts))

    for i in np.flatnonzero(known).tolist():
        for x in buckets(texts[i]):
            held.append((i, x))
            size += len(x)
            if size >= PRODUCT:
                product()
                held, size = [], 0
    if held:
        product()
    if not logs.shape[1]:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    p = np.exp(logs - logs.max(1, keepdims=True))
    best = p.argmax(1)
    share = p[np.arange(len(texts)), best] / p.sum(1)
    return [model["langs"][b] if k else UNKNOWN for k, b in zip(known, best, strict=True)], np.where(known, share, 0.0).tolist()


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """docs with lang_pred and score, learned from rows (text, lang) of train."""
    docs = docs.drop("lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast(fit(train))
    text = docs.columns.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string", "score double"])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                langs, shares = score_batch(part.column(text).to_pylist(), model.value)
                more = [pa.array(langs, pa.string()), pa.array(shares, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def remainder(doc_id: Column, parts: int) -> Column:
    """CRC32 of the id as text, by parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def held_out_predictions(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (remainder(F.col("doc_id"), parts) == held).alias("held_out"))
    return identify(rows.select("doc_id", "text", "held_out"), rows.where(~F.col("held_out")).select("text", "lang")).drop("text")
