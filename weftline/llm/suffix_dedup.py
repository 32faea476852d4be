"""Removal of passages that occur twice, found with a Burrows-Wheeler transform.

A byte goes if a string of LENGTH bytes that covers it starts at another place too, in the same text or in any other.

Strings are told apart by anchors, so that the corpus need not meet in one transform. The anchor of a string is the
least hash among its grams of GRAM bytes, so equal strings have equal anchors. Neighbouring strings of a text with one
anchor form a fragment, and each string lies in one fragment. First anchors are counted; fragments whose anchor occurs
once are left out (a bitmap of fixed size says so, and may let more through). Equal fragments collapse, with their
number. Fragments with one anchor that differ then meet: their transform is built, and intervals are extended backwards
breadth first, which gives the common prefixes of neighbouring suffixes by increasing length. At LENGTH the extension
stops; neighbours without a value yet share at least LENGTH bytes, so both strings occur twice.

An anchor with more than HOT fragments that differ does not go to one task: its strings are compared by digest. No
fragment or string is dropped at any size. Null texts count as empty. Texts under LENGTH bytes lose nothing. Repeated
rows are texts that occur twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import delete, map_rows, materialize, release, slices

LENGTH, GRAM, HOT = 200, 50, 8192
BITS = 27
#: Bytes of fragments in one transform, and bytes of a text that are hashed at once.
BATCH, PIECE = 1 << 17, 1 << 22
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(c: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all grams of bytes, by joining hashes of half the length."""
    with np.errstate(over="ignore"):
        whole, taken, size, h = None, 0, 1, c.astype(np.uint64) + np.uint64(1)
        n = len(c) - gram + 1
        while True:
            if gram & size:
                part = h[taken : taken + n]
                whole = part.copy() if whole is None else whole * np.uint64(pow(_BASE, size, 1 << 64)) + part
                taken += size
            size *= 2
            if size > gram:
                break
            half = size // 2
            h = h[:-half] * np.uint64(pow(_BASE, half, 1 << 64)) + h[half:]
        whole ^= whole >> np.uint64(32)
        whole *= np.uint64(0xD6E8FEB86659FD93)
        whole ^= whole >> np.uint64(29)
        whole *= np.uint64(0xD6E8FEB86659FD93)
        whole ^= whole >> np.uint64(32)
        return whole


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from leasts over widths that double."""
    n, size, m = len(x) - w + 1, 1, x
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[w - size : w - size + n])


def fragments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First string, number of strings and anchor of each run of strings with one anchor, for whole texts."""
    first, number, anchor = [], [], []
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        c = np.frombuffer(data, np.uint8, min(len(data) - at, PIECE + length - 1), at)
        h = gram_hashes(c, gram)
        low = np.uint64((1 << 24) - 1)
        least = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        where = (least & low).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1])
        first.append(starts + at)
        number.append(np.diff(np.append(starts, len(where))))
        anchor.append(h[where[starts]].view(np.int64))
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(first), np.concatenate(number), np.concatenate(anchor)


def suffix_array(s: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s, each up to its next zero; equal ones by place. left: symbols up to that zero."""
    n, h = len(s), 7
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    padded = np.concatenate([s, np.zeros(h, s.dtype)]).astype(np.uint64)
    for j in range(h):
        x = padded[j : j + n]
        alive &= x > 0
        key = (key << np.uint64(9)) | np.where(alive, x, np.uint64(0))
    sa = np.argsort(key)
    key = key[sa]
    where, rank = np.arange(n), np.empty(n, np.int64)
    while len(where):  # whole groups of places in the order that are tied, with symbols left to compare
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(heads, len(where)))
        p = sa[where]
        rank[p] = np.repeat(where[heads], sizes)
        more = left[p] > h
        tied = np.repeat((sizes > 1) & np.logical_or.reduceat(more, heads), sizes)
        where, p, more = where[tied], p[tied], more[tied]
        key = (rank[p] << 32) | np.where(more, rank[np.minimum(p + h, n - 1)] + 1, 0)
        order = np.argsort(key)
        sa[where], key = p[order], key[order]
        h *= 2
    r = rank[sa]
    equal = np.concatenate([[False], r[1:] == r[:-1]])
    equal[:-1] |= equal[1:]
    where = np.flatnonzero(equal)
    p = sa[where]
    sa[where] = p[np.argsort((rank[p] << 32) | p)]
    return sa


def common_prefixes(last: np.ndarray, starts: np.ndarray, ends: int, bound: int) -> np.ndarray:
    """Longest common prefixes of neighbouring suffixes under bound, else -1, from the transform.

    last: the transform; zeros stand before the first symbol of a fragment. starts: first row of each symbol in use.
    ends: rows of ends of fragments, which come first and are all different.
    """
    n = len(last)
    lcp = np.full(n + 1, -1, np.int16)
    lcp[0] = lcp[n] = 0
    begins = np.zeros(n, bool)
    begins[starts] = True
    to = np.empty(n, np.int32)
    to[np.argsort(last.astype(np.uint16), kind="stable")] = np.arange(n, dtype=np.int32)
    lo = np.concatenate([np.arange(ends), starts])
    hi = np.append(lo[1:], n)
    lcp[hi] = 0
    mark = np.full(n, -1, np.int32)
    for length in range(1, bound):
        sizes = hi - lo
        number = np.repeat(np.arange(len(lo), dtype=np.int32), sizes)
        rows = np.arange(len(number)) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)
        seen = last[rows] > 0
        rows, number = rows[seen], number[seen]
        if not len(rows):
            break
        target = to[rows]
        if len(target) * 8 > n:
            mark[target] = number
            there = np.flatnonzero(mark >= 0)
            number = mark[there]
            mark[there] = -1
        else:
            order = np.argsort(target)
            there, number = target[order], number[order]
        # rows of one interval before one symbol stay together; symbols have their own ranges of rows
        cut = (there[1:] != there[:-1] + 1) | (number[1:] != number[:-1]) | begins[there[1:]]
        begin = np.concatenate([[0], np.flatnonzero(cut) + 1])
        lo, hi = there[begin], there[np.append(begin[1:] - 1, len(there) - 1)] + 1
        fresh = lcp[hi] < 0
        lo, hi = lo[fresh], hi[fresh]
        lcp[hi] = length
        if not len(lo):
            break
    return lcp


def twice(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, which of its strings of `length` bytes start at another place of the parts too."""
    sizes = np.array([len(p) for p in parts])
    s = np.zeros(int(sizes.sum()) + len(parts), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(s), bool)
    inside[ends] = False
    s[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 1
    left = np.repeat(ends, sizes + 1) - np.arange(len(s))
    sa = suffix_array(s, left)
    before = np.concatenate([[0], s[:-1]])
    first = s[sa]
    starts = np.flatnonzero(np.concatenate([[False], first[1:] != first[:-1]]))
    starts = starts[first[starts] > 0]
    lcp = common_prefixes(before[sa], starts, len(parts), length)
    same = lcp[1 : len(s)] < 0
    flag = np.zeros(len(s), bool)
    flag[sa[1:][same]] = True
    flag[sa[:-1][same]] = True
    return [flag[e - n : e - n + max(0, n - length + 1)] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits, on at the top bits of the 64-bit numbers in the column h. The driver gets 2 ** (bits - 6) rows at most."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")
    found = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _on(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    slot = h.view(np.uint64) >> np.uint64(64 - bits)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _repeated_anchors(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                anchor = fragments(text.encode())[2] if text else ()
                if len(anchor):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64())], names=["h"])

    return docs.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")


def _cut(docs: DataFrame, bitmap, bits: int) -> DataFrame:
    """(text_key, at, strings, anchor, part_key, part) of the fragments that the bitmap lets through."""
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = ["text_key", "at", "strings", "anchor", "part_key", "part"]

    def run(batches):
        table = bitmap.value
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            held = 0
            for text in batch.column(0).to_pylist():
                data = (text or "").encode()
                first, number, anchor = fragments(data)
                hit = np.flatnonzero(_on(table, anchor, bits))
                if not len(hit):
                    continue
                key = hashlib.md5(data).digest()
                for a, n, h in zip(first[hit].tolist(), number[hit].tolist(), anchor[hit].tolist(), strict=True):
                    part = data[a : a + n + LENGTH - 1]
                    held += len(part)
                    for col, value in zip(rows, (key, a, n, h, hashlib.md5(part).digest(), part), strict=True):
                        col.append(value)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)
                    rows, held = [[] for _ in names], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    return docs.select("text").mapInArrow(run, "text_key binary, at long, strings int, anchor long, part_key binary, part binary")


def _pick(cut: DataFrame, bitmap, bits: int) -> DataFrame:
    """(anchor, part_key, part) of the occurrences that the bitmap lets through: one of each part, and few more."""

    def run(batches):
        table = bitmap.value
        for batch in batches:
            keep = _on(table, batch.column(0).to_numpy(), bits)
            if keep.any():
                yield batch.select([1, 2, 3]).filter(pa.array(keep))

    return cut.select(_occurrence().alias("h"), "anchor", "part_key", "part").mapInArrow(run, "anchor long, part_key binary, part binary")


def _occurrence():
    return F.xxhash64("text_key", "at")


def _judge(batches):
    """Parts (anchor, part_key, part) in order of anchor -> (part_key, mask) of those that share a string with another."""
    held: dict[bytes, bytes] = {}
    group: dict[bytes, bytes] = {}
    size, last = 0, None

    def done():
        masks = {k: np.packbits(f).tobytes() for k, f in zip(held, twice(list(held.values())), strict=True) if f.any()}
        return pa.RecordBatch.from_arrays([pa.array(list(masks), pa.binary()), pa.array(list(masks.values()), pa.binary())], names=["part_key", "mask"])

    for batch in batches:
        for anchor, key, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if anchor != last:
                if len(group) > 1:
                    held |= group
                    size += sum(map(len, group.values()))
                    if size > BATCH:
                        yield done()
                        held.clear()
                        size = 0
                group, last = {}, anchor
            group[key] = part
    if len(group) > 1:
        held |= group
    if held:
        yield done()


def _by_digest(hot: DataFrame) -> DataFrame:
    """(part_key, mask) of parts (part_key, part) of hot anchors: their strings' digests are counted."""

    def strings(batches):
        for batch in batches:
            for key, part in zip(*(batch.column(c).to_pylist() for c in ("part_key", "part")), strict=True):
                m = len(part) - LENGTH + 1
                digest = [hashlib.md5(part[i : i + LENGTH]).digest() for i in range(m)]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array([key] * m, pa.binary()), pa.array(range(m), pa.int32())], names=["string", "part_key", "i"])

    each = hot.dropDuplicates(["part_key"]).select("part_key", "part").mapInArrow(strings, "string binary, part_key binary, i int")
    counted = each.groupBy("string").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("string")
    found = each.join(counted, "string").groupBy("part_key").agg(F.collect_set("i").alias("at"))

    def run(cols):
        masks = []
        for at in cols["at"]:
            flags = np.zeros(LENGTH, bool)
            flags[at] = True
            masks.append(np.packbits(flags).tobytes())
        return {"part_key": [bytes(k) for k in cols["part_key"]], "mask": masks}

    return map_rows(found, run, "part_key binary, mask binary")


def repeats(docs: DataFrame, hot: int = HOT, bits: int = BITS) -> DataFrame:
    """(text_key, found) of each text with strings that occur twice; found: places, numbers of strings and masks.

    A part that occurs twice is all found (its mask is null). Only parts whose anchor has others need their bytes
    compared; one occurrence of each is picked for that, by a second bitmap.
    """
    spark = docs.sparkSession
    cast = spark.sparkContext.broadcast
    anchors = cast(_bits(_repeated_anchors(docs), bits))
    cut, cut_path = materialize(_cut(docs, anchors, bits), "cut", compression="zstd")
    release(spark)
    parts = cut.groupBy("anchor", "part_key").agg(F.count(F.lit(1)).alias("n"), F.min(_occurrence()).alias("h"))
    parts, parts_path = materialize(parts, "parts")
    kinds, kinds_path = materialize(parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
    release(spark)
    picked = _pick(cut, cast(_bits(parts.join(kinds, "anchor").select("h"), bits)), bits)
    crowded = kinds.where(F.col("kinds") > hot).select("anchor")
    masks = []
    if not crowded.isEmpty():
        picked, _ = materialize(picked, "picked")
        masks.append(_by_digest(picked.join(crowded, "anchor", "left_semi")))
        picked = picked.join(crowded, "anchor", "left_anti")
    ordered = picked.select("anchor", "part_key", "part").repartition("anchor").sortWithinPartitions("anchor")
    masks.append(ordered.mapInArrow(_judge, "part_key binary, mask binary"))
    masks.append(parts.where("n > 1").select("part_key", F.lit(None).cast("binary").alias("mask")))
    table = masks[0]
    for m in masks[1:]:
        table = table.unionAll(m)
    table, masks_path = materialize(table, "masks")
    release(spark)
    placed = cut.select("part_key", "text_key", "at", "strings").join(table, "part_key").select("text_key", F.struct("at", "strings", "mask").alias("x"))
    found, _ = materialize(placed.groupBy("text_key").agg(F.collect_set("x").alias("found")), "found")
    for path in (cut_path, parts_path, kinds_path, masks_path):
        delete(spark, path)
    release(spark)
    return found


def covered(n: int, at: np.ndarray, strings: np.ndarray, masks: list) -> np.ndarray:
    """Which of n bytes go, from places, numbers of strings and masks; all strings count where the mask is None."""
    starts, ends = [], []
    whole = np.ones(len(at), bool)
    for i, mask in enumerate(masks):
        if mask is not None:
            whole[i] = False
            one = at[i] + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8)))
            starts.append(one)
            ends.append(one + LENGTH)
    starts.append(at[whole])
    ends.append(at[whole] + strings[whole] + LENGTH - 1)
    d = np.bincount(np.concatenate(starts), minlength=n + 1) - np.bincount(np.concatenate(ends), minlength=n + 1)
    return np.cumsum(d[:-1]) > 0


def _left(docs: DataFrame, each, schema: str) -> DataFrame:
    """each(bytes, which of them go or None) -> values after doc_id, for each row."""
    found = repeats(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"))
    x = F.col("found")
    joined = rows.join(found, "text_key", "left").select("doc_id", "text", x["at"].alias("at"), x["strings"].alias("strings"), x["mask"].alias("mask"))
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                values = []
                flat = [part.column(i).flatten() for i in (2, 3, 4)]
                at, strings, masks = flat[0].to_numpy(), flat[1].to_numpy(), flat[2].to_pylist()
                sizes = [x.as_py() for x in pc.list_value_length(part.column(2))]
                i = 0
                for text, n in zip(part.column(1).to_pylist(), sizes, strict=True):
                    data = (text or "").encode()
                    gone = covered(len(data), at[i : i + n], strings[i : i + n], masks[i : i + n]) if n else None
                    i += n or 0
                    values.append(each(data, gone))
                cols = zip(*values, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(out)[1:], strict=True))], schema=out)

    return joined.mapInArrow(run, schema)


def _kept(data: bytes, gone) -> bytes:
    return data if gone is None else np.frombuffer(data, np.uint8)[~gone].tobytes()


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""

    def each(data, gone):
        runs = 0 if gone is None else int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(data), 0 if gone is None else int(gone.sum()), runs, hashlib.sha256(_kept(data, gone)).hexdigest()

    return _left(docs, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): what is left of each text, as bytes; a cut may split a character."""
    return _left(docs, lambda data, gone: (_kept(data, gone),), "doc_id long, kept binary")
