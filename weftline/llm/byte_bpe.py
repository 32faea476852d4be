"""Byte-level BPE with the tokenizers library over Arrow batches.

The ranks of a rank file become a vocabulary over printable characters, one for each byte, and merges in rank
order. Texts are split by the tokenizer's pattern and each piece is encoded by itself; pieces repeat, so a bounded
cache holds their ids and only new pieces of a batch go to the library, together. Offsets are in code points: a
token that starts within a character starts at that character, and one that ends within it ends after it.
Decoding puts the printable characters of all ids in a row and reads each back through the reversed byte table, so
characters split over tokens come out whole; bytes that are not UTF-8 become U+FFFD in text (bytes stay exact).

Null texts count as empty: no ids; null ids decode to null. Equal texts and repeated rows have equal ids; merges of one
piece are taken by rank, and of equal ranks the first. Texts are encoded whole, however long. Empty tables give empty
tables. encode() and decode() keep other columns; columns with the names they add are replaced.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import env_single_thread, map_rows, slices

CACHE = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if printable Latin-1, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class ByteBPE:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, data: bytes, pattern: str):
        env_single_thread()
        import regex
        from tokenizers import Tokenizer, models

        ranks = read_ranks(data)
        self.chars = byte_characters()
        self.table = {rank: token for token, rank in ranks.items()}
        shown = {token: "".join(map(self.chars.__getitem__, token)) for token in ranks}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):  # every way to join two earlier tokens to this one
                a, b = token[:i], token[i:]
                if ranks.get(a, rank) < rank and ranks.get(b, rank) < rank:
                    merges.append((shown[a], shown[b]))
        self.library = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True, cache_capacity=0))
        self.split = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        # what each id shows, in a row, and the byte that each character stands for
        known = range(max(self.table) + 1)
        self.size = np.array([len(self.table.get(i, b"")) for i in known], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.shown = np.frombuffer("".join(shown[self.table[i]] for i in known if i in self.table).encode("utf-16-le"), "<u2")
        self.byte_of = np.zeros(512, np.uint8)
        self.byte_of[[ord(c) for c in self.chars]] = np.arange(256)

    def learn(self, pieces) -> None:
        new = [p for p in pieces if p not in self.cache]
        if not new:
            return
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(pieces)
        char = self.chars.__getitem__
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            done = self.library.encode_batch_fast(["".join(map(char, p.encode())) for p in part], add_special_tokens=False)
            self.cache.update((p, struct.pack(f"<{len(x.ids)}I", *x.ids)) for p, x in zip(part, done, strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        pieces = [self.split.findall(t) if t else [] for t in texts]
        self.learn({p for x in pieces for p in x})
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), "<u4") for x in pieces]

    def offsets(self, text: str | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point of each id, and the one after its last."""
        data = np.frombuffer((text or "").encode(), np.uint8)
        owner = np.cumsum((data & 0xC0) != 0x80) - 1  # the character that each byte belongs to
        ends = np.cumsum(self.size[ids])
        return owner[ends - self.size[ids]].astype(np.int32), (owner[ends - 1] + 1).astype(np.int32)

    def decode_bytes(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        out = []
        for i in range(0, len(ids), 1 << 20):
            part = ids[i : i + (1 << 20)]
            size = self.size[part]
            at = np.arange(int(size.sum())) + np.repeat(self.first[part] - (np.cumsum(size) - size), size)
            out.append(self.byte_of[self.shown[at]].tobytes())
        return b"".join(out)

    def decode_stream(self, ids):
        """Text as ids arrive: a split character is held back until its last byte is there."""
        held = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := held.decode(self.decode_bytes([i])):
                yield out
        if out := held.decode(b"", True):
            yield out

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_MADE: dict[tuple, ByteBPE] = {}


def made(key: tuple, data, pattern: str) -> ByteBPE:
    """One encoder per worker process."""
    if key not in _MADE:
        _MADE[key] = ByteBPE(data.value, pattern)
    return _MADE[key]


def _shipped(spark: SparkSession, path: str, pattern: str):
    """The rank file as a broadcast (under 1 MB; it does not grow with the input) and its key."""
    data = open(path, "rb").read()
    return (hashlib.sha256(data).hexdigest(), pattern), spark.sparkContext.broadcast(data)


def digests(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, n_tokens, digests of ids, of decoded bytes and of offsets (first, end, first, ...), and
    whether the bytes are those of the text, for each row (doc_id, text, ...)."""
    key, data = _shipped(docs.sparkSession, path, pattern)
    more = ("n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "round_trip")

    def sha(b) -> str:
        return hashlib.sha256(b).hexdigest()

    def run(cols):
        bpe, out = made(key, data, pattern), {k: cols[k] for k in ("doc_id", *keep)} | {k: [] for k in more}
        for text, ids in zip(cols["text"], bpe.encode_batch(cols["text"]), strict=True):
            back = bpe.decode_bytes(ids)
            at = np.stack(bpe.offsets(text, ids), 1) if len(ids) else np.zeros((0, 2), np.int32)
            for k, x in zip(more, (len(ids), sha(ids.tobytes()), sha(back), sha(at.astype("<u4").tobytes()), back == (text or "").encode()), strict=True):
                out[k].append(x)
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)
    return map_rows(rows, run, f"doc_id long, {kept}n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string, round_trip boolean")


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = True) -> DataFrame:
    """docs with token_ids, and token_starts and token_ends in code points."""
    names = ["token_ids", *(["token_starts", "token_ends"] if offsets else [])]
    docs = docs.drop(*names)
    key, data = _shipped(docs.sparkSession, path, pattern)
    text = docs.columns.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{n} array<int>" for n in names)])

    def run(batches):
        kind = pa.list_(pa.int32())
        for batch in batches:
            for part in slices(batch):
                bpe = made(key, data, pattern)
                texts = part.column(text).to_pylist()
                ids = bpe.encode_batch(texts)
                more = [[x.astype(np.int32) for x in ids]]
                if offsets:
                    at = [bpe.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                    more += [[x[0] for x in at], [x[1] for x in at]]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m, kind) for m in more)], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """tokens with the text of its ids; null ids give null."""
    tokens = tokens.drop(out)
    key, data = _shipped(tokens.sparkSession, path, pattern)
    at = tokens.columns.index(ids)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema), f"`{out}` string"])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                bpe = made(key, data, pattern)
                text = [None if x is None else bpe.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*part.schema.names, out])

    return tokens.mapInArrow(run, schema)
