"""Language-model scores: a causal self-attention model in numpy over subword ids, and a unigram base score.

A text is its lower-cased words (A-Z alone) and one end; each word, after a space, is cut to subword ids by a byte-level
BPE. The model gives P(id | ids before) = P(class | ids before) * P(id | class, id before).

* q(id | id before) is a table of counts over all training words: ids that follow each other within a word, and words'
  ends, after which any word's first id or the text's end comes; it falls back on the ids' frequencies with weight BACK.
* Ids fall into CLASSES classes: the most frequent have one each, the others are grouped by the ids that stand next to
  them (k-means on counts), and the end has one. q sums up to q(class | id before), and P(id | class, id before) is what q
  says within a class; so all probabilities of a next id add up to one.
* P(class | ids before) is a softmax of log q(class | id before) plus what one head of self-attention adds: it looks at the
  last BLOCK to 2 * BLOCK ids, with a learned weight for each distance. Windows of 2 * BLOCK ids overlap by half and score
  their second half, so each id is scored once, with at least BLOCK ids before it where the text has them.

The score is the model's own log probability of a text's ids and end. Training and scoring use the same attention.

Training: every id and end of every training text is a target once in each round, in the windows that scoring uses. A hash
of id and text deals the texts to shards of about SHARD_WORDS words and puts them in order; a shard takes its steps from the
common start, in batches of the same blocks whatever the partitions are, and parameters are averaged, weighted by the ids
seen. So scores do not depend on partitions, but for sums of floats, and for rows without id, which are dealt by place.

Base score: word counts are summed up in Spark. The TOP most frequent words (ties: the least bytes) go to the executors as
a broadcast of bounded size (words of at most LONGEST bytes); all others are joined. The model has every pair of ids that
occurs within a training word: they grow far slower than the text, as ids and words repeat.

Null texts count as empty: one end. Null ids are training ids (their CRC is that of empty text). Repeated rows are learned
from as often as they occur, and equal texts have equal scores. Texts are scored whole, however long. Other columns are left
out. Without training texts nothing is known: every base term is log10(1) = 0, and the model has its starting parameters
and equal counts. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _shipped, made
from .common import delete, materialize, one_blas_thread, slices

CLASSES, OWN, WIDTH, BLOCK, ROWS = 128, 96, 16, 16, 2048
TOP, LONGEST, FLUSH, HELD_WORDS = 1 << 17, 64, 400_000, 600_000
#: Blocks of ids in one batch of attention, in training and in scoring, where batches do not matter for the result; rows of
#: its softmax at a time. Products of up to a million terms go by OpenBLAS's kernels for small ones, which are faster here.
BLOCKS, SCORED, PART = 128, 512, 416
#: Bytes of a slice of texts: words of a larger one repeat more often.
SLICE = 1 << 20
#: Words of a training shard, about; the most shards; weight of frequencies against counts of pairs.
SHARD_WORDS, SHARDS, BACK = 1 << 20, 1 << 16, 8.0
NONE = np.float32(-1e9)


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words in each text, and all words, text after text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    parts = lists.flatten()
    real = pc.greater(pc.binary_length(parts), 0)  # white space at an end leaves an empty part
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    ends = before[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))]
    return np.diff(ends), parts.filter(real).cast(pa.binary())


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over rows (text)."""

    def run(batches):
        held = pa.table({"word": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})

        def summed():
            return held.group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for batch in batches:
            for part in slices(batch):
                found = split(part.column(0))[1].value_counts()
                held = pa.concat_tables([held, pa.table({"word": found.field(0), "c": found.field(1)})])
                if held.num_rows > 2 * FLUSH:
                    held = summed()
                    if held.num_rows > FLUSH:
                        yield from held.to_batches()
                        held = held.slice(0, 0)
        yield from summed().to_batches()

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Subwords:
    """Ids of words, each after a space; many words go to the library in one call."""

    def __init__(self, bpe):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer(bpe.library.model)
        self.library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.shown = str.maketrans({b: c for b, c in enumerate(bpe.chars)})
        self.bytes = np.zeros(max(bpe.table) + 1, np.int64)
        for i, token in bpe.table.items():
            self.bytes[i] = len(token)
        self.listed: dict[bytes, int] = {}
        self.shown[0x100] = "\n"  # between words; no byte has this number, and no byte's character is white space
        self.forget()

    def list_words(self, listed: dict[bytes, int]) -> None:
        """From now on self.place has each kept word's number among these; -1 stands for all others."""
        if listed is not self.listed:
            self.listed = listed
            self.place = self._put(self.place, 0, self._places(self.number))

    def _places(self, words) -> np.ndarray:
        return np.fromiter(map(self.listed.get, words, repeat(-1)), np.int32, len(words))

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.used, self.ids = 0, np.zeros(1 << 16, np.int32)
        self.sizes, self.begin, self.place = (np.zeros(1 << 16, np.int32) for _ in range(3))

    @staticmethod
    def _put(held: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
        if at + len(new) > len(held):
            held = np.concatenate([held, np.zeros(max(len(held), len(new)), held.dtype)])
        held[at : at + len(new)] = new
        return held

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, word after word, and the number of ids of each word."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, sizes = [], []
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            text = "\u0100".join([(b" " + w).decode("latin-1") for w in part]).translate(self.shown)
            ids.append(np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64))
            # a word's ids end where their bytes add up to its own
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.bytes[ids[-1]]), ends) + 1, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def number_of(self, words: list[bytes]) -> np.ndarray:
        """The number of each of these different words; self.begin and self.sizes say where its ids are in self.ids.
        Words are kept, up to HELD_WORDS."""
        if len(self.number) > HELD_WORDS:
            self.forget()
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(found < 0)
        if len(at):
            new = list(map(words.__getitem__, at.tolist()))
            ids, sizes = self.encode(new)
            n = len(self.number)
            found[at] = np.arange(n, n + len(new))
            self.number.update(zip(new, range(n, n + len(new)), strict=True))
            self.ids = self._put(self.ids, self.used, ids)
            self.sizes = self._put(self.sizes, n, sizes)
            self.begin = self._put(self.begin, n, np.cumsum(sizes) - sizes + self.used)
            self.place = self._put(self.place, n, self._places(new))
            self.used += len(ids)
        return found


_SUBWORDS: dict = {}


def subwords(key, data, pattern) -> Subwords:
    if key not in _SUBWORDS:
        _SUBWORDS[key] = Subwords(made(key, data, pattern))
    return _SUBWORDS[key]


class Coded:
    """Texts' words as numbers among the distinct words of a batch, and those words' ids."""

    def __init__(self, each: np.ndarray, words: pa.Array, encoder: Subwords):
        self.words = each.astype(np.int64)
        self.text = np.repeat(np.arange(len(each)), self.words)
        coded = words.dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.dictionary = coded.dictionary
        number = encoder.number_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        self.place = encoder.place[number]
        self.begin, self.sizes = encoder.begin[number].astype(np.int64), encoder.sizes[number].astype(np.int64)
        self.ids = encoder.ids

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids, text after text, and their number in each text."""
        n = self.sizes[self.code]
        at = np.arange(int(n.sum())) + np.repeat(self.begin[self.code] - (np.cumsum(n) - n), n)
        return self.ids[at], np.bincount(self.text, n, len(self.words)).astype(np.int64)


def count_pairs(words: DataFrame, key, data, pattern) -> DataFrame:
    """(a, b, c) over rows (word, c): how often id b follows id a within a word. a is -1 before a word's first id, b is -1
    after its last."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, rows=20_000):
                ids, sizes = subwords(key, data, pattern).encode(part.column(0).to_pylist())
                ends = np.cumsum(sizes) + np.arange(len(sizes))  # places of the marks between words
                row = np.full(len(ids) + len(sizes) + 1, -1, np.int64)
                row[np.delete(np.arange(1, len(row)), ends)] = ids
                c = np.repeat(part.column(1).to_numpy(), sizes + 1)
                both, at = np.unique((row[:-1] + 1 << 32) + row[1:] + 1, return_inverse=True)
                sums = np.bincount(at, c, len(both)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((both >> 32) - 1, pa.int32()), pa.array((both & 0xFFFFFFFF) - 1, pa.int32()), pa.array(sums)], names=["a", "b", "c"])

    return words.select("word", "c").mapInArrow(run, "a int, b int, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


class Table:
    """q(id | id before) by counts. Ids are below n; n is the end as a target, and the start of a text as an id before."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, texts: int):
        self.n = n
        inner = (a >= 0) & (b >= 0)
        x, y, z = (v[inner] for v in (a, b, c))
        by = np.argsort(x.astype(np.int64) * (n + 1) + y)
        self.keys, self.c = (x.astype(np.int64) * (n + 1) + y)[by], z[by].astype(np.float64)
        first, last = np.zeros(n + 1), np.zeros(n + 1)
        first[b[(a < 0) & (b >= 0)]] = c[(a < 0) & (b >= 0)]
        last[a[(b < 0) & (a >= 0)]] = c[(b < 0) & (a >= 0)]
        first[n], last[n] = texts, texts
        self.counts = np.bincount(b[inner], c[inner], n + 1) + first
        self.rare = (self.counts + 0.1) / (self.counts + 0.1).sum()
        self.first = first / first.sum() if texts else self.rare
        self.last = last  # after the start, as after a word, a word or the end comes
        self.total = np.bincount(self.keys // (n + 1), self.c, n + 1) + last + BACK

    def pair_counts(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(ids))
        key = before * (self.n + 1) + ids
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.c[at], 0.0)

    def q(self, before: np.ndarray, ids: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """pairs: their counts, if known."""
        pairs = self.pair_counts(before, ids) if pairs is None else pairs
        return (pairs + self.last[before] * self.first[ids] + BACK * self.rare[ids]) / self.total[before]

    def classes(self) -> np.ndarray:
        """Class of each id and the end: own ones, then groups by neighbours."""
        n, k = self.n, CLASSES - OWN - 1
        own = np.lexsort((np.arange(n), -self.counts[:n]))[:OWN]
        cls, place = np.full(n + 1, CLASSES - 1), np.full(n + 1, -1)
        cls[own], cls[n], place[own] = np.arange(len(own)), OWN, np.arange(len(own))
        rest = np.flatnonzero((self.counts[:n] > 0) & (place[:n] < 0))
        if not len(rest):
            return cls
        x, y = self.keys // (n + 1), self.keys % (n + 1)
        beside = np.zeros((n + 1, 2 * OWN + 2))
        for at, other, shift in ((y, x, 0), (x, y, OWN)):
            some = place[other] >= 0
            np.add.at(beside, (at[some], place[other[some]] + shift), self.c[some])
        beside[:, 2 * OWN], beside[:, 2 * OWN + 1] = self.first * max(1.0, self.last.sum()), self.last
        f = np.sqrt(beside[rest] + 0.01)
        f /= np.linalg.norm(f, axis=1, keepdims=True)
        middle = f[np.lexsort((rest, -self.counts[rest]))[:k]]
        for _ in range(12):
            group = (f @ middle.T).argmax(1)
            new = np.zeros_like(middle)
            np.add.at(new, group, f * np.sqrt(self.counts[rest])[:, None])
            size = np.linalg.norm(new, axis=1, keepdims=True)
            middle = np.where(size > 0, new / np.maximum(size, 1e-12), middle)
        cls[rest] = OWN + 1 + np.minimum(group, k - 1)
        return cls

    def of_classes(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each id before, and log q(class | id before) by rows; ids that were never seen share the last row."""
        n = self.n
        seen = np.append(np.flatnonzero(self.total > BACK), n + 1)
        row = np.full(n + 2, len(seen) - 1)
        row[seen[:-1]] = np.arange(len(seen) - 1)
        cells = row[self.keys // (n + 1)] * CLASSES + cls[self.keys % (n + 1)]
        c = np.bincount(cells, self.c, len(seen) * CLASSES).reshape(-1, CLASSES).astype(np.float64)
        first, rare = (np.bincount(cls, x, CLASSES) for x in (self.first, self.rare))
        last, total = np.append(self.last, 0.0)[seen], np.append(self.total, BACK)[seen]
        c += last[:, None] * first + BACK * rare
        return row[: n + 1], np.log(np.maximum(c / total[:, None], 1e-30)).astype(np.float32)


class Model:
    """What goes to the executors besides the learned parameters."""

    def __init__(self, table: Table):
        self.table, self.end, self.pairs = table, table.n, None
        self.cls = table.classes()
        self.row, self.logq = table.of_classes(self.cls)
        self.share = np.exp(self.logq)
        # rows of the embedding: one for the start and each of the most frequent ids, the others share the rest by hash
        n = table.n
        self.embedded = np.append(1 + ROWS // 2 + (np.arange(n + 1) * 2654435761 >> 7) % (ROWS - ROWS // 2 - 1), ROWS)  # the last: nothing
        often = np.lexsort((np.arange(n), -table.counts[:n]))[: ROWS // 2]
        self.embedded[often] = 1 + np.arange(len(often))
        self.embedded[n] = 0  # as an input, the end's number stands for the start

    def inner(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log P(id | class, id before). Pairs of the table are looked up by a hash, and others among the last ones that had
        their place; the rest is computed, and only those that meet another pair of the table in its place are searched for."""
        if self.pairs is None:
            self._fill()
        key = before * (self.table.n + 1) + ids
        slot = self._slot(key)
        held, found = self.pairs[slot], self.values[slot]
        other = np.flatnonzero(held != key)
        at, wanted = slot[other], key[other]
        again = self.met_values[at]
        new = np.flatnonzero(self.met[at] != wanted)
        at, fresh = at[new], other[new]
        taken = held[fresh] >= 0
        before, ids = before[fresh], ids[fresh]
        pairs = np.zeros(len(fresh))
        pairs[taken] = self.table.pair_counts(before[taken], ids[taken])
        again[new] = self._inner(before, ids, pairs)
        self.met[at], self.met_values[at] = wanted[new], again[new]
        found[other] = again
        return found

    def _inner(self, before: np.ndarray, ids: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        return np.log(self.table.q(before, ids, pairs)) - self.logq[self.row[before], self.cls[ids]]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def _fill(self) -> None:
        """Executors make this for themselves: it would only make the broadcast larger."""
        keys, n = self.table.keys, self.table.n + 1
        self.bits = len(keys).bit_length() + 2
        self.pairs, self.values = np.full(1 << self.bits, -1), np.zeros(1 << self.bits)
        self.met, self.met_values = self.pairs.copy(), self.values.copy()
        slot = self._slot(keys)
        self.pairs[slot] = keys
        there = np.flatnonzero(self.pairs >= 0)
        self.values[there] = self._inner(self.pairs[there] // n, self.pairs[there] % n)


def beginning(seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters at the start; attention adds next to nothing."""
    r = np.random.default_rng(seed)
    small = lambda *s, by=0.1: (r.standard_normal(s) * by).astype(np.float32)
    return {"in": small(ROWS, WIDTH, by=0.3), "qkv": small(WIDTH, 3 * WIDTH, by=0.25), "out": small(WIDTH, CLASSES, by=0.02), "bias": np.zeros(CLASSES, np.float32), "far": np.zeros(2 * BLOCK, np.float32)}


def layout(ids: np.ndarray, each: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets in blocks, from all ids and their number in each text. Ids of a text are its targets, ended;
    its inputs are those moved on by one, after a start, which is written as the end. An empty block comes before each
    text. Both are -1 where nothing is."""
    blocks = 1 + -(-(each + 1) // BLOCK)
    first = (np.cumsum(blocks) - blocks + 1) * BLOCK
    n = int(blocks.sum()) * BLOCK
    given, wanted = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    at = np.arange(len(ids)) + np.repeat(first - (np.cumsum(each) - each), each)
    wanted[at], given[at + 1] = ids, ids
    wanted[first + each], given[first] = end, end
    return given.reshape(-1, BLOCK), wanted.reshape(-1, BLOCK)


#: A block's keys meet the queries of the block itself and of the one after it: rows of queries, columns of keys.
_I, _J = np.arange(2 * BLOCK)[:, None], np.arange(BLOCK)[None, :]
_CELLS = np.arange((ROWS + 1) * WIDTH).reshape(-1, WIDTH)
_CAUSAL, _DISTANCE = _J <= _I, np.clip(_I - _J, 0, 2 * BLOCK - 1)


def _pairs(x: np.ndarray) -> np.ndarray:
    """Each block with the one after it, as a view; blocks lie one after the other."""
    n, b, w = x.shape
    owner = x if x.base is None else x.base  # as_strided does the same, in ten times the time
    return np.ndarray((n - 1, 2 * b, w), x.dtype, owner, x.__array_interface__["data"][0] - owner.__array_interface__["data"][0], x.strides)


_SCRATCH: dict[tuple, np.ndarray] = {}
_VIEWS: dict[tuple, np.ndarray] = {}


def _space(name: str, shape: tuple, kind) -> np.ndarray:
    """An array that is used again with each batch: fresh large ones cost more than the sums in them."""
    view = _VIEWS.get((name, shape, kind))
    if view is None:
        n = math.prod(shape)
        if (name, kind) not in _SCRATCH or len(_SCRATCH[name, kind]) < n:
            _SCRATCH[name, kind] = np.empty(n, kind)
            _VIEWS.clear()  # they would keep the smaller one
        if len(_VIEWS) > 1000:
            _VIEWS.clear()
        view = _VIEWS[name, shape, kind] = _SCRATCH[name, kind][:n].reshape(shape)
    return view


def _by_query(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Sums for the queries of blocks 1, 2, ... of what they have from their own block's keys and the keys before."""
    return np.add(x[1:, :BLOCK], x[:-1, BLOCK:], out=out)


def _halves(n: int) -> tuple[slice, slice]:
    return slice(0, n // 2), slice(n // 2, n)


def _turned(name: str, x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """x @ by with each block turned, as a view of one product: many small products are faster with rows as they lie."""
    n, b, w = x.shape
    out = np.matmul(by.T, x.reshape(-1, w).T, out=_space(name, (by.shape[1], n * b), x.dtype))
    return out.reshape(-1, n, b).transpose(1, 0, 2)


def attention(p: dict, given: np.ndarray, model: Model) -> dict:
    """Windows of the blocks (1, 2, ...) and the blocks before them: weights (not yet divided by their sums) by keys, and
    what the queries see, with a column of ones for the bias."""
    kind, n = p["in"].dtype, len(given)
    gaps = given < 0
    at = model.embedded[given]  # the last row, of zeros, where nothing is
    rows = _space("in", (ROWS + 1, WIDTH), kind)
    rows[:ROWS], rows[ROWS] = p["in"], 0
    x = _space("x", (n + 1, BLOCK, WIDTH), kind)
    np.take(rows, at, axis=0, out=x[:n], mode="clip")
    x[n] = 0  # the last block's keys meet no later query
    scaled = p["qkv"].copy()
    scaled[:, :WIDTH] *= kind.type(WIDTH**-0.5)
    flat, qkv = x.reshape(-1, WIDTH), _space("qkv", ((n + 1) * BLOCK, 3 * WIDTH), kind)
    for part in _halves(len(flat)):
        np.matmul(flat[part], scaled, out=qkv[part])
    qkv = qkv.reshape(n + 1, BLOCK, 3 * WIDTH)
    q, k, v = (qkv[:, :, i * WIDTH : (i + 1) * WIDTH] for i in range(3))
    keys = _turned("keys", x[:n], scaled[:, WIDTH : 2 * WIDTH])
    a = _space("a", (n, 2 * BLOCK, BLOCK), kind)
    holes = np.flatnonzero(gaps.any(1))
    far = np.where(_CAUSAL, p["far"][_DISTANCE], NONE)
    ones = np.ones(BLOCK, kind)

    def logits():
        np.matmul(_pairs(q), keys, out=a)
        np.add(a, far, out=a)
        if len(holes):
            a[holes] += np.where(gaps[holes], NONE, np.float32(0))[:, None, :]

    def sums():
        np.exp(a, out=a)
        return _by_query((a.reshape(-1, BLOCK) @ ones).reshape(n, 2 * BLOCK))

    logits()
    with np.errstate(over="ignore"):
        total = sums()
    total += gaps[1:]
    if not (total.min(initial=1) > 1e-20 and total.max(initial=1) < 1e20):  # large logits: as differences from each query's largest
        logits()
        top = a.max(-1)
        most = np.maximum(top[1:, :BLOCK], top[:-1, BLOCK:])
        a[1:, :BLOCK] -= most[:, :, None]
        a[:-1, BLOCK:] -= most[:, :, None]
        a[0, :BLOCK] = a[-1, BLOCK:] = NONE  # no targets
        total = sums()
    share = 1 / total
    seen = _by_query(np.matmul(a, v[:n], out=_space("av", (n, 2 * BLOCK, WIDTH), kind)), out=_space("seen", (n - 1, BLOCK, WIDTH), kind))
    seen *= share[:, :, None]
    h = _space("h", (n - 1, BLOCK, WIDTH + 1), kind)
    np.add(seen, x[1:n], out=h[:, :, :WIDTH])
    h[:, :, WIDTH] = 1
    return {"at": at, "x": x, "q": q, "k": k, "scaled": scaled, "a": a, "share": share, "seen": seen, "h": h.reshape(-1, WIDTH + 1)}


def chosen(p: dict, h: np.ndarray, given: np.ndarray, wanted: np.ndarray, model: Model, n: int = 0) -> tuple:
    """log probabilities of the classes of the targets (0 where there is none); with n, also the gradients of their mean over
    n targets, by the classes' weights and bias, and by h. Few rows at a time: they stay in the processor's cache."""
    kind = h.dtype
    goal, before = wanted[1:].reshape(-1), given[1:].reshape(-1)
    real = goal >= 0
    c, row = model.cls[goal], model.row[before]
    weights = np.concatenate([p["out"], p["bias"][None, :]]) * kind.type(1 / math.log(2))  # exp2 takes half the time of exp
    back, ones = np.ascontiguousarray(p["out"].T), np.ones(CLASSES, kind)
    own, total, held = np.empty(len(h), kind), np.empty(len(h), kind), np.empty(len(h), model.share.dtype)
    grad = np.zeros_like(weights)
    dh = _space("dh", (len(h) if n else 0, WIDTH), kind)
    z, share = _space("z", (PART, CLASSES), kind), _space("share", (PART, CLASSES), model.share.dtype)
    cells = np.arange(len(h)) % PART * CLASSES + c
    for i in range(0, len(h), PART):
        part = slice(i, i + PART)
        seen, at = h[part], cells[part]
        if len(seen) < PART:
            z, share = z[: len(seen)], share[: len(seen)]
        np.matmul(seen, weights, out=z)
        z.take(at, out=own[part], mode="clip")
        np.exp2(z, out=z)  # parameters move by small steps from small ones: far from the largest float
        model.share.take(row[part], 0, share, "clip")
        share.take(at, out=held[part], mode="clip")
        np.multiply(z, share, out=z)
        t = np.matmul(z, ones, out=total[part])
        if n:
            z.reshape(-1)[at] -= t
            by = (real[part] / (n * t)).astype(kind)[:, None]
            grad += (seen * by).T @ z
            np.matmul(z, back, out=dh[part])
            dh[part] *= by
    if not np.isfinite(total[real]).all():
        raise FloatingPointError("attention's logits left the range of floats")
    own *= kind.type(math.log(2))
    own += np.log(held)  # log q of the class
    own -= np.log(total)
    logp = np.where(real, own, kind.type(0))
    return logp, real, grad, dh.reshape(-1, BLOCK, WIDTH)


def forward(p: dict, given: np.ndarray, wanted: np.ndarray, model: Model) -> dict:
    """Targets of the blocks (1, 2, ...), seen with the blocks before them: their places, and log probabilities of their classes."""
    f = attention(p, given, model)
    logp, real, _, _ = chosen(p, f["h"], given, wanted, model)
    real = np.flatnonzero(real)
    return {"at": f["at"][given >= 0], "real": real, "goal": wanted[1:].reshape(-1)[real], "logp": logp[real]}


def step(p: dict, given: np.ndarray, wanted: np.ndarray, model: Model) -> tuple[dict, int, float]:
    """Gradients of the mean loss over a batch of blocks, the number of ids in it, and their loss."""
    f, blocks = attention(p, given, model), len(given)
    kind = p["in"].dtype
    n = int((wanted[1:] >= 0).sum())
    logp, _, out, dh = chosen(p, f["h"], given, wanted, model, max(1, n))
    g = {"out": out[:WIDTH], "bias": out[WIDTH]}
    a, x, scaled = f["a"], f["x"][:blocks], f["scaled"]
    dv = _space("dv", (blocks + 1, BLOCK, WIDTH), kind)  # by the sums of values, for no query before the first and after the last
    np.multiply(dh, f["share"][:, :, None], out=dv[1:-1])
    dv[0] = dv[-1] = 0
    ds = np.matmul(_pairs(dv), _turned("values", x, scaled[:, 2 * WIDTH :]), out=_space("ds", a.shape, kind))
    mean = _space("mean", (blocks + 1, BLOCK, 1), kind)
    np.matmul(np.multiply(dv[1:-1], f["seen"], out=f["seen"]), np.ones((WIDTH, 1), kind), out=mean[1:-1])
    mean[0] = mean[-1] = 0
    ds -= _pairs(mean)
    ds *= a
    far = (np.ones(blocks, kind) @ ds.reshape(blocks, -1)).reshape(2 * BLOCK, BLOCK)
    g["far"] = np.bincount(_DISTANCE[_CAUSAL], far[_CAUSAL], 2 * BLOCK).astype(kind)
    d = _space("d", (blocks, BLOCK, 3 * WIDTH), kind)
    d[0, :, :WIDTH] = 0
    _by_query(np.matmul(ds, f["k"][:blocks], out=_space("dq", (blocks, 2 * BLOCK, WIDTH), kind)), out=d[1:, :, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), _pairs(f["q"]), out=d[:, :, WIDTH : 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), _pairs(dv), out=d[:, :, 2 * WIDTH :])
    d = d.reshape(-1, 3 * WIDTH)
    x = x.reshape(-1, WIDTH)
    g["qkv"] = sum(x[part].T @ d[part] for part in _halves(len(d)))
    g["qkv"][:, :WIDTH] *= kind.type(WIDTH**-0.5)
    dx = np.matmul(d, scaled.T, out=_space("dx", (blocks * BLOCK, WIDTH), kind))
    dx[BLOCK:] += dh.reshape(-1, WIDTH)
    g["in"] = _row_sums(f["at"].reshape(-1), dx)
    return g, n, float(-logp.sum())


def _row_sums(at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of the rows of x by their number in the embedding."""
    cells = np.take(_CELLS, at, axis=0, out=_space("cells", x.shape, _CELLS.dtype), mode="clip")
    out = np.zeros((ROWS + 1, WIDTH), x.dtype)
    np.add.at(out.reshape(-1), cells.reshape(-1), x.reshape(-1))
    return out[:ROWS]


class Adam:
    """Steps that grow at first and then fall with the square root of their number."""

    def __init__(self, p: dict, rate: float = 0.02):
        self.all = flatten(p)
        self.p = unflatten(self.all, p)
        self.m, self.s = np.zeros_like(self.all), np.zeros_like(self.all)
        self.rate, self.t = rate, 0

    def take(self, g: dict) -> None:
        self.t += 1
        rate = self.rate * min(1.0, self.t / 10) / math.sqrt(1 + self.t / 100)
        x = np.concatenate([g[k].ravel() for k in sorted(g)], out=_space("g", self.all.shape, self.all.dtype))
        by = np.multiply(x, x, out=_space("by", x.shape, x.dtype))
        by -= self.s
        by *= np.float32(0.01)
        self.s += by
        x -= self.m
        x *= np.float32(0.1)
        self.m += x
        np.multiply(self.s, np.float32(1 / (1 - 0.99**self.t)), out=by)
        np.sqrt(by, out=by)
        by += np.float32(1e-6)
        np.divide(self.m, by, out=by)
        by *= np.float32(rate / (1 - 0.9**self.t))
        self.all -= by


def flatten(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflatten(x: np.ndarray, like: dict) -> dict:
    """The parts of x: views, where x is of 32-bit floats."""
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = x[at : at + n].reshape(like[k].shape).astype(np.float32, copy=False)
        at += n
    return out


def in_shards(rows: DataFrame, words: int) -> DataFrame:
    """(shard, text) of rows (doc_id, text), dealt and ordered by a hash of both; rows without id are dealt by place."""
    shards = max(1, min(SHARDS, round(words / SHARD_WORDS)))
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    dealt = rows.select(F.xxhash64("doc_id", F.coalesce("text", F.lit("")), place).alias("h"), "doc_id", "text")
    dealt = dealt.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).repartition("shard")
    return dealt.sortWithinPartitions("shard", "h", "doc_id").select("shard", "text")


def train(rows: DataFrame, key, data, pattern, p: dict, model: Model, words: int, rounds: int) -> dict:
    """Averaged parameters after steps on all ids of all rows (doc_id, text)."""
    end = model.end
    dealt = in_shards(rows, words)
    for turn in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((p, model))

        def run(batches, shared=shared, turn=turn):
            one_blas_thread()
            begun, model = shared.value
            sums, total = 0.0, 0
            shard, learner, seen = None, None, 0
            given = wanted = np.zeros((0, BLOCK), np.int64)  # blocks that have not been stepped on, after one that has

            def steps(last: bool):
                nonlocal given, wanted, seen
                while len(given) > BLOCKS or last and len(given) > 1:
                    g, n, _ = step(learner.p, given[: BLOCKS + 1], wanted[: BLOCKS + 1], model)
                    if n:
                        learner.take(g)
                    seen += n
                    given, wanted = given[BLOCKS:], wanted[BLOCKS:]

            def finish():
                nonlocal sums, total, given, wanted, seen
                steps(True)
                sums, total = sums + flatten(learner.p).astype(np.float64) * seen, total + seen
                given, wanted, seen = given[:0], wanted[:0], 0

            for batch in batches:
                for part in slices(batch, rows=4096, budget=SLICE):
                    number = part.column(0).to_numpy()
                    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
                    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                        if number[i] != shard:
                            if learner:
                                finish()
                            shard, learner = number[i], Adam(begun, 0.02 / (1 + turn))
                        more = layout(*Coded(*split(part.column(1).slice(i, j - i)), subwords(key, data, pattern)).flat(), end)
                        given, wanted = np.concatenate([given, more[0]]), np.concatenate([wanted, more[1]])
                        steps(False)
            if learner:
                finish()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(sums)), -1), pa.int32()), pa.array(np.append(sums, float(total)), pa.float64())], names=["i", "x"])

        sums = dealt.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        if not sums.num_rows:
            return p
        at, x = sums.column("i").to_numpy(), sums.column("x").to_numpy()
        out = np.zeros(len(at) - 1)
        out[at[at >= 0]] = x[at >= 0]
        p = unflatten(out / x[at < 0][0], p)
    return p


def id_scores(p: dict, ids: np.ndarray, each: np.ndarray, model: Model) -> np.ndarray:
    """Natural log probabilities of all ids and ends, text after text."""
    given, wanted = layout(ids, each, model.end)
    found = []
    for i in range(0, len(given) - 1, SCORED):
        f = forward(p, given[i : i + SCORED + 1], wanted[i : i + SCORED + 1], model)
        before = given[i + 1 : i + SCORED + 1].reshape(-1)[f["real"]]
        found.append(f["logp"] + model.inner(before, f["goal"]))
    return np.concatenate(found).astype(np.float64) if found else np.zeros(0)


def score(p: dict, coded: Coded, model: Model) -> np.ndarray:
    """log10 probability of each text's ids and its end."""
    if not len(coded.words):
        return np.zeros(0)
    ids, each = coded.flat()
    return np.add.reduceat(id_scores(p, ids, each, model), np.cumsum(each + 1) - each - 1) / math.log(10)


def scores(docs: DataFrame, held_out, path: str, pattern: str, rounds: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    held_out: a boolean Column; the rows where it is false are learned from.
    """
    spark = docs.sparkSession
    key, data = _shipped(spark, path, pattern)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    learned = rows.where(~F.col("held_out"))
    table, table_path = materialize(count_words(learned), "words")
    n_train = learned.count()
    total = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, distinct = total["n"] + n_train, total["v"] + (n_train > 0)
    below = train_tokens + 0.5 * (distinct + 1)
    top = table.where(F.length("word") <= LONGEST).orderBy(F.desc("c"), "word").limit(TOP).toArrow()

    counted = count_pairs(table, key, data, pattern).toArrow()
    a, b, c = (counted.column(k).to_numpy() for k in ("a", "b", "c"))
    made_model = Model(Table(max(made(key, data, pattern).table) + 1, a.astype(np.int64), b.astype(np.int64), c, n_train))
    p = train(learned, key, data, pattern, beginning(), made_model, total["n"], rounds)

    logs = np.log10((top.column("c").to_numpy() + 0.5) / below)
    known = {word: i for i, word in enumerate(top.column("word").to_pylist())}
    logs = np.append(logs, 0.0)  # the last stands for all that are not listed
    end_log = math.log10((n_train + 0.5) / below)
    model = spark.sparkContext.broadcast((p, made_model, known, logs))
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "score", "words"]

    def run(batches):
        one_blas_thread()
        for batch in batches:
            p, net, known, logs = model.value
            encoder = subwords(key, data, pattern)
            encoder.list_words(known)
            for part in slices(batch, rows=4096, budget=SLICE):
                coded = Coded(*split(part.column(1)), encoder)
                logp = score(p, coded, net)
                n, here = len(coded.words), coded.place[coded.code] >= 0
                base = end_log + np.bincount(coded.text, logs[coded.place][coded.code], n)
                hits = int(n_train > 0) + np.bincount(coded.text, here, n).astype(np.int64)
                rest = np.flatnonzero(~here)
                offsets = pa.array(np.searchsorted(coded.text[rest], np.arange(n + 1)).astype(np.int32))
                words = coded.dictionary.take(pa.array(coded.code[rest]))
                cols = [part.column(0), part.column(2), pa.array(coded.words + 1), pa.array(hits), pa.array(base), pa.array(logp)]
                cols += [pa.ListArray.from_arrays(offsets, words)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<binary>"
    scored, scored_path = materialize(rows.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "scored")
    rest = scored.select("rid", F.explode("words").alias("word"))
    joined = rest.join(table, "word", "left")
    term = F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.5) / F.lit(below))
    more = joined.groupBy("rid").agg(F.sum(term).alias("more"), F.count(F.when(F.col("c") > 0, 1)).alias("more_known"))
    more, _ = materialize(more, "rest")
    out = scored.drop("words").join(more, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
    delete(spark, table_path)
    return out
