"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. If two fingerprints differ in at most two bits, they differ in at most one
bit of some segment. So each fingerprint looks up, for each segment, its own value and the values one bit away, in the
table of all segments' values; the whole distance of what it meets is then verified. Of two values that differ in one
bit, only the one with the bit clear looks the other up. Work is on distinct fingerprints; copies join at the end.

Documents without words have fingerprint zero and are linked like any other. Null texts have no words. A component's
id is its smallest doc_id; null ids count only where there is no other. Repeated rows share a component.

keep_one can ask for a similarity instead of bits: then documents are linked if their sets of shingles have at least that
Jaccard similarity. Fingerprints two bits apart are candidates, found as above, and sets are compared as a whole. No
distance of 64-bit fingerprints bounds the similarity, so the pairs that they miss are found by prefixes. Sets are put in
one order, rare shingles first; two sets that are similar enough share a shingle among the first
n - ceil(similarity * n) + 1 of each. Sets that do are compared, if their sizes and the places of that shingle, the first
that they share, leave room for the similarity, if enough of their prefixes is shared with any set, if bitmaps of odd counts of hashes do not differ in more bits than
similar sets could, and if earlier comparisons have not connected them. A sample of texts says which shingles are common: it
sets the order, and so the cost, but not the result. Equal sets are one; documents without words have the empty
set. Texts are told apart by their MD5, so whole rows move once, at the end.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import delete, map_rows, materialize

SEED, BITS = 42, 64


#: A shingle that is in this many of about SAMPLE texts is common; at most COMMON of them are told apart.
SAMPLE, OFTEN, COMMON = 20_000, 3, 1 << 17
#: Rounds of comparisons before all pairs that remain, and how many members of a group each one is compared with in them.
ROUNDS, TURNS = 2, 12
#: Rows of a small table (about 40 bytes each) up to which it is broadcast; larger ones are joined by a shuffle.
SMALL = 1 << 18
SLACK = 1e-9


def hashes(text: str | None, words_each: int) -> np.ndarray:
    """Hash of each shingle; fewer words than `words_each` are one."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - words_each + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """Signed 64 bits; bit i is set if over half the shingles' hashes have it set."""
    return majority(hashes(text, words_each))


def majority(h: np.ndarray) -> int:
    n = len(h)
    if not n:
        return 0
    count = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)]
        count += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """(doc_id, fp) for each row."""

    def run(cols):
        return {"doc_id": cols["doc_id"], "fp": [fingerprint(t, words_each) for t in cols["text"]]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints fp at most two bits apart."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    sides = distinct.select("fp", F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32)))).alias("key"))
    one_bit = F.array(*(F.col("key").bitwiseOR(F.lit(1 << i)) for i in range(32)))
    ball = F.concat(F.array("key"), F.filter(one_bit, lambda x: x != F.col("key")))
    probes = sides.select(F.col("fp").alias("p"), F.col("key").alias("own"), F.explode(ball).alias("key"))
    met = probes.join(sides.withColumnRenamed("fp", "q"), "key")
    near = (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= 2) & ((F.col("key") != F.col("own")) | (F.col("p") < F.col("q")))
    return met.where(near).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def connect(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(v, c) for each end of an edge: c is the least end that it is connected with.

    Labels fall to the least label around and then to that label's own; a round more than halves the way.
    """
    spark = edges.sparkSession
    both, kept = materialize(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))), "links")
    labels, path = materialize(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("c")), "labels")
    for _ in range(most_rounds):
        around = both.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("m"))
        fallen = labels.join(around, "v").select("v", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved"))
        fallen, half = materialize(fallen, "labels")
        moved = not fallen.where("moved").isEmpty()
        if moved:
            jump = fallen.select(F.col("v").alias("c"), F.col("c").alias("cc"))
            after, new = materialize(fallen.drop("moved").join(jump, "c", "left").select("v", F.coalesce("cc", "c").alias("c")), "labels")
            delete(spark, path)
            labels, path = after, new
        delete(spark, half)
        if not moved:
            delete(spark, kept)
            return labels
    raise RuntimeError("components did not settle")


def components(docs: DataFrame, words_each: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp), and (fp, component_id, label) for each distinct fp; label is the component's least fp."""
    spark = docs.sparkSession
    rows, _ = materialize(fingerprints(docs, words_each), "fingerprints")
    distinct, one = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    edges, two = materialize(links(distinct), "edges")
    labels = connect(edges)
    named = labels.join(distinct.withColumnRenamed("fp", "v"), "v")
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named, three = materialize(labels.join(least, "c").select(F.col("v").alias("fp"), "component_id", "c"), "named")
    found = distinct.join(named, "fp", "left")
    table, _ = materialize(found.select("fp", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("c", "fp").alias("label")), "components")
    for path in (one, two, three):
        delete(spark, path)
    return rows, table


def classify(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    rows, table = components(docs, words_each)
    return rows.join(table, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Bits of the bitmap, as signed words: each shingle turns one over, so sets differ in as many shingles as bits, or more.
PARITY = 256
WORDS = tuple(f"b{i}" for i in range(PARITY // 64))


def parity(h: np.ndarray) -> list[int]:
    odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


def distinct_of(h: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct hashes in ascending order, and a digest of them, signed."""
    h = np.unique(h)
    return h, int(np.uint64(xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), SEED)).view(np.int64))


def common_shingles(docs: DataFrame, words_each: int) -> np.ndarray:
    """Hashes of the shingles that a sample of texts has often, the least frequent first."""
    step = max(1, docs.count() // SAMPLE)

    def run(cols):
        found = [np.unique(hashes(t, words_each)).view(np.int64) for t in cols["text"]]
        return {"key": np.concatenate(found) if found else np.zeros(0, np.int64)}

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)
    counts = map_rows(some, run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= OFTEN)
    return counts.orderBy(F.desc("c"), "key").limit(COMMON).toArrow().column("key").to_numpy()[::-1].view(np.uint64)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key) of each row; equal texts have equal keys, and null counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"))


def marks(docs: DataFrame, words_each: int, similarity: float | None) -> DataFrame:
    """(doc_id, text_key, fp, digest, n, prefix, b0, ...) of each row: fingerprint, digest and number of the distinct
    shingles, those of them that are in the prefix, and their bitmap; without a similarity there is no prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(None)
    if similarity is not None:
        common = common_shingles(docs, words_each)
        by_hash = np.argsort(common)
        shared = docs.sparkSession.sparkContext.broadcast((common[by_hash], by_hash))

    def one(text):
        every = hashes(text, words_each)
        h, digest = distinct_of(every)
        n = len(h)
        if similarity is None:
            return majority(every), digest, n, [], *parity(h)
        known, rank = shared.value
        if len(known) and n:
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            often = known[at] == h
            h = np.concatenate([h[~often], h[often][np.argsort(rank[at[often]])]])
        return majority(every), digest, n, h[: n - math.ceil(similarity * n - SLACK) + 1].view(np.int64), *parity(h)

    def run(cols):
        found = [one(t) for t in cols["text"]]
        return {k: cols[k] for k in ("doc_id", "text_key")} | {k: [x[i] for x in found] for i, k in enumerate(("fp", "digest", "n", "prefix", *WORDS))}

    schema = "doc_id long, text_key binary, fp long, digest long, n int, prefix array<long>, " + ", ".join(f"{w} long" for w in WORDS)
    return map_rows(keyed(docs), run, schema)


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def sets_of(docs: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """(digest, shingles) once for each of the wanted (digest, text_key), from the texts with these keys."""

    def run(cols):
        return {"digest": cols["digest"], "shingles": [np.unique(hashes(t, words_each)).view(np.int64) for t in cols["text"]]}

    texts = keyed(docs).select("text_key", "text").join(small(wanted), "text_key").select("digest", "text")
    return map_rows(texts, run, "digest long, shingles array<long>").dropDuplicates(["digest"])


def similar(pairs: DataFrame, docs: DataFrame, marked: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose whole sets have the similarity."""
    digests = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    wanted, one = materialize(marked.join(digests, "digest").groupBy("digest").agg(F.min("text_key").alias("text_key")), "wanted")
    sets, two = materialize(sets_of(docs, wanted, words_each), "sets", "lz4")
    x = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("x", "y"))
    found, _ = materialize(both.where(common * (1 + similarity) + SLACK >= similarity * (F.size("x") + F.size("y"))).select("a", "b"), "similar")
    for path in (one, two):
        delete(docs.sparkSession, path)
    return found


def bit_pairs(table: DataFrame) -> DataFrame:
    """Pairs (a, b) of digests by fingerprints: those of one fingerprint with its least, and the least of fingerprints two
    bits apart."""
    least, path = materialize(table.groupBy("fp").agg(F.min("digest").alias("least"), F.max("digest").alias("most")), "fingerprints")
    within = table.join(least.where("least < most"), "fp").where("digest <> least").select(F.col("least").alias("a"), F.col("digest").alias("b"))
    near = links(least).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    pairs, _ = materialize(within.unionAll(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct(), "bit-pairs")
    delete(table.sparkSession, path)
    return pairs


def similar_labels(docs: DataFrame, marked: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """(digest, label) for each distinct set of shingles that is linked with another; label is the component's least."""
    spark, paths = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = materialize(df, name)
        paths.append(path)
        return df

    # shingles are dealt with digests and places alone; sizes and bitmaps join where a shingle is shared
    entries = marked.select("digest", F.posexplode("prefix").alias("pos", "key"))
    of_key = W.partitionBy("key")
    entries = entries.withColumns({"least": F.min("digest").over(of_key), "most": F.max("digest").over(of_key)}).where("least < most")
    shared = kept(entries.select("key", "digest", "pos").distinct(), "shared")
    sizes = marked.select("digest", "n", (F.col("n") - F.size("prefix")).alias("rest"), *WORDS).dropDuplicates(["digest"])
    onward = F.count(F.lit(1)).over(W.partitionBy("digest").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0))
    members = kept(shared.withColumn("onward", onward.cast("int")).join(sizes, "digest").withColumn("c", F.col("digest")), "members")

    def may(x, y):
        """Different components, and room for the similarity in what comes from this shingle on: what follows in either set,
        and what is shared in both prefixes with what is beyond the prefix that ends first (at most the larger rest)."""
        n, m = x["n"], y["n"]
        room = F.least(n - x["pos"], m - y["pos"], F.least(x["onward"], y["onward"]) + F.greatest(x["rest"], y["rest"]))
        differ = sum((F.bit_count(x[w].bitwiseXOR(y[w])) for w in WORDS), F.lit(0))
        may_differ = n + m - 2 * F.ceil((n + m) * (similarity / (1 + similarity)) - SLACK)
        return (differ <= may_differ) & (x["c"] != y["c"]) & (similarity * F.greatest(n, m) <= F.least(n, m) + SLACK) & (room * (1 + similarity) + SLACK >= similarity * (n + m))

    # members of a large group come together through few comparisons: each with TURNS members that share keys
    pairs = bit_pairs(marked.select("fp", "digest").distinct())
    member, edges = F.struct("digest", "n", "pos", "onward", "rest", "c", *WORDS), None
    for turn in range(ROUNDS):
        members = members.repartition("key")  # dealt once: pivots are found where the members are, and never move
        pivots = F.array_distinct(F.array(*(F.min_by(member, F.xxhash64("digest", F.lit(turn * TURNS + i))) for i in range(TURNS))))
        pivot = members.groupBy("key").agg(pivots.alias("p"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
        star = members.withColumn("x", member).join(pivot.select("key", "p"), "key").select("x", F.explode("p").alias("y")).where(may(F.col("x"), F.col("y")))
        star = star.select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b"))
        found = similar(kept((star if edges is not None else pairs.unionAll(star)).distinct(), "stars"), docs, marked, words_each, similarity)
        edges = found if edges is None else edges.unionAll(found)
        labels = connect(edges).withColumnRenamed("v", "digest").withColumnRenamed("c", "label")
        members = members.join(small(labels), "digest", "left").withColumn("c", F.coalesce("label", "c")).drop("label")
    x, y = members.select("key", member.alias("x")), members.select("key", member.alias("y"))
    cross = x.join(y, "key").where((F.col("x.digest") < F.col("y.digest")) & may(F.col("x"), F.col("y")))
    pairs = kept(cross.select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b")).distinct(), "pairs")
    more = similar(pairs, docs, marked, words_each, similarity)
    labels, _ = materialize(connect(edges.unionAll(more)).select(F.col("v").alias("digest"), F.col("c").alias("label")), "labelled")
    for path in paths:
        delete(spark, path)
    return labels


def keep_one(docs: DataFrame, words_each: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (null last), then of the least MD5 of
    its text, one of them if it repeats.

    Components are those of fingerprints two bits apart or, with a similarity, those of sets of shingles that have it.
    An empty table gives an empty one; columns may have any names.
    """
    spark = docs.sparkSession
    marked, one = materialize(marks(docs, words_each, similarity), "marks")
    if similarity is None:
        marked = marked.withColumn("digest", F.col("fp"))
        labels = connect(links(marked.select("fp").distinct())).select(F.col("v").alias("digest"), F.col("c").alias("label"))
    else:
        labels = similar_labels(docs, marked, words_each, similarity)
    rows = marked.select("doc_id", "text_key", "digest").join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    each = rows.groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    first = each.groupBy("label").agg(F.min_by(F.struct("doc_id", "text_key", "n"), order).alias("w")).select("label", "w.*")
    first, _ = materialize(first, "kept")
    delete(spark, one)
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key")
    )

    def of(chosen: DataFrame) -> DataFrame:
        return packed.join(small(chosen), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))).select("row", "label")

    kept = of(first.where("n = 1"))
    repeated = first.where("n > 1")
    if not repeated.isEmpty():
        kept = kept.unionAll(of(repeated).dropDuplicates(["label"]))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
