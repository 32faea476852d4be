"""Balanced label propagation: documents linked by equal texts move to the shard where most of their group is.

Every document starts in a shard by its place in a hashed order, so counts are at most one apart. In each round a
linked document wants the shard that holds most of its group. Moves are taken as circuits: into a shard go as many as
leave it in the same round, and as many more as it has unlinked documents to give up, which fill the places that movers
left elsewhere. So counts never change, and cut edges fall with each move. Rounds go on until STILL of them in turn, with
equals broken otherwise in each, find no circuit, or nobody wants to move. Groups larger than a shard are split by hash
into units of that size, and each unit gathers by itself.

Tables of at most shards * shards counts reach the driver; groups never meet in one task. Null texts count as empty
texts. Null ids are ids like any other, repeated rows are documents of their own, and empty tables give empty tables.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, distributed_rank, materialize

BUCKET_ROWS, LEAST_BUCKETS, STILL = 1 << 18, 256, 4


def _places(df: DataFrame, buckets: int, keys: list[str], name: str) -> DataFrame:
    """Ranks within keys in order of a hashed row number."""
    bucketed = df.withColumn("_b", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int"))
    return distributed_rank(bucketed, keys, ["_b"], ["rid"], name).drop("_b")


def start(docs: DataFrame, shards: int) -> tuple[DataFrame, str, int]:
    """Rows (rid, doc_id, size, text_crc32, unit, shard), their path and a number of buckets; unit is null where no other
    text is equal."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("same"),
    )
    base, raw = materialize(base.withColumn("h", F.xxhash64("doc_id", "same")), "shard-rows")
    n = base.count()
    buckets = max(LEAST_BUCKETS, -(-n // BUCKET_ROWS))
    bucketed = base.withColumn("_b", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    ranked, ranks = materialize(distributed_rank(bucketed, [], ["_b"], ["h", "doc_id", "same"], "rid").drop("_b", "h"), "shard-ranks")
    delete(base.sparkSession, raw)
    groups, _ = materialize(ranked.groupBy("same").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shard-groups")
    largest = max(1, n // shards)
    unit = F.when(F.col("members").isNotNull(), F.xxhash64("same", F.pmod(F.xxhash64("rid", F.lit(1)), F.ceil(F.col("members") / largest))))
    state = ranked.join(groups, "same", "left").select("rid", "doc_id", "size", "text_crc32", unit.alias("unit"), (F.col("rid") % shards).cast("int").alias("shard"))
    state, path = materialize(state, "shard-state")
    delete(base.sparkSession, ranks)
    return state, path, buckets


def fill_plan(moves: list[tuple[int, int, int]], shards: int) -> tuple[list[int], list[int], list[int]]:
    """From accepted moves (from, to, rows): how many unlinked rows each shard gives up, where its own begin among
    all given up, and up to which of them each shard takes in."""
    net = [0] * shards
    for a, b, n in moves:
        net[a] -= n
        net[b] += n
    give = [max(0, x) for x in net]
    begin = [sum(give[:i]) for i in range(shards)]
    take = [max(0, -x) for x in net]
    return give, begin, [sum(take[: i + 1]) for i in range(shards)]


def admit(wanted: list[tuple[int, int, int]], free: list[int]) -> list[tuple[int, int, int]]:
    """The part of the wanted moves (from, to, rows) that circuits allow. A circuit goes through wanted moves, and from a
    shard to any other as unlinked rows, of which a shard has `free`. No circuit is left."""
    pool = len(free)
    left: list[dict[int, int]] = [{} for _ in range(pool + 1)]
    for a, b, n in wanted:
        left[a][b] = n
    for a, n in enumerate(free):
        left[a][pool] = n  # after the moves: shards are met first
    left[pool] = dict.fromkeys(range(pool), sum(free))
    taken: dict[tuple[int, int], int] = {}
    for a, b, _ in wanted:
        while left[a][b]:
            before, line = {b: b}, deque([b])
            while line and a not in before:
                x = line.popleft()
                for y, n in left[x].items():
                    if n and y not in before:
                        before[y] = x
                        line.append(y)
            if a not in before:
                break
            way = [(a, b)]
            while a != b:
                way.append((before[a], a))
                a = before[a]
            a = way[0][0]
            n = min(left[x][y] for x, y in way)
            for x, y in way:
                left[x][y] -= n
                if x != pool and y != pool:
                    taken[x, y] = taken.get((x, y), 0) + n
    return sorted((a, b, n) for (a, b), n in taken.items())


def propagate(state: DataFrame, state_path: str, shards: int, buckets: int) -> DataFrame:
    spark, turn, still = state.sparkSession, 0, 0
    while still < STILL:
        turn += 1
        linked = state.where("unit is not null")
        most = linked.groupBy("unit", "shard").agg(F.count(F.lit(1)).alias("n"))
        most = most.groupBy("unit").agg(F.max_by("shard", F.struct("n", F.xxhash64("unit", "shard", F.lit(turn)))).alias("to"), F.count(F.lit(1)).alias("parts"))
        most, wants = materialize(most.where("parts > 1").drop("parts"), "shard-wants")
        movers = state.join(most, "unit").where("shard <> to").select("rid", "shard", "to")
        movers, path = materialize(_places(movers, buckets, ["shard", "to"], "place"), "shard-movers")
        wanted = [tuple(r) for r in movers.groupBy("shard", "to").count().orderBy("shard", "to").collect()]
        free = [0] * shards
        for r in state.where("unit is null").groupBy("shard").count().collect():
            free[r["shard"]] = r["count"]
        moves = admit(wanted, free)
        if not moves:
            delete(spark, wants)
            delete(spark, path)
            if not wanted:
                break
            still += 1
            continue
        still = 0
        columns = [pa.array(x, t) for x, t in zip(zip(*moves, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)]
        quota = spark.createDataFrame(pa.table(columns, names=["shard", "to", "quota"]))
        accepted = movers.join(F.broadcast(quota), ["shard", "to"]).where(F.col("place") < F.col("quota"))
        give, begin, upto = fill_plan(moves, shards)
        at = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("shard") + 1)
        giving = state.where("unit is null").where(at(give) > 0)
        given = _places(giving.select("rid", "shard"), buckets, ["shard"], "place").where(F.col("place") < at(give))
        place = at(begin) + F.col("place")
        to = F.size(F.filter(F.array(*(F.lit(int(v)) for v in upto)), lambda x: x <= place)).cast("int")
        changes = accepted.select("rid", "to").unionAll(given.select("rid", to.alias("to")))
        state, new = materialize(state.join(changes, "rid", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "shard-state")
        for old in (wants, path, state_path):
            delete(spark, old)
        state_path = new
    return state


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0 without gaps) for each row of docs."""
    state, path, buckets = start(docs, shards)
    state = propagate(state, path, shards, buckets)
    return _places(state, buckets, ["shard"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
