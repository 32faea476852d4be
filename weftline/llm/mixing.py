"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Within a source each document has the same number of expected copies, target words over source words. The prefix
sums of the expected copies, moved by one offset for the source, cross whole numbers; a document is emitted once
for each number that its own step crosses, so at most `cap` times where a target is at most `cap` times the size.
Documents are summed up in order of size class, so that short and long ones are taken alike and the words taken come
near the target. The order within a class follows a hash, whose buckets can be summed up apart: no source meets in
one task. The offset is a hash of the source; reruns agree.

Null texts have no words; null sources are one source, the last. An empty table, or one without words, takes nothing.
Repeated rows are documents of their own. Long texts are counted whole. emit() keeps every column of docs, whatever its
name; mix() gives the columns _mix_size, _mix_source_size, _mix_target and _mix_copies beside them, in place of columns
of docs with these names. The table of sources is sorted in one task: a row of some 40 bytes for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD

#: Rows of a size class that a bucket holds on average, beyond which classes get more buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 18, 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes for each power of two; monotone. Sizes under eight are classes of their own."""
    bits = F.length(F.bin(size))
    top = F.expr("_mix_size div cast(pow(2, greatest(0, length(bin(_mix_size)) - 4)) as bigint)") % 8
    return F.when(size < 8, size).otherwise(bits * 8 + top).cast("int")


def hashed(text: Column) -> Column:
    """32 bits of MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: list[int], percent: int, cap: int) -> DataFrame:
    """_mix_source, _mix_source_size -> also _mix_target: min(cap * size, level * weight), with one level for all sources.

    That is where resharing the excess by weight ends: sources come in order of cap over weight, and the level is
    what is left for a source and those after it, by weight, at the first source that stays below its cap.
    There are few sources, so a window over all of them is small.
    """
    nth = W.orderBy(F.col("_mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(nth) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_mix_weight", weight.cast("long")).withColumn("_mix_total", F.sum("_mix_source_size").over(W.partitionBy()))
    by = W.orderBy((F.col("_mix_source_size") / F.col("_mix_weight")).asc(), F.col("_mix_source").asc_nulls_last())
    before = F.coalesce(F.sum("_mix_source_size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_mix_weight").over(by.rowsBetween(0, W.unboundedFollowing))
    level = (F.lit(percent) * F.col("_mix_total") - F.lit(100 * cap) * before) / (F.lit(100) * rest)
    s = s.withColumn("_mix_level", level).withColumn("_mix_below", F.col("_mix_level") * F.col("_mix_weight") <= cap * F.col("_mix_source_size"))
    # beyond the first of them, sources that are not capped would be taken off as if they were
    s = s.withColumn("_mix_nth", F.row_number().over(by))
    first = F.min(F.when(F.col("_mix_below"), F.struct("_mix_nth", "_mix_level"))).over(W.partitionBy())["_mix_level"]
    target = F.least(F.col("_mix_source_size") * F.lit(float(cap)), F.coalesce(first, F.lit(float("inf"))) * F.col("_mix_weight"))
    return s.select("_mix_source", "_mix_source_size", target.cast("double").alias("_mix_target"))


def _same(keys: list[str]) -> Column:
    """Null-safe on all keys: a plain equation would have the sizes worked out once more, to filter out nulls."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}_o"))
    return out


OUT = ("_mix_size", "_mix_source_size", "_mix_target", "_mix_copies")


def _sized(docs: DataFrame) -> DataFrame:
    """One struct holds the caller's columns, so none of their names can meet a working one."""
    row = F.col("_mix_row")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_mix_row")).select(
        "_mix_row", row["source"].alias("_mix_of"), n_words(row["text"]).alias("_mix_size"), hashed(F.coalesce(row["doc_id"].cast("string"), F.lit(""))).alias("_mix_h"),
        row["doc_id"].alias("_mix_id"),
    )


def mix(docs: DataFrame, weights: list[int] = (5, 2, 1), percent: int = 150, cap: int = 2) -> DataFrame:
    """docs with _mix_size, _mix_source_size, _mix_target and _mix_copies."""
    mixed = mix_sized(_sized(docs), weights, percent, cap)
    return mixed.select(*(F.col("_mix_row")[c].alias(c) for c in docs.columns if c not in OUT), *OUT)


def mix_sized(sized: DataFrame, weights: list[int] = (5, 2, 1), percent: int = 150, cap: int = 2) -> DataFrame:
    """Rows with _mix_of (their source), _mix_size, _mix_h and _mix_id get the columns of mix()."""
    sums = sized.groupBy(F.col("_mix_of").alias("_mix_source")).agg(F.sum("_mix_size").alias("_mix_source_size"), F.count(F.lit(1)).alias("_mix_rows"))
    salts = F.greatest(F.lit(LEAST_BUCKETS), F.ceil(F.sum("_mix_rows").over(W.partitionBy()) / BUCKET_ROWS)).cast("long")
    sums = sums.withColumn("_mix_salts", salts)
    aimed = targets(sums.select("_mix_source", "_mix_source_size"), list(weights), percent, cap)
    aimed = aimed.alias("t").join(sums.select("_mix_source", "_mix_salts").alias("s"), F.col("t._mix_source").eqNullSafe(F.col("s._mix_source")))
    aimed = aimed.select("t.*", "_mix_salts")

    keyed = sized.join(aimed, F.col("_mix_of").eqNullSafe(F.col("_mix_source")))
    keyed = keyed.withColumn("_mix_class", size_class(F.col("_mix_size"))).withColumn("_mix_bucket", F.col("_mix_h") % F.col("_mix_salts"))
    keys = ["_mix_source", "_mix_class", "_mix_bucket"]
    counts = (
        sized.select("_mix_of", "_mix_size", "_mix_h")
        .join(aimed, F.col("_mix_of").eqNullSafe(F.col("_mix_source")))
        .groupBy("_mix_source", size_class(F.col("_mix_size")).alias("_mix_class"), (F.col("_mix_h") % F.col("_mix_salts")).alias("_mix_bucket"))
        .agg(F.count(F.lit(1)).alias("_mix_n"))
    )
    before = W.partitionBy("_mix_source").orderBy("_mix_class", "_mix_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*(F.col(k).alias(f"{k}_o") for k in keys), F.coalesce(F.sum("_mix_n").over(before), F.lit(0)).alias("_mix_start"))
    order = ["_mix_size", "_mix_h", F.col("_mix_id").asc_nulls_first()]
    ranked = keyed.withColumn("_mix_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    joined = ranked.join(starts, _same(keys))
    at = F.col("_mix_start") + F.col("_mix_rank")
    # offsets are multiples of 1/1024 plus a half of one, so sums that come to whole copies stay clear of the next number
    offset = (hashed(F.coalesce(F.concat(F.lit("source:"), F.col("_mix_source")), F.lit("none"))) % 1024 + 0.5) / 1024
    each = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    copies = F.least(F.lit(cap), F.floor((at + 1) * each + offset) - F.floor(at * each + offset)).cast("int")
    return joined.select(*sized.columns, "_mix_source_size", "_mix_target", copies.alias("_mix_copies"))


def emit(docs: DataFrame, weights: list[int] = (5, 2, 1), percent: int = 150, cap: int = 2) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it."""
    mixed = mix_sized(_sized(docs), weights, percent, cap)
    times = F.explode(F.array_repeat(F.lit(1), F.col("_mix_copies")))
    return mixed.select("_mix_row", times.alias("_mix_time")).select(*(F.col("_mix_row")[c].alias(c) for c in docs.columns))
