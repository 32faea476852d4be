"""Sets of intervals per key: islands, gaps, differences, coverage profiles and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def islands(df: DataFrame, keys: list[str], start: str = "start_a", end: str = "end_a") -> DataFrame:
    """Union of the intervals of each key as disjoint islands; adjacent ones merge."""
    w = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0)
    marked = df.select(*keys, start, end).withColumn("_fresh", fresh)
    numbered = marked.withColumn("_island", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def surface(df: DataFrame, keys: list[str], start: str = "start_a", end: str = "end_a") -> DataFrame:
    """Islands and covered length of each key."""
    return islands(df, keys, start, end).groupBy(*keys).agg(F.count(F.lit(1)).alias("islands"), F.sum(F.col(end) - F.col(start) + 1).alias("covered"))


def gaps(df: DataFrame, lengths: DataFrame, key: str, start: str = "start_a", end: str = "end_a", size: str = "length") -> DataFrame:
    """Complement of each key's union in [0..length-1], flanks included; a key without intervals is one gap."""
    w = W.partitionBy(key).orderBy(start)
    found = lengths.join(islands(df, [key], start, end), key, "left").withColumns({"_last": F.lag(end).over(w), "_next": F.lead(start).over(w)})
    pieces = F.array(
        F.struct((F.coalesce("_last", F.lit(-1)) + 1).alias("s"), (F.coalesce(F.col(start), F.col(size)) - 1).alias("e")),
        F.struct((F.col(end) + 1).alias("s"), F.when(F.col("_next").isNull(), F.col(size) - 1).alias("e")),
    )
    out = found.select(key, F.explode(pieces).alias("g")).where("g.s <= g.e")
    return out.select(key, F.col("g.s").alias("gap_start"), F.col("g.e").alias("gap_end"))


def profile(df: DataFrame, keys: list[str], start: str = "start_a", end: str = "end_a") -> DataFrame:
    """Segments of equal positive coverage: events are summed up in order."""
    steps = df.select(*keys, F.col(start).alias("pos"), F.lit(1).alias("d")).unionAll(df.select(*keys, (F.col(end) + 1).alias("pos"), F.lit(-1).alias("d")))
    steps = steps.groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    w = W.partitionBy(*keys).orderBy("pos")
    out = steps.withColumn("coverage", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("seg_end", F.lead("pos").over(w) - 1)
    return out.where("coverage > 0").select(*keys, F.col("pos").alias("seg_start"), "seg_end", "coverage")


def exclusive(df: DataFrame, keys: list[str], item: str, start: str = "start_a", end: str = "end_a") -> DataFrame:
    """Length that exactly one item of each key covers: items' islands, swept; where one is open, its number is the sum."""
    own = islands(df, [*keys, item], start, end)
    sign = lambda at, d: own.select(*keys, at.alias("pos"), F.lit(d).alias("d"), (F.col(item) * d).alias("who"))
    steps = sign(F.col(start), 1).unionAll(sign(F.col(end) + 1, -1)).groupBy(*keys, "pos").agg(F.sum("d").alias("d"), F.sum("who").alias("who"))
    w = W.partitionBy(*keys).orderBy("pos")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    swept = steps.select(*keys, F.sum("d").over(run).alias("n"), F.sum("who").over(run).alias(item), (F.lead("pos").over(w) - F.col("pos")).alias("len"))
    return swept.where("n = 1").groupBy(*keys, item).agg(F.sum("len").alias("exclusive"))


def range_join(left: DataFrame, right: DataFrame, key: str, cond: Column, bin_size: int) -> DataFrame:
    """left (l) and right (r) rows of one key that meet cond, by bins of positions: both sides' intervals are put in each
    bin that they touch, and a pair is taken in the first bin that both touch. Columns s, e are the intervals."""
    binned = lambda df: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("s") / bin_size), F.floor(F.col("e") / bin_size))))
    first = F.floor(F.greatest(F.col("l.s"), F.col("r.s")) / bin_size)
    on = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l._bin") == F.col("r._bin")) & (F.col("l._bin") == first) & cond
    return binned(left).alias("l").join(binned(right).alias("r"), on)
