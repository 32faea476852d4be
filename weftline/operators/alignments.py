"""Filters and classes of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def error_rate() -> Column:
    surface = (F.col("end_a") - F.col("start_a") + 1) + (F.col("end_b") - F.col("start_b") + 1)
    return 2 * F.col("diffs") / surface


def filtered(df: DataFrame, most_error: float = 0.3, least_length: int = 10) -> DataFrame:
    shorter = F.least(F.col("end_a") - F.col("start_a") + 1, F.col("end_b") - F.col("start_b") + 1)
    return df.where((error_rate() <= most_error) & (shorter >= least_length))


def symmetrised(df: DataFrame) -> DataFrame:
    """Both directions of an alignment take the smaller number of differences: a minimum over the canonical form."""
    swap = F.col("read_b") < F.col("read_a")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    key = [pick("read_a", "read_b"), pick("start_a", "start_b"), pick("end_a", "end_b"), pick("read_b", "read_a"), pick("start_b", "start_a"), pick("end_b", "end_a"), F.col("fwd")]
    return df.withColumn("diffs", F.min("diffs").over(W.partitionBy(*key)))


def transposed(df: DataFrame) -> DataFrame:
    return df.select("aln_id", F.col("read_b").alias("read_a"), F.col("read_a").alias("read_b"), "fwd", F.col("start_b").alias("start_a"), F.col("end_b").alias("end_a"), F.col("start_a").alias("start_b"), F.col("end_a").alias("end_b"), "diffs")


def overlap_type(len_a: Column, len_b: Column, t: int) -> Column:
    """0 prefix-prefix, 1 prefix-suffix, 2 suffix-prefix, 3 suffix-suffix, 4 other, 5 A whole, 6 B whole, 7 both whole."""
    a0, a1 = F.col("start_a") <= t, F.col("end_a") >= len_a - t
    b0, b1 = F.col("start_b") <= t, F.col("end_b") >= len_b - t
    pa, sa, pb, sb = a0 & ~a1, a1 & ~a0, b0 & ~b1, b1 & ~b0
    fwd = F.col("fwd")
    return (
        F.when(a0 & a1 & b0 & b1, 7).when(a0 & a1, 5).when(b0 & b1, 6)
        .when(fwd & pa & sb, 1).when(fwd & sa & pb, 2).when(~fwd & pa & pb, 0).when(~fwd & sa & sb, 3).otherwise(4)
    )
