"""Closed-interval algebra as Columns: all functions take and give Columns of whole numbers, ends included."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Approximate identity and containment (fixed values): a distance, a share of the shorter interval, a strict margin.
DISTANCE, SHARE, MARGIN = 100, 0.25, 10


def length(s: Column, e: Column) -> Column:
    return e - s + 1


def intersect(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s2 <= e1) & (s1 <= e2)


def intersection_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def union_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return length(s1, e1) + length(s2, e2) - intersection_length(s1, e1, s2, e2)


def jaccard(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return intersection_length(s1, e1, s2, e2) / union_length(s1, e1, s2, e2)


def contained(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 >= s2) & (e1 <= e2)


def approximately_identical(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    shorter = F.least(length(s1, e1), length(s2, e2))
    t = F.least(F.lit(DISTANCE), F.floor(shorter * SHARE))
    return (F.abs(s1 - s2) <= t) & (F.abs(e1 - e2) <= t)


def approximately_contained(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    shorter = length(s1, e1) < length(s2, e2)
    return shorter & (((s1 > s2 - MARGIN) & (e1 <= e2 + DISTANCE)) | ((e1 < e2 + MARGIN) & (s1 >= s2 - DISTANCE)))


def straddle(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return ((s1 < s2) & (e1 >= s2) & (e1 < e2)) | ((s2 < s1) & (e2 >= s1) & (e2 < e1))


def project(x: Column, y: Column, sa: Column, ea: Column, sb: Column, eb: Column, fwd: Column) -> tuple[Column, Column]:
    """[x..y] on A, clipped to the alignment, carried over to B in proportion; steps are cut to whole numbers."""
    ratio = length(sb, eb) / length(sa, ea)
    left, right = F.greatest(x, sa) - sa, ea - F.least(y, ea)
    low, high = (ratio * left).cast("int"), (ratio * right).cast("int")
    return F.when(fwd, sb + low).otherwise(sb + high), F.when(fwd, eb - high).otherwise(eb - low)
