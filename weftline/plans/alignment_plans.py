"""Filters, classes and statistics of alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import alignments as ops
from weftline.sources.views import view

from .registry import dual, query

_ERR = "2.0 * diffs / ((end_a - start_a + 1) + (end_b - start_b + 1))"


@query("select cast(diffs as bigint) as diffs, cast(count(*) as bigint) as n, cast(sum(end_a - start_a + 1) as bigint) as total_length from {alignments} where 20 * diffs <= 3 * ((end_a - start_a + 1) + (end_b - start_b + 1)) and least(end_a - start_a + 1, end_b - start_b + 1) >= 10 group by diffs")
def error_length_filter(spark, d):
    kept = ops.filtered(view(spark, d, "alignments"))
    return kept.groupBy(F.col("diffs").cast("long").alias("diffs")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_a") - F.col("start_a") + 1).alias("total_length"))


_FLIP = "(select aln_id, read_a, read_b, fwd, start_a, end_a, start_b, end_b, diffs from {alignments} union all select aln_id, read_b, read_a, fwd, start_b, end_b, start_a, end_a, diffs + 1 from {alignments})"
_CANON = "case when read_b < read_a then {0} else {1} end"


@query(f"""select read_a, read_b, cast(count(*) as bigint) as n, cast(sum(least_diffs) as bigint) as diffs from (select read_a, read_b, min(diffs) over (partition by {', '.join(_CANON.format(a, b) for a, b in (('read_b', 'read_a'), ('start_b', 'start_a'), ('end_b', 'end_a'), ('read_a', 'read_b'), ('start_a', 'start_b'), ('end_a', 'end_b')))}, fwd) as least_diffs
 from {_FLIP} u) x group by read_a, read_b""")
def symmetrised_diffs(spark, d):
    a = view(spark, d, "alignments")
    both = a.unionByName(ops.transposed(a).withColumn("diffs", F.col("diffs") + 1))
    return ops.symmetrised(both).groupBy("read_a", "read_b").agg(F.count(F.lit(1)).alias("n"), F.sum("diffs").alias("diffs"))


_TYPED = """(select a.*, case when a0 and a1 and b0 and b1 then 7 when a0 and a1 then 5 when b0 and b1 then 6 when fwd and a0 and not a1 and b1 and not b0 then 1 when fwd and a1 and not a0 and b0 and not b1 then 2
 when not fwd and a0 and not a1 and b0 and not b1 then 0 when not fwd and a1 and not a0 and b1 and not b0 then 3 else 4 end as kind from (select x.*, start_a <= 150 as a0, end_a >= ra.length - 150 as a1, start_b <= 150 as b0, end_b >= rb.length - 150 as b1
 from {alignments} x join {reads} ra on x.read_a = ra.read_id join {reads} rb on x.read_b = rb.read_id) a)"""


@query(f"select cast(kind as int) as kind, cast(case kind when 0 then 0 when 1 then 2 when 2 then 1 when 3 then 3 when 4 then 4 when 5 then 6 when 6 then 5 else 7 end as int) as transposed, cast(count(*) as bigint) as n from {_TYPED} t group by kind")
def overlap_types(spark, d):
    a, r = view(spark, d, "alignments"), view(spark, d, "reads")
    both = a.join(r.select(F.col("read_id").alias("read_a"), F.col("length").alias("la")), "read_a").join(r.select(F.col("read_id").alias("read_b"), F.col("length").alias("lb")), "read_b")
    kinds = both.select(ops.overlap_type(F.col("la"), F.col("lb"), 150).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.withColumn("transposed", F.element_at(F.array(*map(F.lit, (0, 2, 1, 3, 4, 6, 5, 7))), F.col("kind") + 1))


dual("self_pairs", "select read_a <> read_b as kept, cast(count(*) as bigint) as n from {alignments} group by read_a <> read_b")
dual("overhang_length", f"select kind, cast(sum(case when kind in (0, 1) then length_b - end_b when kind in (2, 3) then start_b else 0 end) as bigint) as added, cast(count(*) as bigint) as n from (select t.*, r.length as length_b from {_TYPED} t join {{reads}} r on t.read_b = r.read_id) u group by kind")
dual("maximality", "select read_b, cast(sum(case when start_a > 50 and start_b > 50 then 1 else 0 end) as bigint) as left_maximal, cast(sum(case when end_a < r.length - 50 and end_b < q.length - 50 then 1 else 0 end) as bigint) as right_maximal from {alignments} a join {reads} r on a.read_a = r.read_id join {reads} q on a.read_b = q.read_id group by read_b")
dual("dedup_containment", """select a.read_a, cast(count(*) as bigint) as kept from (select distinct read_a, read_b, fwd, start_a, end_a, start_b, end_b from {alignments}) a where not exists (select 1 from {alignments} c
 where c.read_a = a.read_a and c.read_b = a.read_b and c.fwd = a.fwd and a.start_a >= c.start_a and a.end_a <= c.end_a and a.start_b >= c.start_b and a.end_b <= c.end_b and (c.end_a - c.start_a > a.end_a - a.start_a or c.end_b - c.start_b > a.end_b - a.start_b)) group by a.read_a""")
dual("interval_stats", """select read_b, cast(count(*) as bigint) as n, cast(count(distinct read_a) as bigint) as reads, cast(sum(end_a - start_a + 1) as bigint) as surface, min(diffs) as least_diffs, max(end_a - start_a + 1) as longest,
 cast(sum(case when start_a <= 150 then 1 else 0 end) as bigint) as at_start from {alignments} group by read_b""")
dual("collision_pairs", "select read_a, start_a, end_a, cast(count(distinct read_b) as bigint) as tags, min(read_b) as first_tag, max(read_b) as last_tag from {alignments} group by read_a, start_a, end_a having count(distinct read_b) > 1")
dual("best_per_group", "select read_a, aln_id, read_b, score from (select *, row_number() over (partition by read_a order by score desc, diffs, aln_id, read_b, start_a, end_a, start_b) as rn from (select *, end_a - start_a + 1 - diffs as score from {alignments}) x) y where rn = 1")
dual("representatives", "select read_b, read_a, start_a, end_a from (select *, row_number() over (partition by read_b order by abs(end_a - start_a + 1 - m), read_a, start_a, end_a, aln_id, start_b, diffs) as rn from (select *, avg(end_a - start_a + 1) over (partition by read_b) as m from {alignments}) x) y where rn = 1")
dual("pair_min_distance", "select least(read_a, read_b) as a, greatest(read_a, read_b) as b, min(diffs) as distance, cast(count(*) as bigint) as n from {alignments} group by least(read_a, read_b), greatest(read_a, read_b)")
_RED = "(select read_a, start_a, end_a from {intervals} where fwd)"
dual("loose_filter", """select a.aln_id, a.read_b, a.start_a, a.start_b, a.diffs, not a_red or not b_red as kept from (select x.*, exists (select 1 from {intervals} i where i.fwd and i.read_a = x.read_a and x.start_a >= i.start_a and x.end_a <= i.end_a and i.end_a - i.start_a >= 60) as a_red,
 exists (select 1 from {intervals} i where i.fwd and i.read_a = x.read_b and x.start_b >= i.start_a and x.end_b <= i.end_a) as b_red from {alignments} x) a""")
dual("tight_filter", """select x.aln_id, x.read_b, x.start_a, x.start_b, x.diffs from {alignments} x where exists (select 1 from {intervals} i where not i.fwd and i.read_a = x.read_a and i.start_a >= x.start_a and i.end_a <= x.end_a)
 and exists (select 1 from {intervals} i where i.read_a = x.read_b and i.start_a <= x.end_b and x.start_b <= i.end_a) and 20 * x.diffs <= 3 * ((x.end_a - x.start_a + 1) + (x.end_b - x.start_b + 1))""")
