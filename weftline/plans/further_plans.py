"""Paths, edits and labels of graphs, bits, signals, classes of alike intervals and recall by positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph as ops
from weftline.sources import views

from .registry import dual, query

# all ways from a node that no link enters to one that none leaves, as lists of nodes; a component has at most ten
_STEPS = ["p1 as (select src as s, dst as t, concat(cast(src as varchar), '>', cast(dst as varchar)) as path from {dag} d where not exists (select 1 from {dag} e where e.dst = d.src))"]
_STEPS += [f"p{i} as (select p.s, d.dst as t, concat(p.path, '>', cast(d.dst as varchar)) as path from p{i - 1} p join {{dag}} d on d.src = p.t)" for i in range(2, 10)]
_PATHS = "with " + ", ".join(_STEPS) + " select s, t, links, path from (" + " union all ".join(f"select s, t, {i} as links, path from p{i}" for i in range(1, 10)) + ") x where not exists (select 1 from {dag} e where e.src = x.t)"
dual("path_lists", _PATHS, _PATHS.replace("varchar", "string"))
# walks of three links that do not turn back, by the labels (last digits) of their nodes
dual("labelled_walks", "with e as (select src as a, dst as b from {dag} union select dst, src from {dag}) select x.a % 10 as l1, x.b % 10 as l2, y.b % 10 as l3, z.b % 10 as l4, cast(count(*) as bigint) as walks from e x join e y on y.a = x.b and y.b <> x.a join e z on z.a = y.b and z.b <> y.a group by x.a % 10, x.b % 10, y.b % 10, z.b % 10")
# without nodes that have one link, and with what is left numbered from 0 in order
_DEGREE = "select a as node, count(*) as degree from (select src as a from {dag} union all select dst from {dag}) q group by a"
dual("pruned_graph", f"with k as (select node, row_number() over (order by node) - 1 as new_id from ({_DEGREE}) g where degree > 1) select cast(x.new_id as bigint) as src, cast(y.new_id as bigint) as dst from {{dag}} d join k x on x.node = d.src join k y on y.node = d.dst")
# bits of small whole numbers: how many are set, the lowest, the highest, and a mask test
dual("bit_functions", "select diffs, cast(bit_count(diffs) as int) as ones, cast(diffs & -diffs as int) as lowest, cast(max(start_a & 31) as int) as low_five, cast(sum(case when start_a & 12 = 12 then 1 else 0 end) as bigint) as both_set, cast(max(start_a << 2) as bigint) as shifted from {alignments} group by diffs", "select diffs, cast(bit_count(diffs) as int) as ones, cast(diffs & -diffs as int) as lowest, cast(max(start_a & 31) as int) as low_five, cast(sum(case when (start_a & 12) = 12 then 1 else 0 end) as bigint) as both_set, cast(max(shiftleft(start_a, 2)) as bigint) as shifted from {alignments} group by diffs")
# where the signal of a key stays above its mean, from the first to the last such point, if that is two or more
dual("signal_intervals", "select key, min(pos) as first_pos, max(pos) as last_pos, cast(count(*) as bigint) as n, round(max(value), 6) as peak from (select key, pos, value, high, row_number() over (partition by key order by pos, event_type, value) - row_number() over (partition by key, high order by pos, event_type, value) as grp from (select *, value > avg(value) over (partition by key) as high from {points}) x) y where high group by key, grp having count(*) >= 2")
# intervals of a read that are the same within tolerance, directly or through others, as one class at their means
_IDS = "select (read_a * 10000 + start_a) * 2 + case when fwd then 1 else 0 end as node, read_a, start_a, end_a from {intervals}"
_SAME = "select a.node as src, b.node as dst from n a join n b on a.read_a = b.read_a and a.node < b.node and abs(a.start_a - b.start_a) <= least(100, least(a.end_a - a.start_a + 1, b.end_a - b.start_a + 1) // 4) and abs(a.end_a - b.end_a) <= least(100, least(a.end_a - a.start_a + 1, b.end_a - b.start_a + 1) // 4)"


@query(f"with n as ({_IDS}), l as ({_SAME}), e as (select src as a, dst as b from l union all select dst, src from l), r(node, near) as (select a, b from e union select r.node, e.b from r join e on r.near = e.a), k as (select node, least(node, min(near)) as class from r group by node) select coalesce(k.class, n.node) as class, cast(count(*) as bigint) as members, cast(sum(n.start_a) as bigint) // count(*) as start_a, cast(sum(n.end_a) as bigint) // count(*) as end_a from n left join k on k.node = n.node group by 1")
def alike_intervals(spark, d):
    nodes = views.run(spark, d, _IDS)
    labels = ops.components(spark.sql("with n as (select * from {nodes}) " + _SAME.replace("//", "div"), nodes=nodes))
    found = nodes.join(labels, "node", "left").withColumn("class", F.coalesce("component", "node"))
    mean = lambda c: F.expr(f"sum(cast({c} as bigint)) div count(*)")
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("members"), mean("start_a").alias("start_a"), mean("end_a").alias("end_a"))


# positions of forward intervals (as truth) that reverse ones find, and the other way round
_BOTH = "select f.read_a, sum(least(f.end_a, r.end_a) - greatest(f.start_a, r.start_a) + 1) as common from {intervals} f join {intervals} r on r.read_a = f.read_a and f.fwd and not r.fwd and r.start_a <= f.end_a and f.start_a <= r.end_a group by f.read_a"
dual("recall_positions", f"select s.read_a, cast(s.truth as bigint) as truth, cast(s.found as bigint) as found, cast(coalesce(b.common, 0) as bigint) as common, round(coalesce(b.common, 0) / cast(greatest(1, s.truth) as double), 9) as recall, round(coalesce(b.common, 0) / cast(greatest(1, s.found) as double), 9) as precision from (select read_a, sum(case when fwd then end_a - start_a + 1 else 0 end) as truth, sum(case when fwd then 0 else end_a - start_a + 1 end) as found from {{intervals}} group by read_a) s left join ({_BOTH}) b on b.read_a = s.read_a")
# whether an alignment is assigned, to how many intervals, and whether any of them goes beyond it on both sides
dual("assignment_flags", "select assigned, beyond, cast(count(*) as bigint) as n from (select a.aln_id, a.read_a, a.read_b, a.start_a, a.start_b, a.diffs, cast(least(3, count(i.read_a)) as int) as assigned, max(case when i.start_a < a.start_a and i.end_a > a.end_a then 1 else 0 end) = 1 as beyond from {alignments} a left join {intervals} i on i.read_a = a.read_a and i.start_a <= a.start_a and a.end_a <= i.end_a group by a.aln_id, a.read_a, a.read_b, a.start_a, a.start_b, a.diffs) x group by assigned, beyond")
# lengths of characters, what they are in the other orientation, and whether that one is known
dual("character_methods", "select c.repeat, cast(count(*) as bigint) as chars, cast(sum(case when c.start_p = -1 then c.length else c.end_p - c.start_p + 1 end) as bigint) as total_length, cast(sum(case when r.char_id is not null then 1 else 0 end) as bigint) as with_reverse, cast(sum(case when c.open_start and c.open_end then 1 else 0 end) as bigint) as open_on_both from {alphabet} c left join {alphabet} r on r.repeat = c.repeat and r.fwd <> c.fwd and r.start_p = c.start_p and r.end_p = c.end_p and r.length = c.length and r.open_start = c.open_end and r.open_end = c.open_start group by c.repeat")
# fragments against their reference: how much of it they cover, how often, and what lies outside
dual("fragment_coverage", "select read_b, cast(count(*) as bigint) as fragments, cast(sum(end_b - start_b + 1) as bigint) as bases, max(end_b) - min(start_b) + 1 as span, round(sum(end_b - start_b + 1) / cast(max(end_b) - min(start_b) + 1 as double), 6) as depth, cast(sum(case when start_b < 10 then 1 else 0 end) as bigint) as at_start, cast(sum(case when end_b >= 990 then 1 else 0 end) as bigint) as at_end, cast(sum(diffs) as bigint) as differences from {alignments} group by read_b")
