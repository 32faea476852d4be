"""Detected regions of reads after detection: long periods, classes, boundaries, assignments, clean-up, events and fragments.

Regions come from region_plans' chains and runs. All joins are between what lies on one read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph as ops
from weftline.sources import views

from .region_plans import _ORDER, _PERIODIC, _runs, _w
from .registry import dual, query

#: Tolerances in positions (fixed values): boundaries, a long period, the least length of a fragment.
NEAR, LONG, LEAST = 10, 12, 10

_DENSE = _runs("BY_READ", "read_a", "start_a - p_start <= 40", "min(start_a) as start_a, max(end_a) as end_a, cast(count(*) as bigint) as alignments", "count(*) >= 3 and max(start_a) - min(start_a) >= 20")
_SIMPLE = _runs(
    "BY_READ", "read_a", "start_a - p_start <= 10 and abs(end_a - p_end) <= 10",
    "cast(cast(sum(start_a) as bigint) // count(*) as int) as start_a, cast(cast(sum(end_a) as bigint) // count(*) as int) as end_a, cast(count(*) as bigint) as assigned", "count(*) >= 2",
)
_SHORT = f"select read_a, min(start_a) as start_a, max(end_a) as end_a from (select *, sum(case when m is null or start_a > m + 1 then 1 else 0 end) over (partition by read_a order by start_a, end_a rows unbounded preceding) as grp from (select read_a, start_a, end_a, max(end_a) over (partition by read_a order by start_a, end_a rows between unbounded preceding and 1 preceding) as m from ({_PERIODIC}) p where period < {LONG}) x) y group by read_a, grp"

# chains whose steps are long, unless a union of short-period regions has them whole
dual("long_periods", f"select l.read_a, l.read_b, l.fwd, l.start_a, l.end_a, l.copies, l.period from ({_PERIODIC}) l where l.period >= {LONG} and not exists (select 1 from ({_SHORT}) s where s.read_a = l.read_a and s.start_a <= l.start_a and l.end_a <= s.end_a)")

# periodic regions as nodes; alike ones (Jaccard of 0.8 or more on one read) are one class, whose members share a weight of one
_NODES = f"select ((read_a * 1000 + read_b) * 10000 + start_a) * 2 + case when fwd then 1 else 0 end as node, read_a, start_a, end_a from ({_PERIODIC}) p"
_ALIKE = "select a.node as src, b.node as dst from n a join n b on a.read_a = b.read_a and a.node < b.node and 5 * (least(a.end_a, b.end_a) - greatest(a.start_a, b.start_a) + 1) >= 4 * (greatest(a.end_a, b.end_a) - least(a.start_a, b.start_a) + 1)"


@query(f"with n as ({_NODES}), l as ({_ALIKE}), e as (select src as a, dst as b from l union all select dst, src from l), r(node, near) as (select a, b from e union select r.node, e.b from r join e on r.near = e.a), k as (select node, least(node, min(near)) as class from r group by node) select n.node, coalesce(k.class, n.node) as class, round(1.0 / count(*) over (partition by coalesce(k.class, n.node)), 9)::double as weight from n left join k on n.node = k.node")
def periodic_classes(spark, d):
    nodes = views.run(spark, d, _NODES.replace("//", "div"))
    edges = spark.sql(f"with n as (select * from {{nodes}}) {_ALIKE}", nodes=nodes)
    labels = ops.components(edges)
    found = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("class"))
    sizes = found.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return found.join(sizes, "class").select("node", "class", F.round(F.lit(1.0) / F.col("n"), 9).alias("weight"))


# a boundary moves to the place near it where most alignments of the read begin (or end); the least of equals
def _moved(side: str) -> str:
    return (
        f"select read_a, read_b, fwd, start_a, end_a, spot from (select p.read_a, p.read_b, p.fwd, p.start_a, p.end_a, a.{side} as spot, row_number() over (partition by p.read_a, p.read_b, p.fwd, p.start_a, p.end_a order by count(*) desc, a.{side}) as place"
        f" from ({_PERIODIC}) p join {{alignments}} a on a.read_a = p.read_a and abs(a.{side} - p.{side}) <= {NEAR} group by p.read_a, p.read_b, p.fwd, p.start_a, p.end_a, a.{side}) x where place = 1"
    )


dual("repaired_boundaries", f"select s.read_a, s.read_b, s.fwd, s.start_a, s.end_a, s.spot as new_start, e.spot as new_end from ({_moved('start_a')}) s join ({_moved('end_a')}) e on e.read_a = s.read_a and e.read_b = s.read_b and e.fwd = s.fwd and e.start_a = s.start_a and e.end_a = s.end_a where s.spot < e.spot")

# an alignment goes to the shortest dense region that has it, with slack at both ends; the first of equals
_KEY = "a.aln_id, a.read_a, a.read_b, a.start_a, a.start_b, a.diffs"
dual("dense_assignment", f"select aln_id, read_a, read_b, start_a, start_b, diffs, region_start, region_end from (select {_KEY}, r.start_a as region_start, r.end_a as region_end, row_number() over (partition by {_KEY} order by r.end_a - r.start_a, r.start_a) as place from {{alignments}} a join ({_DENSE}) r on r.read_a = a.read_a and a.start_a >= r.start_a - {NEAR} and a.end_a <= r.end_a + {NEAR}) x where place = 1")
# a dense region goes where periodic ones have half of it or more
dual("dense_cleaned", f"select r.read_a, r.start_a, r.end_a, r.alignments from ({_DENSE}) r left join (select d.read_a, d.start_a, sum(greatest(0, least(d.end_a, s.end_a) - greatest(d.start_a, s.start_a) + 1)) as common from ({_DENSE}) d join ({_SHORT}) s on s.read_a = d.read_a and s.start_a <= d.end_a and d.start_a <= s.end_a group by d.read_a, d.start_a) c on c.read_a = r.read_a and c.start_a = r.start_a where 2 * coalesce(c.common, 0) < r.end_a - r.start_a + 1")
# simple repeats that no dense or periodic region explains
_KEPT = f"select i.read_a, i.start_a, i.end_a, i.assigned from ({_SIMPLE}) i where not exists (select 1 from ({_DENSE}) r where r.read_a = i.read_a and r.start_a <= i.start_a + {NEAR} and i.end_a - {NEAR} <= r.end_a and r.end_a - r.start_a < 4 * (i.end_a - i.start_a)) and not exists (select 1 from ({_SHORT}) s where s.read_a = i.read_a and s.start_a <= i.start_a and i.end_a <= s.end_a)"
dual("unexplained_repeats", _KEPT)
# two or more simple repeats in a chain: shared starts make a prefix region, shared ends a suffix one, neither a substring one
dual("promoted_regions", f"select read_a, min(start_a) as start_a, max(end_a) as end_a, cast(count(*) as bigint) as repeats, case when max(start_a) - min(start_a) <= {NEAR} then 'prefix' when max(end_a) - min(end_a) <= {NEAR} then 'suffix' else 'substring' end as kind from (select *, sum(case when start_a <= p_end + 20 then 0 else 1 end) over (partition by read_a order by start_a, end_a rows unbounded preceding) as chain from (select *, lag(end_a) over (partition by read_a order by start_a, end_a) as p_end from ({_SIMPLE}) i) x) y group by read_a, chain having count(*) >= 2")
# regions with few alignments go; the others take the orientation that most of their alignments have
dual("frequent_regions", f"select i.read_a, i.start_a, i.end_a, i.assigned, i.forward, case when 3 * i.forward >= 2 * i.assigned then 'forward' when 3 * i.forward <= i.assigned then 'reverse' else 'both' end as kind from ({_SIMPLE.replace('cast(count(*) as bigint) as assigned', 'cast(count(*) as bigint) as assigned, cast(sum(case when fwd then 1 else 0 end) as bigint) as forward')}) i join (select read_a, count(*) as n, cast(max(end_a) - min(start_a) + 1 as bigint) as span from {{alignments}} group by read_a) r on r.read_a = i.read_a where i.assigned * r.span >= 2 * r.n * (i.end_a - i.start_a + 1)")

# both ends of every region that a detector reports, by kind; ends of one kind that are near each other are one event
_ENDS = " union all ".join(f"select read_a, {side} as pos, '{kind}' as kind, {sign} as side from ({sql}) {alias}{sign + 2}" for sql, kind, alias in ((_PERIODIC, "periodic", "p"), (_DENSE, "dense", "d"), (_KEPT, "simple", "s")) for side, sign in (("start_a", -1), ("end_a", 1)))
_EVENTS = f"select read_a, kind, cast(cast(sum(pos) as bigint) // count(*) as int) as pos, cast(count(*) as bigint) as n, cast(sum(side) as bigint) as balance from (select *, sum(case when pos - before <= {NEAR} then 0 else 1 end) over (partition by read_a, kind order by pos rows unbounded preceding) as grp from (select *, lag(pos) over (partition by read_a, kind order by pos) as before from ({_ENDS}) e) x) y group by read_a, kind, grp"
dual("detector_events", _EVENTS)
# ends of alignments that no short-period region has inside, clear of its own ends
dual("maximal_events", f"select e.read_a, e.pos, e.open, cast(count(*) as bigint) as n from (select read_a, start_a as pos, true as open from {{alignments}} union all select read_a, end_a, false from {{alignments}}) e where not exists (select 1 from ({_SHORT}) s where s.read_a = e.read_a and s.start_a + {NEAR} < e.pos and e.pos < s.end_a - {NEAR}) group by e.read_a, e.pos, e.open")
# what is left of the union of intervals once stretches of bad alignments are cut out, if it is long enough
_ISLANDS = "select read_a, min(start_a) as start_a, max(end_a) as end_a from (select *, sum(case when m is null or start_a > m + 1 then 1 else 0 end) over (partition by read_a order by start_a, end_a rows unbounded preceding) as grp from (select read_a, start_a, end_a, max(end_a) over (partition by read_a order by start_a, end_a rows between unbounded preceding and 1 preceding) as m from ITEMS) x) y group by read_a, grp"
_UNION, _BAD = _ISLANDS.replace("ITEMS", "{intervals} i"), _ISLANDS.replace("ITEMS", "(select read_a, start_a, end_a from {alignments} where diffs >= 9) b")
dual("fragments", f"""select read_a, frag_start, frag_end from (
 select u.read_a, greatest(u.start_a, coalesce(b.end_a + 1, u.start_a)) as frag_start, least(u.end_a, coalesce(lead(b.start_a) over (partition by u.read_a, u.start_a order by b.start_a nulls first) - 1, u.end_a)) as frag_end
 from (select read_a, start_a, end_a from ({_UNION}) w) u left join (select w.read_a, w.start_a as u_start, c.start_a, c.end_a from ({_UNION}) w join ({_BAD}) c on c.read_a = w.read_a and c.start_a <= w.end_a and w.start_a <= c.end_a union all select w.read_a, w.start_a, w.start_a - 1, w.start_a - 1 from ({_UNION}) w) b on b.read_a = u.read_a and b.u_start = u.start_a) x where frag_end - frag_start + 1 >= {LEAST}""")
# what each detector reports of a read; -1 where no alignment is good, -2 where nothing is reported
dual("factorization", f"""select r.read_id as read_a, cast(case when coalesce(g.good, 0) = 0 then -1 when coalesce(p.n, 0) + coalesce(d.n, 0) + coalesce(s.n, 0) = 0 then -2 else coalesce(p.n, 0) + coalesce(d.n, 0) + coalesce(s.n, 0) end as bigint) as regions, cast(coalesce(p.n, 0) as bigint) as periodic, cast(coalesce(d.n, 0) as bigint) as dense, cast(coalesce(s.n, 0) as bigint) as simple
 from {{reads}} r left join (select read_a, count(*) as good from {{alignments}} where diffs < 7 group by read_a) g on g.read_a = r.read_id left join (select read_a, count(*) as n from ({_PERIODIC}) p0 group by read_a) p on p.read_a = r.read_id
 left join (select read_a, count(*) as n from ({_DENSE}) d0 group by read_a) d on d.read_a = r.read_id left join (select read_a, count(*) as n from ({_KEPT}) s0 group by read_a) s on s.read_a = r.read_id""")
# a region's ends move to the sharpest step of coverage near them
_STEPS = "select read_a, pos, cast(sum(step) as bigint) as step from (select read_a, start_a as pos, 1 as step from {alignments} union all select read_a, end_a + 1, -1 from {alignments}) q group by read_a, pos"
dual("refined_boundaries", f"select read_a, start_a, end_a, pos as refined, step from (select r.read_a, r.start_a, r.end_a, c.pos, c.step, row_number() over (partition by r.read_a, r.start_a order by c.step desc, c.pos) as place from ({_DENSE}) r join ({_STEPS}) c on c.read_a = r.read_a and abs(c.pos - r.start_a) <= {NEAR} and c.step > 0) x where place = 1")
# single-linkage of ends of alignments, the clusters' means, and which spread too far outside periodic ranges
_POINTS = "select read_a, start_a as pos from {alignments} union all select read_a, end_a from {alignments}"
_DEEP = f"select e.read_a, e.pos, max(case when s.read_a is not null then 1 else 0 end) as inside from ({_POINTS}) e left join ({_SHORT}) s on s.read_a = e.read_a and s.start_a - {NEAR} <= e.pos and e.pos <= s.end_a + {NEAR} group by e.read_a, e.pos having max(case when s.start_a + {NEAR} < e.pos and e.pos < s.end_a - {NEAR} then 1 else 0 end) = 0"
_RECODED = f"select read_a, cast(cast(sum(pos * n) as bigint) // sum(n) as int) as point, cast(sum(n) as bigint) as ends from (select *, sum(case when pos - before <= 3 then 0 else 1 end) over (partition by read_a order by pos rows unbounded preceding) as grp from (select k.read_a, k.pos, k.inside, c.n, lag(k.pos) over (partition by k.read_a order by k.pos) as before from ({_DEEP}) k join (select read_a, pos, count(*) as n from ({_POINTS}) p group by read_a, pos) c on c.read_a = k.read_a and c.pos = k.pos) x) y group by read_a, grp having max(inside) = 1 or max(pos) - min(pos) + 1 <= 6"
dual("recode_points", _RECODED)
# blocks between neighbouring points, and the characters of each: alignments that are about the block, or that have it
_BLOCKS = f"select read_a, cast(row_number() over (partition by read_a order by point) as bigint) as block, point as block_start, lead(point) over (partition by read_a order by point) - 1 as block_end from ({_RECODED}) p"
dual("recoded_reads", f"""select b.read_a, b.block, b.block_start, b.block_end, cast(count(distinct a.read_b) as bigint) as characters, min(a.read_b) as first_character
 from ({_BLOCKS}) b left join {{alignments}} a on a.read_a = b.read_a and a.start_a <= b.block_start + {NEAR} and a.end_a >= b.block_end - {NEAR} where b.block_end > b.block_start group by b.read_a, b.block, b.block_start, b.block_end""")
# ends of blocks at a gap between periodic regions go to the nearest end of an alignment of the region before
dual("periodic_spacers", f"select s.read_a, s.first_pos, s.last_pos, min(abs(a.end_a - s.first_pos)) as distance, cast(count(a.read_b) as bigint) as witnesses from (select read_a, end_a + 1 as first_pos, n_start - 1 as last_pos from (select read_a, end_a, lead(start_a) over (partition by read_a order by start_a) as n_start from ({_SHORT}) s0) x where n_start - end_a - 1 between 1 and 400) s left join {{alignments}} a on a.read_a = s.read_a and a.end_a between s.first_pos - {NEAR} and s.last_pos + {NEAR} and not exists (select 1 from {{alignments}} o where false) group by s.read_a, s.first_pos, s.last_pos".replace(" and not exists (select 1 from {alignments} o where false)", ""))
# a spacer takes the end that most alignments across it have, the first of equals, if two or more agree
dual("spacer_breakpoints", f"select read_a, first_pos, last_pos, spot as breakpoint, n from (select s.read_a, s.first_pos, s.last_pos, a.end_a as spot, cast(count(*) as bigint) as n, row_number() over (partition by s.read_a, s.first_pos order by count(*) desc, a.end_a) as place from (select read_a, end_a + 1 as first_pos, n_start - 1 as last_pos from (select read_a, end_a, lead(start_a) over (partition by read_a order by start_a) as n_start from ({_SHORT}) s0) x where n_start - end_a - 1 between 1 and 400) s join {{alignments}} a on a.read_a = s.read_a and a.end_a between s.first_pos and s.last_pos group by s.read_a, s.first_pos, s.last_pos, a.end_a) y where place = 1 and n >= 2")
dual("diagnostic_histogram", f"select cast(least(20, f.total - coalesce(p.inside, 0)) as bigint) as difference, cast(count(*) as bigint) as reads from (select read_a, count(*) as total from {{alignments}} group by read_a) f left join (select a.read_a, count(*) as inside from {{alignments}} a where exists (select 1 from ({_SHORT}) s where s.read_a = a.read_a and s.start_a <= a.start_a and a.end_a <= s.end_a) group by a.read_a) p on p.read_a = f.read_a group by least(20, f.total - coalesce(p.inside, 0))")
