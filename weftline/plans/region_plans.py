"""Regions of reads found from their alignments, covers and cores of graphs, thresholds and samples.

The detectors are declarative forms: chains and runs come from windows over one read's alignments in a total order, so no
group leaves the sort of its read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph as ops
from weftline.sources import views
from weftline.sources.views import view

from .graph_plans import paths_sql
from .registry import dual, query

_ORDER = "start_a, end_a, read_b, aln_id, start_b, diffs"


def _w(sql: str) -> str:
    return sql.replace("BY_READ", f"(partition by read_a order by {_ORDER})").replace("BY_PAIR", f"(partition by read_a, read_b, fwd order by {_ORDER})")


def _runs(by: str, keys: str, joined: str, columns: str, having: str) -> str:
    """Runs of alignments in the order of BY: a row that is not `joined` with the one before (columns p*) starts a run."""
    return _w(
        f"select {keys}, {columns} from (select *, sum(case when {joined} then 0 else 1 end) over {by} as run from (select *, lag(start_a) over {by} as p_start, lag(end_a) over {by} as p_end,"
        f" lag(start_b) over {by} as p_start_b, lag(end_b) over {by} as p_end_b from {{alignments}}) x) y group by {keys}, run having {having}"
    )


# chains of one pair of reads whose parts meet on A: the shifts between their starts are about the period
_PERIODIC = _runs(
    "BY_PAIR", "read_a, read_b, fwd", "start_a <= p_end and start_a > p_start",
    "min(start_a) as start_a, max(end_a) as end_a, cast(count(*) as bigint) as copies, cast(max(start_a) - min(start_a) as bigint) // greatest(1, count(*) - 1) as period", "count(*) >= 2",
)
dual("periodic_regions", _PERIODIC)
# many starts with small steps, over some span: the region may be copied from any of its places
dual("dense_regions", _runs(
    "BY_READ", "read_a", "start_a - p_start <= 40",
    "min(start_a) as start_a, max(end_a) as end_a, cast(count(*) as bigint) as alignments, cast(count(distinct read_b) as bigint) as reads, min(end_a - start_a + 1) as least_length", "count(*) >= 3 and max(start_a) - min(start_a) >= 20",
))
# ends that agree within a tolerance are one simple repeat, at the whole mean of its ends
dual("simple_repeats", _runs(
    "BY_READ", "read_a", "start_a - p_start <= 10 and abs(end_a - p_end) <= 10",
    "cast(sum(start_a) as bigint) // count(*) as start_a, cast(sum(end_a) as bigint) // count(*) as end_a, cast(count(*) as bigint) as assigned, cast(sum(case when fwd then 1 else 0 end) as bigint) as forward", "count(*) >= 2",
))
# neighbours on A that lie further apart on B: B holds what A lost
dual("single_deletions", _w(
    "select read_a, read_b, fwd, end_a as left_end, n_start as right_start, cast(n_start_b - end_b as bigint) - (n_start - end_a) as deleted from (select *, lead(start_a) over BY_PAIR as n_start, lead(start_b) over BY_PAIR as n_start_b from {alignments}) x where n_start > end_a and n_start_b > end_b and (n_start_b - end_b) - (n_start - end_a) > 0"
))
# order on B against order on A: steps back are rearrangements, gaps on A alone are insertions
dual("fragment_checks", _w(
    "select read_a, read_b, cast(count(*) as bigint) as parts, cast(sum(case when fwd and start_b < p_start_b or not fwd and start_b > p_start_b then 1 else 0 end) as bigint) as moved, cast(sum(case when start_a > p_end + 1 then start_a - p_end - 1 else 0 end) as bigint) as uncovered from (select *, lag(end_a) over BY_PAIR as p_end, lag(start_b) over BY_PAIR as p_start_b from {alignments}) x group by read_a, read_b"
))
# alignments inside a periodic region of their pair stay only if they are as long as the region
dual("tandem_filter", f"select a.aln_id, a.read_a, a.read_b, a.start_a, a.end_a, a.start_b, a.diffs from {{alignments}} a where not exists (select 1 from ({_PERIODIC}) p where p.read_a = a.read_a and p.read_b = a.read_b and p.fwd = a.fwd and p.start_a <= a.start_a and a.end_a <= p.end_a and p.end_a - p.start_a > a.end_a - a.start_a)")
dual("quality_trim", _w(
    "select read_a, cast(count(*) as bigint) as before, cast(coalesce(max(case when diffs < 7 then rn end) - min(case when diffs < 7 then rn end) + 1, 0) as bigint) as kept, cast(coalesce(min(case when diffs < 7 then rn end), 0) as bigint) as first_good from (select read_a, diffs, row_number() over BY_READ as rn from {alignments}) x group by read_a"
))
# the last place of a read takes the most frequent continuation of the one before, if it is alone at the top
_NEXT = "select read_b, lead(read_b) over BY_READ as nxt from {alignments}"
dual("end_block_choice", _w(
    f"select t.read_a, t.previous, t.last, c.nxt as chosen, c.n from (select read_a, read_b as last, lag(read_b) over BY_READ as previous, lead(read_b) over BY_READ as after from {{alignments}}) t left join (select read_b, min(nxt) as nxt, min(n) as n from (select *, max(n) over (partition by read_b) as most from (select read_b, nxt, cast(count(*) as bigint) as n from ({_NEXT}) x where nxt is not null group by read_b, nxt) y) z where n = most group by read_b having count(*) = 1) c on c.read_b = t.previous where t.after is null"
))
# frequencies of all sequences of one to three neighbours, and of the sequences that extend them
dual("suffix_trie", _w(
    "select a, b, c, cast(count(*) as bigint) as n from (select read_b as a, lead(read_b) over BY_READ as b, lead(read_b, 2) over BY_READ as c from {alignments}) x group by rollup(a, b, c) having count(*) >= 2 and grouping(a) = 0 and (grouping(b) = 1 or b is not null) and (grouping(c) = 1 or c is not null)"
))
dual("bounded_distances", "with e as (select src as a, dst as b from {edges} union all select dst, src from {edges}), d2 as (select e.a, f.b, 2 as hops from e join e f on e.b = f.a where e.a <> f.b), d3 as (select d2.a, e.b, 3 as hops from (select distinct a, b from d2) d2 join e on d2.b = e.a where d2.a <> e.b) select a, b, min(hops) as hops from (select a, b, 1 as hops from e union all select a, b, hops from d2 union all select a, b, hops from d3) x group by a, b")
# the bucket of lengths with fewest reads between the two highest peaks
_BUCKETS = "select cast((end_a - start_a + 1) // 4 as bigint) as bucket, cast(count(*) as bigint) as n from {alignments} group by (end_a - start_a + 1) // 4"
dual("peak_threshold", f"with h as ({_BUCKETS}), s as (select *, lag(n) over (order by bucket) as before, lead(n) over (order by bucket) as after from h), t as (select bucket, row_number() over (order by n desc, bucket) as place from s where n >= coalesce(before, 0) and n >= coalesce(after, 0)), m as (select min(bucket) as low, max(bucket) as high from t where place <= 2) select m.low, m.high, min(h.bucket) as threshold, min(h.n) as n from m join h on h.bucket between m.low and m.high join (select min(h.n) as least from m join h on h.bucket between m.low and m.high) l on h.n = l.least group by m.low, m.high")
dual("random_subset", "select read_id, length from {reads} where substr(md5(cast(read_id as string)), 1, 2) < '40'")
dual("tree_listing", "select concat(r.r_name, '/', n.n_name) as path, n.n_nationkey as leaf, cast(row_number() over (partition by r.r_name order by n.n_name) as bigint) as place from {region} r join {nation} n on n.n_regionkey = r.r_regionkey")


def _cover_sql(items: str, share: float, front: str = "", connected: bool = False) -> str:
    """ops.greedy_cover as a recursion over lists of covered elements."""
    free = "len([e for e in x.elements if not list_contains(r.covered, e)])"
    allowed = " and (r.step = 0 or list_contains(r.covered, x.item))" if connected else ""
    return (
        f"with {front}i as materialized ({items}), x as materialized (select grp, item, list(distinct element) as elements from i group by grp, item), z as materialized (select grp, count(distinct element) as size from i group by grp),"
        f" r(grp, step, item, gain, covered, size) as (select grp, 0, cast(null as bigint), cast(0 as bigint), cast([] as bigint[]), cast(size as bigint) from z union all select grp, step + 1, item, gain, list_concat(covered, fresh), size from (select *, row_number() over (partition by grp order by gain desc, item) as place from ("
        f"select r.grp, r.step, x.item, cast({free} as bigint) as gain, r.covered, cast([e for e in x.elements if not list_contains(r.covered, e)] as bigint[]) as fresh, r.size from r join x on x.grp = r.grp where r.size - len(r.covered) > {1 - share:.6f} * r.size + 1e-9{allowed}) c where gain > 0) d where place = 1)"
        " select grp, item, cast(step as int) as round, gain from r where step > 0"
    )


_SURFACE = "select distinct read_a as grp, read_b as item, start_a // 100 as element from {alignments}"
_LABELLED = "e as (select src as a, dst as b from {edges} union select dst, src from {edges}), r(node, near) as (select a, b from e union select r.node, e.b from r join e on r.near = e.a), k as (select node, least(node, min(near)) as grp from r group by node), "
_NEIGHBOURS = "select k.grp, e.a as item, e.b as element from e join k on k.node = e.a union select grp, node, node from k"


@query(_cover_sql(_SURFACE, 0.9))
def set_cover(spark, d):
    """Reads B that cover 0.9 of each read A, each by what those before leave."""
    a = view(spark, d, "alignments")
    items = a.select(F.col("read_a").alias("grp"), F.col("read_b").alias("item"), F.expr("start_a div 100").alias("element")).distinct()
    return ops.greedy_cover(items, 0.9)


@query(_cover_sql(_NEIGHBOURS, 0.9, _LABELLED.replace("r(node", "r0(node").replace("select r.node, e.b from r join e on r.near", "select r0.node, e.b from r0 join e on r0.near").replace("from r group by node", "from r0 group by node"), connected=True))
def dominating_set(spark, d):
    """Connected nodes of each component that have 0.9 of its nodes beside them."""
    edges = view(spark, d, "edges")
    both = edges.select(F.col("src").alias("item"), F.col("dst").alias("element")).unionAll(edges.select("dst", "src")).distinct()
    labels = ops.components(edges).select(F.col("node").alias("item"), F.col("component").alias("grp"))
    return ops.greedy_cover(both.join(labels, "item").select("grp", "item", "element").unionAll(labels.select("grp", "item", "item")), 0.9, connected=True)


_CUT = "with e as (select src as a, dst as b from {edges} union select dst, src from {edges}), s as (select a as cut, min(b) as x from e group by a having count(*) > 1), r(cut, x) as (select cut, x from s union select r.cut, e.b from r join e on e.a = r.x where e.b <> r.cut) select distinct e.a as node from e join s on s.cut = e.a where not exists (select 1 from r where r.cut = e.a and r.x = e.b)"


@query(_CUT)
def cut_vertices(spark, d):
    return ops.cut_vertices(view(spark, d, "edges"))


# links of read ends: A's prefix or suffix with B's; a link goes if two others lead the same way through a read between
_ENDS = "select distinct read_a as a, case when start_a < 500 then 0 else 1 end as side_a, read_b as b, case when (start_b < 500) = fwd then 0 else 1 end as side_b from {alignments} where diffs = 0"
dual("bidirected_reduction", f"with l as ({_ENDS} union select b, side_b, a, side_a from ({_ENDS}) m) select l.a, l.side_a, l.b, l.side_b from l where not exists (select 1 from l x join l y on y.a = x.b and y.side_a = 1 - x.side_b where x.a = l.a and x.side_a = l.side_a and y.b = l.b and y.side_b = l.side_b and x.b <> l.b and x.b <> l.a)")
# intervals as nodes, linked by exact alignments that lie on one of A and go to one of B; components of three or more
_GRAPH = "select distinct (i.read_a * 10000 + i.start_a) * 2 + case when i.fwd then 1 else 0 end as src, (j.read_a * 10000 + j.start_a) * 2 + case when j.fwd then 1 else 0 end as dst from {alignments} a join {intervals} i on i.read_a = a.read_a and i.fwd = a.fwd and i.start_a <= a.start_a and a.end_a <= i.end_a join {intervals} j on j.read_a = a.read_b and j.start_a <= a.start_b and a.end_b <= j.end_a where a.diffs <= 1 and a.end_a - a.start_a >= 30"


@query("with g as (" + _GRAPH + "), e as (select src as a, dst as b from g union select dst, src from g), r(node, near) as (select a, b from e union select r.node, e.b from r join e on r.near = e.a) select component, cast(count(*) as bigint) as nodes from (select node, least(node, min(near)) as component from r group by node) x group by component having count(*) >= 3")
def interval_graph(spark, d):
    labels = ops.components(views.run(spark, d, _GRAPH))
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).where("nodes >= 3")


# how regions of read A and of read B lie to each other along an alignment, by the kinds of both: one rule for each pair
_KINDS = f"select read_a, start_a, end_a, 6 as kind from ({_PERIODIC}) p union all select read_a, start_a, end_a, case when fwd then 1 else 2 end from {{intervals}}"
_MET = "select x.kind as kind_a, y.kind as kind_b, a.fwd, greatest(x.start_a, a.start_a) - a.start_a as off_a, greatest(y.start_a, a.start_b) - a.start_b as off_b, a.end_a - least(x.end_a, a.end_a) as end_off_a, a.end_b - least(y.end_a, a.end_b) as end_off_b, x.end_a - x.start_a + 1 as len_a, y.end_a - y.start_a + 1 as len_b, abs(a.start_a - x.start_a) <= 5 as starts_a, abs(a.end_a - x.end_a) <= 5 as ends_a, abs(a.start_b - y.start_a) <= 5 as starts_b, abs(a.end_b - y.end_a) <= 5 as ends_b from {alignments} a join k x on x.read_a = a.read_a and x.start_a <= a.end_a and a.start_a <= x.end_a join k y on y.read_a = a.read_b and y.start_a <= a.end_b and a.start_b <= y.end_a"
dual("containment_edges", f"with k as ({_KINDS}) select kind_a, kind_b, code, cast(count(*) as bigint) as n from (select kind_a, kind_b, cast(case when starts_a and ends_a and starts_b and ends_b then 16 when starts_a and ends_a and kind_a <= kind_b then 32 when starts_b and ends_b and kind_b <= kind_a then 64 when kind_a = 6 and kind_b <> 6 then 128 when kind_b = 6 and kind_a <> 6 then 256 else 0 end as int) as code from ({_MET}) m) c where code > 0 group by kind_a, kind_b, code")
dual("overlap_edges", f"with k as ({_KINDS}) select kind_a, kind_b, code, cast(count(*) as bigint) as n from (select kind_a, kind_b, cast(case when starts_a = ends_a or starts_b = ends_b then 0 when starts_a and starts_b and not fwd then 1 when starts_a and ends_b and fwd then 2 when ends_a and starts_b and fwd then 4 when ends_a and ends_b and not fwd then 8 else 0 end as int) as code from ({_MET}) m where kind_a <> 6 and kind_b <> 6 or kind_a = kind_b) c where code > 0 group by kind_a, kind_b, code")


def _peel_sql(least: int, rounds: int = 30) -> str:
    steps = ["e0 as materialized (select distinct src, dst from {dag})"]
    for i in range(rounds):
        steps.append(f"n{i} as materialized (select node from (select src as node from e{i} union all select dst from e{i}) x group by node having count(*) >= {least})")
        steps.append(f"e{i + 1} as materialized (select * from e{i} where src in (select node from n{i}) and dst in (select node from n{i}))")
    return "with " + ", ".join(steps) + f" select src, dst from e{rounds}"


@query(_peel_sql(3))
def core_edges(spark, d):
    """Links among nodes that keep three or more when those with fewer are taken away, again and again."""
    return ops.core(view(spark, d, "dag").select("src", "dst").distinct(), 3)


@query("with " + _LABELLED + "m as (select count(*) as m2 from e) select k.grp as component, cast(count(*) as bigint) as ends, round(count(*) / m.m2 - (count(*) / m.m2) * (count(*) / m.m2), 9) as modularity from e join k on k.node = e.a cross join m group by k.grp, m.m2")
def modularity(spark, d):
    """What each component adds to the modularity of the division into components."""
    edges = view(spark, d, "edges")
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst"))
    found = ends.join(ops.components(edges), "node").groupBy("component").agg(F.count(F.lit(1)).alias("ends"))
    share = F.col("ends") / F.lit(max(1, 2 * edges.count()))
    return found.select("component", "ends", F.round(share - share * share, 9).alias("modularity"))


# positions that three or more alignments cover, as closed intervals: sums of starts less ends, then islands of such segments
dual("track_from_alignments", """select read_a, min(pos) as start_a, max(nxt) - 1 as end_a from (select read_a, pos, nxt, pos - sum(nxt - pos) over (partition by read_a order by pos rows unbounded preceding) + (nxt - pos) as grp
 from (select read_a, pos, lead(pos) over (partition by read_a order by pos) as nxt, sum(step) over (partition by read_a order by pos rows unbounded preceding) as cover
 from (select read_a, pos, sum(step) as step from (select read_a, start_a as pos, 1 as step from {alignments} union all select read_a, end_a + 1, -1 from {alignments}) x group by read_a, pos) y) z where cover >= 3) q group by read_a, grp""")
# share of the alignments over a start that start within five positions of it
dual("delta_signal", """select read_a, cast(pos as int) as pos, cast(max(near) as bigint) as near, cast(max(cover) as bigint) as cover, round(max(near) / cast(max(cover) as double), 9) as share
 from (select read_a, pos, step, sum(step) over (partition by read_a order by pos) as cover, sum(case when step = 1 then 1 else 0 end) over (partition by read_a order by pos range between 5 preceding and 5 following) as near
 from (select read_a, start_a as pos, 1 as step from {alignments} union all select read_a, end_a + 1, -1 from {alignments}) x) y where step = 1 group by read_a, pos""")
# each alignment on each kept piece of its read A, clipped there and in proportion on B
dual("broken_alignments", """select read_a, read_b, fwd, piece, lo - p_start as start_a, hi - p_start as end_a,
 cast(case when fwd then start_b + (lo - start_a) * (end_b - start_b + 1) // (end_a - start_a + 1) else start_b + (end_a - hi) * (end_b - start_b + 1) // (end_a - start_a + 1) end as int) as start_b,
 cast(case when fwd then end_b - (end_a - hi) * (end_b - start_b + 1) // (end_a - start_a + 1) else end_b - (lo - start_a) * (end_b - start_b + 1) // (end_a - start_a + 1) end as int) as end_b, diffs
 from (select a.*, p.start_a as p_start, p.piece, greatest(a.start_a, p.start_a) as lo, least(a.end_a, p.end_a) as hi from {alignments} a
 join (select read_a, start_a, end_a, cast(row_number() over (partition by read_a order by start_a) as bigint) as piece from {intervals} where fwd and end_a - start_a >= 20) p
 on p.read_a = a.read_a and p.start_a <= a.end_a and a.start_a <= p.end_a) x where hi - lo >= 9""")
# 1 inside a reverse region, 2 around one, 0 across an end of one, -1 away from all
dual("region_codes", """select a.aln_id, a.read_a, a.read_b, a.start_a, a.start_b, a.diffs, cast(coalesce(max(case when i.start_a <= a.start_a and a.end_a <= i.end_a then 1 when a.start_a <= i.start_a and i.end_a <= a.end_a then 2 when i.read_a is not null then 0 end), -1) as int) as code
 from {alignments} a left join (select * from {intervals} where not fwd) i on i.read_a = a.read_a and i.start_a <= a.end_a and a.start_a <= i.end_a group by a.aln_id, a.read_a, a.read_b, a.start_a, a.start_b, a.diffs""")
# how regions of the two kinds lie: the same within tolerance, one in the other (with slack at one end), or across
dual("edge_classes", """select kind, cast(count(*) as bigint) as pairs, cast(sum(common) as bigint) as common from (select least(f.end_a, r.end_a) - greatest(f.start_a, r.start_a) + 1 as common,
 case when abs(f.start_a - r.start_a) <= tol and abs(f.end_a - r.end_a) <= tol then 'same' when r.len < f.len and (r.start_a > f.start_a - 10 and r.end_a <= f.end_a + 100 or r.end_a < f.end_a + 10 and r.start_a >= f.start_a - 100) then 'reverse in forward'
 when f.len < r.len and (f.start_a > r.start_a - 10 and f.end_a <= r.end_a + 100 or f.end_a < r.end_a + 10 and f.start_a >= r.start_a - 100) then 'forward in reverse' else 'across' end as kind
 from (select f.*, least(100, least(f.end_a - f.start_a + 1, r.end_a - r.start_a + 1) // 4) as tol, f.end_a - f.start_a + 1 as len, r.start_a as r_start, r.end_a as r_end from {intervals} f join {intervals} r on r.read_a = f.read_a and f.fwd and not r.fwd and r.start_a <= f.end_a and f.start_a <= r.end_a) f
 cross join lateral (select f.r_start as start_a, f.r_end as end_a, f.r_end - f.r_start + 1 as len) r) x group by kind""")
# bad values within a periodic region of their read become the read's mean of good ones
dual("quality_overwrite", f"""select a.read_a, cast(count(*) as bigint) as values_, cast(sum(case when a.diffs >= 7 and p.aln_id is not null then 1 else 0 end) as bigint) as replaced,
 cast(sum(case when a.diffs >= 7 and p.aln_id is not null then g.good else a.diffs end) as bigint) as total from {{alignments}} a
 left join (select distinct a.aln_id, a.read_a, a.read_b, a.start_a, a.start_b, a.diffs from {{alignments}} a join ({_PERIODIC}) p on p.read_a = a.read_a and p.start_a <= a.start_a and a.end_a <= p.end_a) p
 on p.aln_id = a.aln_id and p.read_a = a.read_a and p.read_b = a.read_b and p.start_a = a.start_a and p.start_b = a.start_b and p.diffs = a.diffs
 left join (select read_a, cast(sum(diffs) as bigint) // count(*) as good from {{alignments}} where diffs < 7 group by read_a) g on g.read_a = a.read_a group by a.read_a""")
dual("contracted_graph", "select x, y, cast(count(*) as bigint) as links from (select src // 5 as x, dst // 5 as y from {dag}) q where x <> y group by x, y")
dual("reachable_nodes", paths_sql().replace(" select s, t, cast(sum(n) as bigint) as paths, max(len) as longest from (", " select s, cast(count(distinct t) as bigint) as reached, max(len) as longest from (").replace(") x group by s, t", ") x group by s"))
_MD5 = "select read_id, length, H as h from {reads}"
_SIMULATED = "select read_id, start, start + length - 1 as end_, start // 3000 % 7 as unit, (start + length - 1) // 3000 - start // 3000 + 1 as units, h % 2 = 0 as fwd, h % 1000 * length // 10000 as errors from (select read_id, length, h, h // 2 % 1000000 as start from (" + _MD5 + ") x) y"
dual("simulated_reads", _SIMULATED.replace("H as h", "cast(concat('0x', substr(md5(cast(read_id as varchar)), 1, 8)) as bigint) as h"), _SIMULATED.replace("H as h", "cast(conv(substr(md5(cast(read_id as string)), 1, 8), 16, 10) as bigint) as h"))
