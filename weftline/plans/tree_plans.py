"""Trees of splits over ordered points: densities, regressions, their leaves and runs, clusters and weighted means.

A level splits every leaf of every key at once, by windows over (key, leaf); DEPTH levels give at most 2 ** DEPTH leaves.
"""

from __future__ import annotations

from .registry import dual

DEPTH, LEAST = 3, 4
_W = "over (partition by key, leaf order by pos rows unbounded preceding)"
_ALL = "over (partition by key, leaf)"


def tree(points: str, score: str, depth: int = DEPTH) -> str:
    """CTEs l0 .. l{depth}: rows (key, pos, m, v, q, leaf). score is to be least; it sees masses cm of tm, sums cs of ts and
    squares cq of tq up to a point and in all, and lengths dl and dr on both sides of the cut after it."""
    steps = [f"l0 as (select key, pos, m, v, q, cast(0 as bigint) as leaf from ({points}) p)"]
    for i in range(depth):
        steps.append(
            f"s{i} as (select key, leaf, pos, cast(cm as double) as cm, cast(tm as double) as tm, cs, ts, cq, tq, cast(pos - lo + 1 as double) as dl, cast(hi - pos as double) as dr from (select key, leaf, pos, sum(m) {_W} as cm, sum(m) {_ALL} as tm, sum(v) {_W} as cs, sum(v) {_ALL} as ts, sum(q) {_W} as cq, sum(q) {_ALL} as tq, min(pos) {_ALL} as lo, max(pos) {_ALL} as hi, count(*) {_ALL} as n from l{i}) x where n >= {LEAST} and pos < hi)"
        )
        steps.append(f"b{i} as (select key, leaf, pos as cut from (select key, leaf, pos, row_number() over (partition by key, leaf order by round({score}, 6), pos) as place from s{i}) x where place = 1)")
        steps.append(f"l{i + 1} as (select l.key, l.pos, l.m, l.v, l.q, 2 * l.leaf + case when l.pos > b.cut then 1 else 0 end as leaf from l{i} l left join b{i} b on b.key = l.key and b.leaf = l.leaf)")
    return "with " + ", ".join(steps)


_POINTS = "select key, pos, count(*) as m, round(sum(value), 6) as v, round(sum(value * value), 6) as q from {points} group by key, pos"
_DENSITY = tree(_POINTS, "-1e12 * (cm / tm * (cm / tm) / dl + (tm - cm) / tm * ((tm - cm) / tm) / dr)")
_LEAVES = f"{_DENSITY}, leaves as (select key, leaf, min(pos) as first_pos, max(pos) as last_pos, cast(sum(m) as bigint) as mass, round(sum(m) / cast(max(pos) - min(pos) + 1 as double), 12) as density, round(sum(m * cast(pos as double)) / sum(m), 4) as centre from l{DEPTH} group by key, leaf)"
dual("density_tree", f"{_LEAVES} select key, leaf, first_pos, last_pos, mass, density from leaves")
dual("regression_tree", tree(_POINTS, "(cq - cs * cs / cm) + (tq - cq - (ts - cs) * (ts - cs) / (tm - cm))") + f" select key, leaf, min(pos) as first_pos, max(pos) as last_pos, cast(sum(m) as bigint) as mass, round(sum(v) / sum(m), 6) as mean from l{DEPTH} group by key, leaf")
# leaves that are denser than those beside them, and by how much
_MARKED = f"{_LEAVES}, marked as (select *, lag(density) over (partition by key order by leaf) as before, lead(density) over (partition by key order by leaf) as after, avg(density) over (partition by key) as usual, sum(mass) over (partition by key) as all_mass from leaves)"
dual("local_maximum_leaves", f"{_MARKED} select key, leaf, first_pos, last_pos, mass, density > coalesce(before, 0) and density > coalesce(after, 0) as is_maximum, round(density / greatest(coalesce(before, 0), coalesce(after, 0), 1e-12), 4) as ratio from marked")
# runs of leaves that are denser than their key's mean: mass, centre of mass, and the heaviest
_RUNS = f"{_MARKED}, runs as (select key, min(leaf) as first_leaf, max(leaf) as last_leaf, min(first_pos) as first_pos, max(last_pos) as last_pos, cast(sum(mass) as bigint) as mass, round(sum(centre * mass) / sum(mass), 3) as centre, max(all_mass) as all_mass from (select *, leaf_rank - row_number() over (partition by key, density >= usual order by leaf) as grp, density >= usual as high from (select *, row_number() over (partition by key order by leaf) as leaf_rank from marked) r) s where high group by key, grp)"
dual("leaf_runs", f"{_RUNS} select key, first_leaf, last_leaf, first_pos, last_pos, mass, centre, row_number() over (partition by key order by mass desc, first_leaf) = 1 as heaviest from runs")
# events of each run, gathered about the run's centre; events outside are deleted
dual("event_clusters", f"{_RUNS} select r.key, r.first_pos, r.centre, cast(count(distinct p.event_type) as bigint) as kinds, cast(count(*) as bigint) as events, round(avg(abs(p.pos - r.centre)), 2) as spread from runs r join {{points}} p on p.key = r.key and p.pos between r.first_pos and r.last_pos group by r.key, r.first_pos, r.centre")


def kmeans(k: int, rounds: int) -> str:
    """Weighted means of whole values: each value goes to the nearest centre, the lowest of equals."""
    steps = ["v as (select cast(floor(value) as bigint) as x, cast(count(*) as double) as m from {points} group by floor(value))", "bounds as (select min(x) as lo, max(x) as hi from v)"]
    steps.append("c0 as (" + " union all ".join(f"select {i} as id, cast(lo as double) + (hi - lo) * {2 * i + 1} / {2 * k}.0e0 as c from bounds" for i in range(k)) + ")")
    for i in range(rounds):  # each value meets all centres, so those that get none keep their place
        steps.append(f"c{i + 1} as (select id, coalesce(round(sum(case when place = 1 then x * m end) / sum(case when place = 1 then m end), 9), max(c)) as c, sum(case when place = 1 then m else 0 end) as mass from (select v.x, v.m, c.id, c.c, row_number() over (partition by v.x order by round(abs(v.x - c.c), 9), c.id) as place from v cross join c{i} c) q group by id)")
    return "with " + ", ".join(steps)


dual("kmeans_weighted", kmeans(4, 6) + " select id, round(c, 6) as centre, cast(mass as bigint) as mass from c6")
# the step between neighbours that most pairs of points lie at, over its multiples: mean of the gaps divided by how many steps they are
_GAPS = "select key, gap from (select key, pos - lag(pos) over (partition by key order by pos) as gap from {points}) x where gap > 0"
_BEST = f"select key, bucket from (select key, gap // 1800 as bucket, row_number() over (partition by key order by count(*) desc, gap // 1800) as place from ({_GAPS}) g where gap >= 1800 group by key, gap // 1800) x where place = 1"
dual("period_estimates", f"select g.key, b.bucket, cast(count(*) as bigint) as gaps, round(avg(g.gap / cast(greatest(1, (g.gap + b.bucket * 1800 // 2) // (b.bucket * 1800 + 900)) as double)), 3) as period from ({_GAPS}) g join ({_BEST}) b on b.key = g.key where abs(g.gap - (b.bucket * 1800 + 900) * greatest(1, (g.gap + 900) // (b.bucket * 1800 + 900))) <= 900 group by g.key, b.bucket")
# values beyond 1.5 times the quartiles' distance, by key
_QUART = "select key, min(case when 4 * i >= n then value end) as low, min(case when 4 * i >= 3 * n then value end) as high from (select key, value, row_number() over (partition by key order by value) as i, count(*) over (partition by key) as n from {points}) x group by key"
dual("outliers", f"select p.key, q.low, q.high, cast(sum(case when p.value > q.high + 1.5 * (q.high - q.low) then 1 else 0 end) as bigint) as above, cast(sum(case when p.value < q.low - 1.5 * (q.high - q.low) then 1 else 0 end) as bigint) as below from {{points}} p join ({_QUART}) q on q.key = p.key group by p.key, q.low, q.high")
# per read: the count that parts the lower and upper of two groups of its coverage, at the greatest gap between neighbours
dual("coverage_thresholds", "select read_b, threshold, gap from (select read_b, n as threshold, nxt - n as gap, row_number() over (partition by read_b order by nxt - n desc, n) as place from (select read_b, n, lead(n) over (partition by read_b order by n) as nxt from (select distinct read_b, n from (select read_b, start_a // 50 as cell, count(*) as n from {alignments} group by read_b, start_a // 50) x) y) z where nxt is not null) q where place = 1")
# valleys: stretches of low values between two high ones
dual("valley_runs", "select key, min(pos) as first_pos, max(pos) as last_pos, cast(count(*) as bigint) as n, min(value) as least from (select *, sum(case when low then 0 else 1 end) over (partition by key order by pos, event_type, value rows unbounded preceding) as walls from (select key, pos, event_type, value, value < 0.5 * avg(value) over (partition by key) as low from {points}) x) y where low and walls > 0 group by key, walls having count(*) >= 2")
