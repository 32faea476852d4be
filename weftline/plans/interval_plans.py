"""Interval scalars and sets over the alignment views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions import intervals as iv
from weftline.operators import intervals as ops
from weftline.sources.views import view

from .registry import binned, dual, query

ISLANDS = """(select KEYS, min(S) as s, max(E) as e from (select *, sum(case when m is null or S > m + 1 then 1 else 0 end) over (partition by KEYS order by S, E rows unbounded preceding) as g
 from (select KEYS, S, E, max(E) over (partition by KEYS order by S, E rows between unbounded preceding and 1 preceding) as m from FROM) q1) q2 group by KEYS, g)"""


def isl(keys: str, source: str, s: str = "start_a", e: str = "end_a") -> str:
    return ISLANDS.replace("KEYS", keys).replace("FROM", source).replace("S)", f"{s})").replace("S >", f"{s} >").replace("S,", f"{s},").replace(" E ", f" {e} ").replace("(E)", f"({e})").replace("E,", f"{e},").replace(" S ", f" {s} ")


@query(f"select i.read_a, cast(count(*) as bigint) as islands, cast(sum(e - s + 1) as bigint) as covered, sum(e - s + 1) / cast(max(r.length) as double) as fraction from {isl('read_a', '{alignments}')} i join {{reads}} r on i.read_a = r.read_id group by i.read_a")
def read_surface(spark, d):
    s = ops.surface(view(spark, d, "alignments"), ["read_a"]).join(view(spark, d, "reads"), F.col("read_a") == F.col("read_id"))
    return s.select("read_a", "islands", "covered", (F.col("covered") / F.col("length")).alias("fraction"))


_PAIR = "(select aln_id, read_a, read_b, start_b, diffs, start_a as s1, end_a as e1, lead(start_a) over w as s2, lead(end_a) over w as e2 from {alignments} window w as (partition by read_a order by start_a, end_a, read_b, aln_id, start_b, diffs)) p where s2 is not null"


@query(f"""select aln_id, s1, e1, s2, e2, s2 <= e1 and s1 <= e2 as meets, greatest(0, least(e1,e2)-greatest(s1,s2)+1) as common,
 (e1-s1+1)+(e2-s2+1)-greatest(0, least(e1,e2)-greatest(s1,s2)+1) as joint,
 greatest(0, least(e1,e2)-greatest(s1,s2)+1) / cast((e1-s1+1)+(e2-s2+1)-greatest(0, least(e1,e2)-greatest(s1,s2)+1) as double) as similarity,
 s1 >= s2 and e1 <= e2 as inside, abs(s1-s2) <= least(100, floor(least(e1-s1+1,e2-s2+1)*0.25)) and abs(e1-e2) <= least(100, floor(least(e1-s1+1,e2-s2+1)*0.25)) as same,
 e1-s1 < e2-s2 and ((s1 > s2-10 and e1 <= e2+100) or (e1 < e2+10 and s1 >= s2-100)) as nearly_inside,
 (s1 < s2 and e1 >= s2 and e1 < e2) or (s2 < s1 and e2 >= s1 and e2 < e1) as straddles from {_PAIR}""")
def interval_scalars(spark, d):
    w = W.partitionBy("read_a").orderBy("start_a", "end_a", "read_b", "aln_id", "start_b", "diffs")
    p = view(spark, d, "alignments").select("aln_id", F.col("start_a").alias("s1"), F.col("end_a").alias("e1"), F.lead("start_a").over(w).alias("s2"), F.lead("end_a").over(w).alias("e2")).where("s2 is not null")
    x = [F.col(c) for c in ("s1", "e1", "s2", "e2")]
    return p.select("aln_id", *x, iv.intersect(*x).alias("meets"), iv.intersection_length(*x).alias("common"), iv.union_length(*x).alias("joint"), iv.jaccard(*x).alias("similarity"), iv.contained(*x).alias("inside"), iv.approximately_identical(*x).alias("same"), iv.approximately_contained(*x).alias("nearly_inside"), iv.straddle(*x).alias("straddles"))


@query(f"""with g as (select r.read_id, r.length, i.s, i.e, lag(i.e) over w as pe, lead(i.s) over w as ns from {{reads}} r left join {isl('read_a', '{alignments}')} i on i.read_a = r.read_id window w as (partition by r.read_id order by i.s))
 select read_id, coalesce(pe, -1) + 1 as gap_start, s - 1 as gap_end from g where coalesce(pe, -1) + 1 <= s - 1
 union all select read_id, e + 1, length - 1 from g where ns is null and e + 1 <= length - 1""")
def interval_complement(spark, d):
    a = view(spark, d, "alignments").withColumnRenamed("read_a", "read_id")
    return ops.gaps(a, view(spark, d, "reads"), "read_id")


_DIFF = """with f as (select read_a, start_a, end_a from {intervals} where fwd), r as (select read_a, start_a, end_a from {intervals} where not fwd),
 ev as (select read_a, start_a as pos, 1 as df, 0 as dr from f union all select read_a, end_a + 1, -1, 0 from f union all select read_a, start_a, 0, 1 from r union all select read_a, end_a + 1, 0, -1 from r),
 st as (select read_a, pos, sum(df) as df, sum(dr) as dr from ev group by read_a, pos),
 sw as (select read_a, sum(df) over w as nf, sum(dr) over w as nr, lead(pos) over (partition by read_a order by pos) - pos as len from st window w as (partition by read_a order by pos rows unbounded preceding))
 select read_a, cast(sum(case when nf > 0 then len else 0 end) as bigint) as forward_surface, cast(sum(case when nr > 0 then len else 0 end) as bigint) as reverse_surface,
 cast(sum(case when nf > 0 and nr > 0 then len else 0 end) as bigint) as both_surface, cast(sum(case when nf > 0 and nr = 0 then len else 0 end) as bigint) as forward_only from sw group by read_a"""
dual("interval_difference", _DIFF)
dual("track_agreement", _DIFF.replace("select read_a, cast(sum(case when nf > 0 then len else 0 end) as bigint) as forward_surface", "select read_a % 20 as block, cast(sum(case when nf > 0 then len else 0 end) as bigint) as forward_surface").replace("from sw group by read_a", "from sw group by read_a % 20"))


@query("""with o as (select read_a, read_b, min(start_a) as s, max(end_a) as e from (select *, sum(case when m is null or start_a > m + 1 then 1 else 0 end) over (partition by read_a, read_b order by start_a, end_a rows unbounded preceding) as g
 from (select read_a, read_b, start_a, end_a, max(end_a) over (partition by read_a, read_b order by start_a, end_a rows between unbounded preceding and 1 preceding) as m from {alignments}) x) y group by read_a, read_b, g),
 p as (select distinct read_a, pos from (select read_a, s as pos from o union all select read_a, e + 1 from o) z), seg as (select read_a, pos, lead(pos) over (partition by read_a order by pos) as nxt from p),
 c as (select seg.read_a, seg.pos, seg.nxt - seg.pos as len, count(*) as n, min(o.read_b) as read_b from seg join o on o.read_a = seg.read_a and o.s <= seg.pos and o.e >= seg.pos where seg.nxt is not null group by seg.read_a, seg.pos, seg.nxt)
 select read_a, read_b, cast(sum(len) as bigint) as exclusive from c where n = 1 group by read_a, read_b""")
def exclusive_surface(spark, d):
    return ops.exclusive(view(spark, d, "alignments"), ["read_a"], "read_b")


@query("""select aln_id, read_b, diffs, start_b, case when fwd then start_b + lo else start_b + hi end as pb_start, case when fwd then end_b - hi else end_b - lo end as pb_end from (
 select *, cast(trunc((end_b-start_b+1)/cast(end_a-start_a+1 as double)*(greatest(1000,start_a)-start_a)) as int) as lo, cast(trunc((end_b-start_b+1)/cast(end_a-start_a+1 as double)*(end_a-least(1500,end_a))) as int) as hi
 from {alignments} where start_a <= 1500 and end_a >= 1000) x""")
def projection_fwd_rev(spark, d):
    c = F.col
    s, e = iv.project(F.lit(1000), F.lit(1500), c("start_a"), c("end_a"), c("start_b"), c("end_b"), c("fwd"))
    return view(spark, d, "alignments").where("start_a <= 1500 and end_a >= 1000").select("aln_id", "read_b", "diffs", "start_b", s.alias("pb_start"), e.alias("pb_end"))


@query("""with st as (select read_a, pos, sum(d) as d from (select read_a, start_a as pos, 1 as d from {alignments} union all select read_a, end_a + 1, -1 from {alignments}) x group by read_a, pos),
 sw as (select read_a, pos, sum(d) over (partition by read_a order by pos rows unbounded preceding) as c, lead(pos) over (partition by read_a order by pos) as nxt from st)
 select read_a, pos as seg_start, nxt - 1 as seg_end, cast(c as bigint) as coverage from sw where c > 0""")
def coverage_profile(spark, d):
    return ops.profile(view(spark, d, "alignments"), ["read_a"])


_KEEP = "not exists (select 1 from {alignments} r where not r.fwd and f.fwd and r.read_a = f.read_a and r.read_b = f.read_b and JAC(f.start_a,f.end_a,r.start_a,r.end_a) and JAC(f.start_b,f.end_b,r.start_b,r.end_b))"


def _jac(text: str) -> str:
    import re

    one = lambda m: (lambda a, b, c, e: f"greatest(0, least({b},{e})-greatest({a},{c})+1) * 10 >= 8 * (({b}-{a}+1)+({e}-{c}+1)-greatest(0, least({b},{e})-greatest({a},{c})+1))")(*m[1].split(","))
    return re.sub(r"JAC\(([^)]*)\)", one, text)


dual("coverage_palindrome", _jac(f"select f.read_a, cast(count(*) as bigint) as alignments, cast(sum(f.end_a - f.start_a + 1) as bigint) as total_length from {{alignments}} f where {_KEEP} group by f.read_a"))


@query("""select aln_id, read_b, start_b, diffs, s, e, best_len from (select l.aln_id, l.read_b, l.start_b, l.diffs, l.start_a as s, l.end_a as e, min(r.end_a - r.start_a + 1) as best_len from {alignments} l join {alignments} r
 on l.read_a = r.read_a and l.start_a >= r.start_a and l.end_a <= r.end_a and r.end_a - r.start_a > l.end_a - l.start_a group by l.aln_id, l.read_b, l.start_b, l.diffs, l.start_a, l.end_a, l.read_a) q""")
def shortest_container(spark, d):
    a = view(spark, d, "alignments").select("aln_id", "read_a", "read_b", "start_b", "diffs", F.col("start_a").alias("s"), F.col("end_a").alias("e"))
    inside = (F.col("l.s") >= F.col("r.s")) & (F.col("l.e") <= F.col("r.e")) & (F.col("r.e") - F.col("r.s") > F.col("l.e") - F.col("l.s"))
    met = ops.range_join(a, a.select("read_a", "s", "e"), "read_a", inside, 64)
    return met.groupBy("l.aln_id", "l.read_a", "l.read_b", "l.start_b", "l.diffs", "l.s", "l.e").agg(F.min(F.col("r.e") - F.col("r.s") + 1).alias("best_len")).drop("read_a")


@query("""select a.aln_id, a.read_b, a.start_b, a.diffs, cast(count(i.start_a) as bigint) as n_inside, min(i.end_a - i.start_a + 1) as container_len from {alignments} a left join {intervals} i
 on a.read_a = i.read_a and a.fwd <> i.fwd and a.start_a >= i.start_a and a.end_a <= i.end_a group by a.aln_id, a.read_a, a.read_b, a.start_a, a.end_a, a.start_b, a.diffs""")
def best_assignment(spark, d):
    a = view(spark, d, "alignments").select("*", F.col("start_a").alias("s"), F.col("end_a").alias("e"))
    i = view(spark, d, "intervals").select("read_a", F.col("fwd").alias("kind"), F.col("start_a").alias("s"), F.col("end_a").alias("e"))
    met = ops.range_join(a, i, "read_a", (F.col("l.fwd") != F.col("r.kind")) & (F.col("l.s") >= F.col("r.s")) & (F.col("l.e") <= F.col("r.e")), 64)
    key = ["aln_id", "read_a", "read_b", "start_a", "end_a", "start_b", "diffs"]
    best = met.groupBy(*(F.col(f"l.{k}") for k in key)).agg(F.count(F.lit(1)).alias("n_inside"), F.min(F.col("r.e") - F.col("r.s") + 1).alias("container_len"))
    return a.select(*key).join(best, key, "left").select("aln_id", "read_b", "start_b", "diffs", F.coalesce("n_inside", F.lit(0)).alias("n_inside"), "container_len")


dual("contained_in_union", """select i.read_a, i.fwd, i.start_a, i.end_a, u.s as union_start, u.e as union_end from {intervals} i join """ + isl("read_a", "{alignments}") + " u on i.read_a = u.read_a and i.start_a >= u.s and i.end_a <= u.e where i.end_a - i.start_a + 1 < u.e - u.s + 1")
dual("unassigned_intervals", "select i.read_a, i.fwd, i.start_a, i.end_a from {intervals} i left anti join {alignments} a on a.read_a = i.read_a and a.fwd = i.fwd and a.start_a = i.start_a and a.end_a = i.end_a".replace("left anti", "anti"), "select i.read_a, i.fwd, i.start_a, i.end_a from {intervals} i left anti join {alignments} a on a.read_a = i.read_a and a.fwd = i.fwd and a.start_a = i.start_a and a.end_a = i.end_a")
_MEDIATED = """select a.read_a, i.start_a as i_start, j.start_a as j_start, cast(count(*) as bigint) as n from {alignments} a join {intervals} i on a.read_a = i.read_a and i.fwd = a.fwd and i.start_a <= a.end_a and a.start_a <= i.end_a
 join {intervals} j on a.read_b = j.read_a and j.fwd = a.fwd and j.start_a <= a.end_b and a.start_b <= j.end_a group by a.read_a, i.start_a, j.start_a"""
dual("mediated_pairs", _MEDIATED, binned(_MEDIATED, "{alignments} a", "{intervals} i"))
dual("positional_exposure", "select read_a, fwd, start_a, end_a, coalesce(start_a - lag(end_a) over (partition by read_a, fwd order by start_a) - 1, start_a) as exposed_left from {intervals}")
