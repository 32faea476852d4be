"""Types of intervals and overlaps, guards of assignments and windows, arrays, samples and reports."""

from __future__ import annotations

from weftline.functions import kinds

from .registry import dual

_TOK = "(select read_id, i - 1 as pos, toks[i] as tok from (select read_id, toks, unnest(range(1, len(toks) + 1)) as i from {tokens}) a)"
_STOK = "(select read_id, pos, tok from {tokens} lateral view posexplode(toks) p as pos, tok)"

# how an overlap's sides change: a side is 0 at a prefix and 1 at a suffix, and the overlap is the bit at 2 * first + second
_SIDES = "select fwd, start_a < 500 as prefix_a, start_b < 500 as prefix_b, cast(count(*) as bigint) as n from {alignments} group by fwd, start_a < 500, start_b < 500"
_ID = "(case when prefix_a then 0 else 2 end + case when prefix_b then 0 else 1 end)"
_OPPOSITE = "(case when prefix_b then 0 else 2 end + case when prefix_a then 0 else 1 end)"
dual("overlap_algebra", f"""select prefix_a, prefix_b, cast(sum(n) as bigint) as n, cast(max(case {_ID} when 0 then 1 when 1 then 2 when 2 then 4 else 8 end) as int) as overlap, cast(max(case {_OPPOSITE} when 0 then 1 when 1 then 2 when 2 then 4 else 8 end) as int) as opposite,
 cast(max({kinds.flipped_sql(_ID, 0)}) as int) as first_reversed, cast(max({kinds.flipped_sql(_ID, 1)}) as int) as second_reversed, cast(max({kinds.flipped_sql(_ID, 2)}) as int) as both_reversed, cast(max(case when prefix_a = prefix_b then 1 else 0 end) as int) as orientation from ({_SIDES}) s group by prefix_a, prefix_b""")
_CODES = " union all ".join(f"select {i} as code" for i in range(7))
dual("type_algebra", f"select a.code as first, b.code as second, o.turn, cast({kinds.oriented_sql('a.code', 'o.turn')} as int) as first_turned, cast({kinds.merged_sql('a.code', 'b.code')} as int) as merged, {kinds.substring_sql('a.code', 'b.code', 'o.turn')} as may_be_part from ({_CODES}) a cross join ({_CODES}) b cross join (select 0 as turn union all select 1 union all select 2) o")
dual("type_labels", f"select code, {kinds.label_sql('code')} as label, {kinds.colour_sql('code')} as colour from ({_CODES}) c")

# alignments that an interval may take: about inside it, and not maximal on a side where the interval is not
dual("assignable", "select i.read_a, i.fwd, i.start_a, cast(count(a.read_b) as bigint) as assigned, cast(sum(case when abs(a.start_a - i.start_a) <= 10 then 1 else 0 end) as bigint) as at_start, cast(sum(case when abs(a.end_a - i.end_a) <= 10 then 1 else 0 end) as bigint) as at_end from {intervals} i join {alignments} a on a.read_a = i.read_a and a.fwd = i.fwd and a.start_a >= i.start_a - 10 and a.end_a <= i.end_a + 10 group by i.read_a, i.fwd, i.start_a having sum(case when abs(a.start_a - i.start_a) <= 10 then 1 else 0 end) >= 1 and sum(case when abs(a.end_a - i.end_a) <= 10 then 1 else 0 end) >= 1")
# windows of three blocks whose end blocks are not unique and whose blocks are all long; a block is a token
_VALID = "select read_id, cast(count(*) as bigint) as windows, cast(sum(case when u0 = 1 or u2 = 1 then 0 else 1 end) as bigint) as ends_known, cast(sum(case when u0 = 1 or u1 = 1 or u2 = 1 then 0 else 1 end) as bigint) as all_known, cast(sum(case when least(length(t0), length(t1), length(t2)) >= 3 and not (u0 = 1 or u2 = 1) then 1 else 0 end) as bigint) as valid from (select read_id, tok as t0, lead(tok) over w as t1, lead(tok, 2) over w as t2, u as u0, lead(u) over w as u1, lead(u, 2) over w as u2 from (select x.read_id, x.pos, x.tok, case when c.n = 1 then 1 else 0 end as u from T x join (select tok, count(*) as n from T y group by tok) c on c.tok = x.tok) z window w as (partition by read_id order by pos)) v where t2 is not null group by read_id"
dual("valid_windows", _VALID.replace("T x", _TOK + " x").replace("T y", _TOK + " y"), _VALID.replace("T x", _STOK + " x").replace("T y", _STOK + " y"))
# open characters that a longer one of their repeat could stand for
dual("ambiguous_ends", "select c.repeat, c.fwd, cast(count(*) as bigint) as open_chars, cast(sum(case when c.open_end and l.longest > c.end_p - c.start_p then 1 else 0 end) as bigint) as ambiguous_right, cast(sum(case when c.open_start and l.longest > c.end_p - c.start_p then 1 else 0 end) as bigint) as ambiguous_left from {alphabet} c join (select repeat, fwd, max(end_p - start_p) as longest from {alphabet} where start_p >= 0 group by repeat, fwd) l on l.repeat = c.repeat and l.fwd = c.fwd where c.start_p >= 0 and (c.open_start or c.open_end) group by c.repeat, c.fwd")
# whether a read's forward and reverse intervals are the same blocks: as many, with bounds near each other
_NTH = "select *, row_number() over (partition by read_a, fwd order by start_a) as rn, count(*) over (partition by read_a, fwd) as n from {intervals}"
dual("same_factorization", f"select f.read_a, cast(min(f.n) as bigint) as forward_blocks, cast(min(r.n) as bigint) as reverse_blocks, min(f.n) = min(r.n) and max(greatest(abs(f.start_a - r.start_a), abs(f.end_a - r.end_a))) <= 50 as same, cast(sum(case when f.start_a <= r.end_a and r.start_a <= f.end_a then 1 else 0 end) as bigint) as shared from ({_NTH}) f join ({_NTH}) r on r.read_a = f.read_a and r.rn = f.rn and f.fwd and not r.fwd group by f.read_a")
dual("interval_counts", "select read_a, fwd, cast(count(*) as bigint) as intervals from {intervals} group by read_a, fwd")
dual("quality_histogram", "select diffs, cast(count(*) as bigint) as n, cast(sum(end_a - start_a + 1) as bigint) as bases from {alignments} group by diffs")
_COVER = "select cover, cast(sum(nxt - pos) as bigint) as positions from (select pos, lead(pos) over (partition by read_a order by pos) as nxt, sum(step) over (partition by read_a order by pos rows unbounded preceding) as cover from (select read_a, pos, sum(step) as step from (select read_a, start_a as pos, 1 as step from {alignments} union all select read_a, end_a + 1, -1 from {alignments}) x group by read_a, pos) y) z where nxt is not null group by cover"
dual("coverage_histogram", _COVER.replace("select cover,", "select cast(cover as bigint) as coverage,", 1))
# repeats without alignment, and those that alignments cover by less than 0.9 of their length
_UNION = "select read_a, sum(e - s + 1) as covered from (select read_a, min(start_a) as s, max(end_a) as e from (select *, sum(case when m is null or start_a > m + 1 then 1 else 0 end) over (partition by read_a order by start_a, end_a rows unbounded preceding) as grp from (select read_a, start_a, end_a, max(end_a) over (partition by read_a order by start_a, end_a rows between unbounded preceding and 1 preceding) as m from {alignments} where fwd and diffs < 5) x) y group by read_a, grp) z group by read_a"
dual("coverage_report", f"select cast(count(*) as bigint) as repeats, cast(sum(case when c.read_a is null then 1 else 0 end) as bigint) as unaligned, cast(sum(case when 10 * coalesce(c.covered, 0) < 9 * r.span then 1 else 0 end) as bigint) as not_covered from (select read_a, max(end_a) - min(start_a) + 1 as span from {{alignments}} group by read_a) r left join ({_UNION}) c on c.read_a = r.read_a")
_CLEAN = "select doc_id, cast(length(clean) as bigint) as kept, cast(length(text) - length(clean) as bigint) as removed, case when length(clean) between 1 and 199 then cast((199 + length(clean)) // length(clean) as bigint) else 1 end as copies from (select doc_id, text, regexp_replace(lower(text), '[^acgt]', ''G) as clean from {documents} where text is not null) x"
dual("clean_sequences", _CLEAN.replace("G)", ", 'g')"), _CLEAN.replace("G)", ")"))
# points of a simplex from hashes: exponential numbers over their sum
_H = "select read_id, -ln((HA + 1) / 4294967297.0e0) as a, -ln((HB + 1) / 4294967297.0e0) as b, -ln((HC + 1) / 4294967297.0e0) as c from {reads}"


def _hashed(form: str) -> str:
    return _H.replace("HA", form.replace("K", "read_id")).replace("HB", form.replace("K", "read_id + 7000000")).replace("HC", form.replace("K", "read_id + 9000000"))


_SIMPLEX = "select read_id, round(a / (a + b + c), 9) as x, round(b / (a + b + c), 9) as y, round(c / (a + b + c), 9) as z from (H) h"
dual("simplex_samples", _SIMPLEX.replace("(H)", "(" + _hashed("cast(concat('0x', substr(md5(cast(K as varchar)), 1, 8)) as bigint)") + ")"), _SIMPLEX.replace("(H)", "(" + _hashed("cast(conv(substr(md5(cast(K as string)), 1, 8), 16, 10) as bigint)") + ")"))
# arrays: fill, place in order, least positive value, and what -1-x stands for, sorted without repeats
_ARRAYS = "select repeat, N(starts) as n, cast(LEAST as bigint) as least_positive, cast(PLACE as bigint) as place_of_500, TEXT as decoded, cast(FILLED as bigint) as filled from (select repeat, ARR as starts from {alphabet} group by repeat) x"
dual("array_functions", _ARRAYS.replace("N(starts)", "cast(len(starts) as bigint)").replace("ARR", "list_sort(list_distinct(list(start_p)))").replace("LEAST", "list_min([v for v in starts if v > 0])").replace("PLACE", "len([v for v in starts if v < 500])").replace("TEXT", "array_to_string(list_sort(list_distinct([case when v < 0 then -1 - v else v end for v in starts]))[1:5], ',')").replace("FILLED", "list_sum([7 for v in starts])"),
     _ARRAYS.replace("N(starts)", "cast(size(starts) as bigint)").replace("ARR", "array_sort(collect_set(start_p))").replace("LEAST", "array_min(filter(starts, v -> v > 0))").replace("PLACE", "size(filter(starts, v -> v < 500))").replace("TEXT", "array_join(slice(array_sort(array_distinct(transform(starts, v -> case when v < 0 then -1 - v else v end))), 1, 5), ',')").replace("FILLED", "aggregate(array_repeat(7, size(starts)), 0, (a, v) -> a + v)"))
dual("weighted_quantiles", "select key, cast(min(case when mass >= total / 4 then pos end) as bigint) as lower, cast(min(case when mass >= total / 2 then pos end) as bigint) as median, cast(min(case when mass >= 3 * total / 4 then pos end) as bigint) as upper, round(max(mean), 4) as mean, round(sqrt(max(square) - max(mean) * max(mean)), 2) as spread from (select key, pos, round(sum(w) over (partition by key order by pos, w), 6) as mass, round(sum(w) over (partition by key), 6) as total, sum(pos * w) over (partition by key) / sum(w) over (partition by key) as mean, sum(cast(pos as double) * pos * w) over (partition by key) / sum(w) over (partition by key) as square from (select key, pos, cast(value as double) as w from {points} where value > 0) p) x group by key")
# tokens that occur as often as a genome with one or two copies would have them: Poisson, two-sided, by copies
_SIG = """with t as (select tok, count(*) as n, sum(case when pos = 0 then 1 else 0 end) as part from T x group by tok),
 s as (select count(*) as reads, cast(floor(avg(SIZE)) as double) - 3 as surface from {tokens} where SIZE > 3), g as (select cast(4 * count(*) as double) as genome, max(n) as most from t),
 l as (select c.copies, s.surface / g.genome * (s.reads // 2) * c.copies as lam from s cross join g cross join (select 1 as copies union all select 2) c),
 f as (select l.copies, k.j, exp(k.j * ln(l.lam) - l.lam - k.lnf) as p from l cross join K k),
 d as (select copies, j, sum(p) over (partition by copies order by j rows unbounded preceding) as cdf from f)
 select t.tok, cast(t.n as bigint) as n, cast(min(case when t.n > 1 and 2 * least(d.cdf, 1 - d.cdf) > 0.05 then d.copies end) as int) as copies, max(case when d.copies = 1 and t.n > 1 and d.cdf > 0.05 then 1 else 0 end) = 1 as frequent from t join d on d.j = t.n group by t.tok, t.n"""
_K = "(select j, sum(case when j > 0 then ln(j) else 0 end) over (order by j) as lnf from (select SERIES as j from g) q)"
# Spark's form ends the sums at 2000 more than twice the larger mean, where each further p is below exp(-746) and so 0: the sums stay as
# they are, and tokens that occur more often read the last one. Else there were two rows for each number up to the most frequent token's.
_LAST = "(select least(most, cast(floor(4 * (s.surface / g.genome * (s.reads // 2))) as bigint) + 2000) as most from g cross join s)"
_SIG_SPARK = _SIG.replace("T x", _STOK + " x").replace("SIZE", "size(toks)").replace("K k", _K.replace("SERIES", "explode(sequence(0, most))").replace("from g)", f"from {_LAST} m)") + " k")
_SIG_SPARK = _SIG_SPARK.replace("from t join d on d.j = t.n", f"from (select t.tok, t.n, least(t.n, m.most) as place from t cross join {_LAST} m) t join d on d.j = t.place")
dual("significant_tokens", _SIG.replace("T x", _TOK + " x").replace("SIZE", "len(toks)").replace("K k", _K.replace("SERIES", "unnest(range(0, most + 1))") + " k"), _SIG_SPARK)

# kernels (reads B) whose members (reads A) are all in another kernel too; of equals the first stays
_MEMBERS = "select distinct read_b as kernel, read_a as member from {alignments} where diffs = 0 and fwd"
dual("redundant_kernels", f"with m as ({_MEMBERS}), s as (select kernel, count(*) as size from m group by kernel), p as (select a.kernel, b.kernel as other, count(*) as common from m a join m b on a.member = b.member and a.kernel <> b.kernel group by a.kernel, b.kernel) select s.kernel, cast(s.size as bigint) as size, cast(coalesce(max(p.common), 0) as bigint) as most_shared, coalesce(max(case when p.common = s.size and (o.size > s.size or p.other < s.kernel) then 1 else 0 end), 0) = 1 as redundant from s left join p on p.kernel = s.kernel left join s o on o.kernel = p.other group by s.kernel, s.size")
# kernels that alone cover a part of some read, and how much of all they cover that is
_ALONE = "select read_a, pos, nxt, n, who from (select read_a, pos, lead(pos) over (partition by read_a order by pos) as nxt, sum(d) over (partition by read_a order by pos rows unbounded preceding) as n, sum(w) over (partition by read_a order by pos rows unbounded preceding) as who from (select read_a, pos, sum(d) as d, sum(w) as w from (select read_a, start_a as pos, 1 as d, read_b as w from {alignments} union all select read_a, end_a + 1, -1, -read_b from {alignments}) x group by read_a, pos) y) z"
dual("exposed_kernels", f"select k.read_b as kernel, cast(k.surface as bigint) as surface, cast(coalesce(a.alone, 0) as bigint) as alone, 10 * coalesce(a.alone, 0) >= k.surface as exposed from (select read_b, sum(end_a - start_a + 1) as surface from {{alignments}} group by read_b) k left join (select who, sum(nxt - pos) as alone from ({_ALONE}) q where n = 1 and nxt is not null group by who) a on a.who = k.read_b")
# one row for each read B with all that is reported of it
dual("consensus_report", f"select k.read_b, cast(count(*) as bigint) as alignments, cast(count(distinct k.read_a) as bigint) as reads, cast(sum(k.end_a - k.start_a + 1) as bigint) as surface, cast(max(coalesce(a.alone, 0)) as bigint) as utility, cast(sum(case when k.diffs = 0 then 1 else 0 end) as bigint) as exact, round(avg(cast(k.diffs as double)), 6) as mean_diffs from {{alignments}} k left join (select who, sum(nxt - pos) as alone from ({_ALONE}) q where n = 1 and nxt is not null group by who) a on a.who = k.read_b group by k.read_b")
# members of each cluster by brand of the read and region of the supplier
dual("cluster_report", "select p.p_brand, k.size_class, cast(count(*) as bigint) as reads, cast(count(distinct p.p_type) as bigint) as kinds from (select read_a, cast(least(5, count(distinct read_b) // 8) as bigint) as size_class from {alignments} group by read_a) k join {part} p on p.p_partkey = k.read_a group by p.p_brand, k.size_class")
