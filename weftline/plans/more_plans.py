"""Further joins, windows, sets and statistics over the views, as SQL that both engines run."""

from __future__ import annotations

from .registry import binned, dual

_O = "order by start_a, end_a, read_b, aln_id, start_b, diffs"
dual("track_filter", "select a.aln_id, a.read_b, a.start_a, a.start_b, a.diffs from {alignments} a left join (select aln_id, read_a, read_b, start_a, start_b, diffs, sum(c) as hidden from (select x.aln_id, x.read_a, x.read_b, x.start_a, x.start_b, x.diffs, least(x.end_a, i.end_a) - greatest(x.start_a, i.start_a) + 1 as c from {alignments} x join {intervals} i on i.read_a = x.read_a and not i.fwd and i.start_a <= x.end_a and x.start_a <= i.end_a) q group by aln_id, read_a, read_b, start_a, start_b, diffs) h on h.aln_id = a.aln_id and h.read_a = a.read_a and h.read_b = a.read_b and h.start_a = a.start_a and h.start_b = a.start_b and h.diffs = a.diffs where a.end_a - a.start_a + 1 - coalesce(h.hidden, 0) >= 10")
dual("alignment_shift", "select read_b, cast(sum(case when fwd then start_b - start_a else start_b + end_a end) as bigint) as shift, min(abs(start_b - start_a)) as least_shift from {alignments} group by read_b")
_FACTOR_COUNTERS = "select i.read_a, i.fwd, i.start_a, cast(count(a.read_b) as bigint) as alignments, cast(count(distinct a.read_b) as bigint) as reads, cast(sum(case when a.start_a = i.start_a then 1 else 0 end) as bigint) as starts, cast(sum(case when a.end_a = i.end_a then 1 else 0 end) as bigint) as ends from {intervals} i join {alignments} a on a.read_a = i.read_a and a.start_a <= i.end_a and i.start_a <= a.end_a group by i.read_a, i.fwd, i.start_a"
dual("factor_counters", _FACTOR_COUNTERS, binned(_FACTOR_COUNTERS, "{intervals} i", "{alignments} a"))
dual("corrected_coverage", "select read_a, cast(sum(len) as bigint) as total, cast(count(*) as bigint) as pairs from (select read_a, read_b, max(end_a) - min(start_a) + 1 as len from {alignments} group by read_a, read_b) x group by read_a")
dual("variant_estimate", "select read_a, cast(count(distinct diffs // 2) as bigint) as variants, max(diffs) as most from {alignments} group by read_a")
dual("read_totals", "select cast(count(*) as bigint) as reads, cast(sum(length) as bigint) as total_length, max(length) as longest, cast(sum(case when length >= 2500 then 1 else 0 end) as bigint) as long_reads from {reads}")
dual("length_histogram", "select cast(length // 100 as bigint) as bucket, cast(count(*) as bigint) as n from {reads} group by length // 100")
dual("error_histogram", "select cast(200 * diffs as bigint) // ((end_a - start_a + 1) + (end_b - start_b + 1)) as percent, fwd, cast(count(*) as bigint) as n from {alignments} group by 1, 2", "select cast(200 * diffs as bigint) // ((end_a - start_a + 1) + (end_b - start_b + 1)) as percent, fwd, cast(count(*) as bigint) as n from {alignments} group by 1, 2")
dual("recall_classes", "select f is not null as in_forward, r is not null as in_reverse, cast(count(*) as bigint) as pairs from (select coalesce(a.read_a, b.read_a) as x, a.read_a as f, b.read_a as r from (select distinct read_a, read_b from {alignments} where fwd) a full outer join (select distinct read_a, read_b from {alignments} where not fwd) b on a.read_a = b.read_a and a.read_b = b.read_b) q group by 1, 2")
dual("tree_rollup", "select r.r_name, n.n_name, cast(count(*) as bigint) as customers, round(sum(c.c_acctbal), 2) as balance from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey group by rollup(r.r_name, n.n_name)")
dual("partial_merge", "select read_b, cast(sum(n) as bigint) as n, max(longest) as longest from (select read_b, read_a % 8 as shard, count(*) as n, max(end_a - start_a + 1) as longest from {alignments} group by read_b, read_a % 8) x group by read_b")
dual("adjacent_merge", "select read_a, fwd, cast(count(*) as bigint) as n, cast(sum(case when gap <= 5 then 1 else 0 end) as bigint) as merged from (select read_a, fwd, start_a - lag(end_a) over (partition by read_a, fwd order by start_a) as gap from {intervals}) x group by read_a, fwd")
dual("density_windows", "select read_a, pos, cast(count(*) over (partition by read_a order by pos range between 100 preceding and 100 following) as bigint) as near from (select read_a, cast(start_a as bigint) as pos from {alignments}) x")
_LEAST_DIFFS_INSIDE = "select c.read_a, c.read_b, c.start_a, c.aln_id, c.start_b, c.diffs, min(o.diffs) as outer_diffs from {alignments} c join {alignments} o on o.read_a = c.read_a and o.start_a <= c.start_a and o.end_a >= c.end_a and o.end_a - o.start_a > c.end_a - c.start_a group by c.read_a, c.read_b, c.start_a, c.aln_id, c.start_b, c.diffs having min(o.diffs) > c.diffs"
dual("least_diffs_inside", _LEAST_DIFFS_INSIDE, binned(_LEAST_DIFFS_INSIDE, "{alignments} c", "{alignments} o"))
dual("bad_runs", "select read_a, cast(count(*) as bigint) as runs, cast(max(n) as bigint) as longest from (select read_a, g, count(*) as n from (select read_a, bad, rn - row_number() over (partition by read_a, bad order by rn) as g from (select read_a, diffs >= 7 as bad, row_number() over (partition by read_a " + _O + ") as rn from {alignments}) a) b where bad group by read_a, g having count(*) >= 2) c group by read_a")
dual("first_peer", "select char_id, min(char_id) over (partition by repeat, fwd, end_p - start_p, length) as peer from {alphabet}")
# ranges of 64 reads are balanced, so what is put in order is small beside the alignments
dual("balanced_work", "select work, cast(count(*) as bigint) as ranges, cast(sum(n) as bigint) as alignments from (select n, cast(least(7, (sum(n) over (order by part rows unbounded preceding) - n) * 8 // sum(n) over ()) as int) as work from (select read_a // 64 as part, cast(count(*) as bigint) as n from {alignments} group by read_a // 64) x) y group by work")
dual("key_partitions", "select read_a % 16 as part, cast(count(*) as bigint) as n, min(read_a) as first_read, max(read_a) as last_read from {alignments} group by read_a % 16")
dual("set_union", "select repeat, start_p from {alphabet} where fwd union select repeat, start_p from {alphabet} where not fwd")
dual("set_equality", "select a.repeat, cast(sum(case when a.start_p is not null and b.start_p is not null then 1 else 0 end) as bigint) as common, cast(count(*) as bigint) as total from (select distinct repeat, start_p from {alphabet} where fwd) a left join (select distinct repeat, start_p from {alphabet} where not fwd) b on a.repeat = b.repeat and a.start_p = b.start_p group by a.repeat")
dual("integer_functions", "select diffs, cast(max((start_a + 99) // 100 * 100) as bigint) as up, cast(max((start_a + 50) // 100) as bigint) as nearest, max(greatest(0, start_a - start_b)) as doz, cast(max(start_a & 255) as bigint) as low_bits from {alignments} group by diffs")
dual("histogram_summary", "select key, round(sum(pos * value) / sum(value), 4) as centre, round(max(value) / avg(value), 6) as peak from {points} group by key having sum(value) > 0")
dual("density_estimate", "select key, bucket, round(sum(exp(-0.5 * z * z)), 6) as density from (select p.key, b.bucket, (p.value - b.bucket * 10) / 5.0e0 as z from {points} p cross join (select 0 as bucket union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) b) x group by key, bucket")
dual("ratio_threshold", "select key, value as threshold from (select key, value, row_number() over (partition by key order by round(nxt - value, 9) desc, value) as rn from (select key, value, lead(value) over (partition by key order by value) as nxt from (select distinct key, value from {points}) d) x where nxt is not null) y where rn = 1")
dual("zip_join", "select a.read_a, cast(a.rn as bigint) as rn, a.aln_id, b.aln_id as other from (select read_a, aln_id, row_number() over (partition by read_a " + _O + ") as rn from {alignments} where fwd) a join (select read_a, aln_id, row_number() over (partition by read_a " + _O + ") as rn from {alignments} where not fwd) b on a.read_a = b.read_a and a.rn = b.rn")
dual("segment_translation", "select a.read_a, cast(a.start_a // 500 as bigint) as piece, cast(count(*) as bigint) as n, min(a.start_a % 500) as first_pos from {alignments} a where a.start_a // 500 = a.end_a // 500 group by a.read_a, a.start_a // 500")
dual("reverse_lookup", "select o.read_a, o.read_b, cast(count(*) as bigint) as n, cast(sum(case when r.read_a is not null then 1 else 0 end) as bigint) as answered from {alignments} o left join (select distinct read_b as read_a, read_a as read_b from {alignments}) r on o.read_a = r.read_a and o.read_b = r.read_b group by o.read_a, o.read_b")
dual("cluster_taxonomy", "select p_brand, quality_band, cast(count(*) as bigint) as n from (select p.p_brand, cast(a.diffs // 4 as bigint) as quality_band from {alignments} a join {part} p on a.read_a = p.p_partkey) x group by p_brand, quality_band")
_TRUTH_RANGE_JOIN = "select i.read_a, cast(count(*) as bigint) as n, cast(sum(case when i.start_a = t.start_a and i.end_a = t.end_a then 1 else 0 end) as bigint) as exact from {intervals} i join {intervals} t on i.read_a = t.read_a and i.fwd and not t.fwd and i.start_a <= t.end_a and t.start_a <= i.end_a group by i.read_a"
dual("truth_range_join", _TRUTH_RANGE_JOIN, binned(_TRUTH_RANGE_JOIN, "{intervals} i", "{intervals} t"))
dual("tandem_spacers", "select read_a, read_b, cast(count(*) as bigint) as spacers, min(gap) as least_gap from (select read_a, read_b, start_a - lag(end_a) over (partition by read_a, read_b " + _O.replace("read_b, ", "") + ") as gap from {alignments}) x where gap > 0 group by read_a, read_b")
dual("rare_characters", "select c.repeat, cast(count(*) as bigint) as chars, cast(sum(case when n = 1 then 1 else 0 end) as bigint) as rare from (select repeat, start_p, end_p, count(*) as n from {alphabet} group by repeat, start_p, end_p) c group by c.repeat")

# 1 if an alignment could not go on to either side, 0 if it could, -1 if a read ends there and nothing can be said
dual("maximality_states", "select left_state, right_state, cast(count(*) as bigint) as n from (select case when a.start_a <= 20 or a.start_b <= 20 then -1 when a.diffs >= 5 then 0 else 1 end as left_state, case when a.end_a >= r.length - 80 or a.end_b >= 990 then -1 when a.diffs >= 5 then 0 else 1 end as right_state from {alignments} a join {reads} r on r.read_id = a.read_a) x group by left_state, right_state")
# positions from the first to the last good value, in positions of the read
dual("quality_trim_positions", "select read_a, min(start_a) as first_pos, max(end_a) as last_pos, min(case when diffs < 3 then start_a end) as trimmed_first, max(case when diffs < 3 then end_a end) as trimmed_last from {alignments} group by read_a")
# neighbouring intervals of a kind that lie at most five positions apart are one
dual("merged_neighbours", "select read_a, fwd, min(start_a) as start_a, max(end_a) as end_a, cast(count(*) as bigint) as parts from (select *, sum(case when start_a - p_end <= 5 then 0 else 1 end) over (partition by read_a, fwd order by start_a rows unbounded preceding) as grp from (select *, lag(end_a) over (partition by read_a, fwd order by start_a) as p_end from {intervals}) x) y group by read_a, fwd, grp")
# coverage without the forward alignments that the same pair of reads has in reverse too, at about the same place on both
_TWIN = "select f.aln_id, f.read_a, f.read_b, f.start_a, f.start_b, f.diffs from {alignments} f join {alignments} r on r.read_a = f.read_a and r.read_b = f.read_b and f.fwd and not r.fwd and r.start_a <= f.end_a and f.start_a <= r.end_a and r.start_b <= f.end_b and f.start_b <= r.end_b where 5 * (least(f.end_a, r.end_a) - greatest(f.start_a, r.start_a) + 1) >= 4 * (greatest(f.end_a, r.end_a) - least(f.start_a, r.start_a) + 1) and 5 * (least(f.end_b, r.end_b) - greatest(f.start_b, r.start_b) + 1) >= 4 * (greatest(f.end_b, r.end_b) - least(f.start_b, r.start_b) + 1)"
dual("deduplicated_coverage", f"select a.read_a, cast(count(*) as bigint) as counted, cast(sum(a.end_a - a.start_a + 1) as bigint) as bases from {{alignments}} a where not exists (select 1 from ({_TWIN}) t where t.aln_id = a.aln_id and t.read_a = a.read_a and t.read_b = a.read_b and t.start_a = a.start_a and t.start_b = a.start_b and t.diffs = a.diffs) group by a.read_a")
# the first alignment of each read in each of fifteen orders
_ORDERS = ("start_a", "start_a desc", "end_a", "end_a desc", "read_b, start_a", "read_b, start_b", "read_b desc, end_b", "start_b", "end_b desc", "diffs, start_a", "diffs desc, end_a", "end_a - start_a, start_a", "end_a - start_a desc, start_a", "fwd, start_a", "aln_id")
dual("first_by_order", "select read_a, " + ", ".join(f"max(case when o{i} = 1 then aln_id end) as by{i:02}" for i in range(15)) + " from (select read_a, aln_id, " + ", ".join(f"row_number() over (partition by read_a order by {o}, start_a, end_a, read_b, aln_id, start_b, diffs) as o{i}" for i, o in enumerate(_ORDERS)) + " from {alignments}) x group by read_a")
# an alignment on each segment of its read that it touches, clipped there
dual("segment_pieces", "select a.read_a, cast(s.piece as bigint) as piece, cast(count(*) as bigint) as n, cast(sum(least(a.end_a, s.piece * 500 + 499) - greatest(a.start_a, s.piece * 500) + 1) as bigint) as bases from {alignments} a join (select 0 as piece union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) s on a.start_a <= s.piece * 500 + 499 and s.piece * 500 <= a.end_a group by a.read_a, s.piece")
# the character of an alignment: the same start, else a start within one quantum, else the nearest of its repeat
dual("nearest_character", "select l.read_b, cast(count(*) as bigint) as n, cast(sum(case when e.start_p is not null then 1 else 0 end) as bigint) as exact, cast(sum(case when e.start_p is null and q.near = 1 then 1 else 0 end) as bigint) as within_one, cast(sum(case when e.start_p is null and q.near is null then 1 else 0 end) as bigint) as farther from {alignments} l left join (select distinct repeat, fwd, start_p from {alphabet} where fwd) e on e.repeat = l.read_b and e.fwd = l.fwd and e.start_p = (l.start_b + 50) // 100 * 100 left join (select repeat, fwd, start_p, max(1) as near from (select distinct repeat, fwd, start_p + d as start_p from (select repeat, fwd, start_p from {alphabet} where fwd) c cross join (select -100 as d union all select 100) w) x group by repeat, fwd, start_p) q on q.repeat = l.read_b and q.fwd = l.fwd and q.start_p = (l.start_b + 50) // 100 * 100 group by l.read_b")
# characters that are rare go; an alignment whose character is rare loses its block
dual("cleaned_characters", "select l.read_a, cast(count(*) as bigint) as blocks, cast(sum(case when c.n >= 2 then 1 else 0 end) as bigint) as kept, cast(sum(case when c.n = 1 then 1 else 0 end) as bigint) as cleaned from {alignments} l left join (select repeat, fwd, start_p, count(*) as n from {alphabet} group by repeat, fwd, start_p) c on c.repeat = l.read_b and c.fwd = l.fwd and c.start_p = (l.start_b + 50) // 100 * 100 group by l.read_a")
# distinct characters of reads' blocks, numbered: quantised substrings of repeats with how often they occur
dual("character_instances", "select read_b as repeat, fwd, cast((start_b + 50) // 100 * 100 as int) as start_p, cast((end_b + 50) // 100 * 100 as int) as end_p, cast(count(*) as bigint) as n, cast(count(distinct read_a) as bigint) as reads from {alignments} where diffs < 5 group by read_b, fwd, (start_b + 50) // 100 * 100, (end_b + 50) // 100 * 100")
# the header of an alphabet: sizes of its sections and the greatest open length
dual("alphabet_header", "select cast(sum(case when start_p = -1 then 1 else 0 end) - 1 as bigint) as last_periodic, cast(count(*) - 1 as bigint) as last_alphabet, max(case when open_start or open_end then case when start_p = -1 then length else end_p - start_p + 1 end end) as longest_open from {alphabet}")
# types of continuation when the last block is read: the same repeat goes on, another one starts, or none is known
dual("end_blocks", "select read_a, cast(count(*) as bigint) as blocks, max(case when at_end and char_n > 1 then 1 else 0 end) = 1 as ambiguous, max(case when at_end then read_b end) as last_repeat from (select a.read_a, a.read_b, c.n as char_n, row_number() over (partition by a.read_a order by a.end_a desc, a.start_a, a.read_b, a.aln_id, a.start_b, a.diffs) = 1 as at_end from {alignments} a left join (select repeat, fwd, start_p, count(*) as n from {alphabet} group by repeat, fwd, start_p) c on c.repeat = a.read_b and c.fwd = a.fwd and c.start_p = (a.start_b + 50) // 100 * 100) x group by read_a")
