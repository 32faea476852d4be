"""A simulated genome, reads from it, and the truth: which repeats lie where on each read.

All numbers come from hashes of ids, so every row can be made anew anywhere. The genome is a line of slots of SLOT positions;
a slot holds one unit, at its start: a unique stretch, or an instance of one of REPEATS repeats, in either orientation, whole
or cut at one end, with a share of errors. Reads start anywhere.
"""

from __future__ import annotations

from .registry import dual

#: Positions of a slot, repeats, least and further length of reads.
SLOT, REPEATS, SHORTEST, FURTHER = 4000, 25, 5000, 9000


def _forms(sql: str) -> tuple[str, str]:
    """DuckDB's and Spark's forms: H(x, salt) is a number of 28 bits, SLOTS(a, b) the slots of a read."""
    import re

    duck = re.sub(r"H\((\w+), (\d+)\)", r"cast(concat('0x', substr(md5(concat(cast(\1 as varchar), ':\2')), 1, 7)) as bigint)", sql)
    spark = re.sub(r"H\((\w+), (\d+)\)", r"cast(conv(substr(md5(concat(cast(\1 as string), ':\2')), 1, 7), 16, 10) as bigint)", sql)
    return duck.replace("SLOTS(", "unnest(range(").replace("LAST)", "last_slot + 1))"), spark.replace("SLOTS(", "explode(sequence(").replace("LAST)", "last_slot))")


# a repeat's length; a unit's kind, orientation, cuts and errors
_REPEATS = f"select r as repeat, 600 + H(r, 1) % 3000 as length from (select distinct read_id % {REPEATS} as r from {{reads}}) q"
_UNITS = f"""select u.slot, r.repeat, r.length, u.fwd, case when u.cut = 0 then u.much % r.length // 2 else 0 end as cut_start, case when u.cut = 1 then u.much % r.length // 2 else 0 end as cut_end, u.errors
 from (select read_id as slot, H(read_id, 2) % {REPEATS} as repeat, H(read_id, 3) % 2 = 0 as fwd, H(read_id, 4) % 3 as cut, H(read_id, 5) as much, H(read_id, 6) % 15 as errors from {{reads}} where H(read_id, 7) % 3 > 0) u join ({_REPEATS}) r on r.repeat = u.repeat"""
_READS = f"select read_id, start, start + size - 1 as end_, start // {SLOT} as first_slot, (start + size - 1) // {SLOT} as last_slot from (select read_id, H(read_id, 8) * 64 % ((select count(*) from {{reads}}) * {SLOT}) as start, {SHORTEST} + H(read_id, 9) % {FURTHER} as size from {{reads}}) q"
_TRUTH = f"""select s.read_id, u.slot, u.repeat, u.fwd, greatest(0, u.slot * {SLOT} - s.start) as start_a, least(s.end_, u.slot * {SLOT} + u.length - u.cut_start - u.cut_end - 1) - s.start as end_a,
 case when u.fwd then u.cut_start + greatest(0, s.start - u.slot * {SLOT}) else u.cut_start + greatest(0, u.slot * {SLOT} + u.length - u.cut_start - u.cut_end - 1 - s.end_) end as start_b, u.errors
 from (select *, SLOTS(first_slot, LAST) as slot from ({_READS}) r) s join ({_UNITS}) u on u.slot = s.slot where greatest(s.start, u.slot * {SLOT}) <= least(s.end_, u.slot * {SLOT} + u.length - u.cut_start - u.cut_end - 1)"""
dual("simulated_genome", *_forms(f"select slot, repeat, length, fwd, cut_start, cut_end, errors from ({_UNITS}) u"))
dual("simulated_truth", *_forms(_TRUTH))
# copies of each repeat in the genome, and the alignments and positions that its instances have on reads
dual("simulated_frequencies", *_forms(f"select repeat, cast(count(*) as bigint) as on_reads, cast(count(distinct slot) as bigint) as seen_copies, cast(sum(end_a - start_a + 1) as bigint) as bases, cast(sum(case when fwd then 1 else 0 end) as bigint) as forward from ({_TRUTH}) t group by repeat"))
# how much of each read is repeat in truth, and the number of borders between repeats and unique stretches inside it
dual("simulated_surface", *_forms(f"select read_id, cast(sum(end_a - start_a + 1) as bigint) as repeat_bases, cast(count(*) as bigint) as instances, cast(sum(case when start_a > 0 then 1 else 0 end) as bigint) as borders from ({_TRUTH}) t group by read_id"))
