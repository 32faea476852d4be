"""K-mers of tokens, dictionaries of characters, and ordered signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.sources.views import view

from .registry import QUERIES, SQL, dual
from weftline.sources import views


def kmers(tokens, k: int, canonical: bool = False):
    """(read_id, pos, kmer): all windows of k tokens, made within the row; the lesser of a window and its reverse if canonical."""
    return once(tokens, "toks").select("read_id", F.posexplode(_windows(k, canonical)).alias("pos", "kmer"))


def once(df, name: str):
    """df with the column worked out once for each row: else it would be again for each element that a lambda looks up."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(name)).alias(name))


def _windows(k: int, canonical: bool = False):
    """The windows of k tokens of a row, in order; null where there is none."""
    n = F.size("toks") - k + 1

    def window(i):
        parts = [F.get("toks", i + j) for j in range(k)]
        text = F.concat_ws(" ", *parts)
        return F.least(text, F.concat_ws(" ", *reversed(parts))) if canonical and k > 1 else text

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), window))


def _run_starts(name: str):
    """Places of an array where an element differs from the one before."""
    return F.filter(F.sequence(F.lit(0), F.size(name) - 1), lambda i: (i == 0) | (F.get(name, i) != F.get(name, i - 1)))


def kmers_of_reads(tokens, k: int):
    """(kmer, n) for each read and each of its canonical k-mers: counted within the row, as runs of its sorted windows."""
    rows = once(once(tokens, "toks").select(F.array_sort(_windows(k, True)).alias("w")).where("w is not null"), "w")
    rows = once(rows.select("w", _run_starts("w").alias("s")), "s")
    runs = F.transform("s", lambda p, j: F.struct(F.get("w", p).alias("kmer"), (F.coalesce(F.get("s", j + 1), F.size("w")) - p).cast("long").alias("n")))
    return rows.select(F.explode(runs).alias("r")).select("r.kmer", "r.n")


_K = """(select read_id, pos, least(kmer, array_to_string(list_reverse(string_split(kmer, ' ')), ' ')) as kmer from (select read_id, i - 1 as pos, array_to_string(toks[i:i+{K}-1], ' ') as kmer
 from (select read_id, toks, unnest(range(1, len(toks) - {K} + 2)) as i from {tokens}) a) b)"""


def _counts(k: int):
    def f(spark, d):
        one = kmers_of_reads(view(spark, d, "tokens"), k)
        return one.groupBy("kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("reads"), F.max("n").alias("most_in_read"))

    return f


for _k in (1, 2, 3, 4):
    QUERIES[f"kmer_counts_k{_k}"] = _counts(_k)
    SQL[f"kmer_counts_k{_k}"] = views.oracle("select kmer, cast(sum(n) as bigint) as n, cast(count(*) as bigint) as reads, max(n) as most_in_read from (select kmer, read_id, count(*) as n from " + _K.replace("{K}", str(_k)) + " c group by kmer, read_id) x group by kmer")


def kminusone_contexts(spark, d):
    """For each pair of tokens, its next token if that is always the same, else -2."""
    n = F.size("toks") - 2
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.concat_ws(" ", F.get("toks", i), F.get("toks", i + 1)).alias("pair"), F.get("toks", i + 2).alias("nxt")))
    three = once(view(spark, d, "tokens"), "toks").select(F.explode(F.when(n > 0, each)).alias("x")).select("x.pair", "x.nxt")
    return three.groupBy("pair").agg(F.when(F.min("nxt") == F.max("nxt"), F.min("nxt")).otherwise("-2").alias("follows"), F.count(F.lit(1)).alias("n"))


QUERIES["kminusone_contexts"] = kminusone_contexts
SQL["kminusone_contexts"] = views.oracle("select toks[i] || ' ' || toks[i+1] as pair, case when count(distinct toks[i+2]) = 1 then min(toks[i+2]) else '-2' end as follows, cast(count(*) as bigint) as n from (select toks, unnest(range(1, len(toks) - 1)) as i from {tokens}) a group by 1")


def shortest_unique(spark, d, most: int = 3):
    """Windows of unique k-mers that contain no shorter unique window, for k up to `most`: one anti-join for each k."""
    tokens, found = view(spark, d, "tokens"), None
    for k in range(1, most + 1):
        grams = kmers(tokens, k)
        once = grams.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min("read_id").alias("read_id"), F.min("pos").alias("pos")).where("n = 1")
        now = once.select("read_id", "pos", F.lit(k).alias("k"))
        if found is not None:
            inside = found.select("read_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") + F.col("k") - k), F.col("pos"))).alias("pos")).distinct()
            now = now.join(inside, ["read_id", "pos"], "left_anti")
        found = now if found is None else found.unionAll(now)
    return found.groupBy("read_id", "k").agg(F.count(F.lit(1)).alias("n"))


QUERIES["shortest_unique"] = shortest_unique
_G = "(select read_id, i - 1 as pos, array_to_string(toks[i:i+{k}-1], ' ') as kmer from (select read_id, toks, unnest(range(1, len(toks) - {k} + 2)) as i from {{tokens}}) a{k})"
_U = "(select min(read_id) as read_id, min(pos) as pos from " + _G + " g{k} group by kmer having count(*) = 1)"
SQL["shortest_unique"] = views.oracle(
    f"with u1 as {_U.format(k=1)}, u2 as {_U.format(k=2)}, u3 as {_U.format(k=3)}, k2 as (select * from u2 where not exists (select 1 from u1 where u1.read_id = u2.read_id and u1.pos between u2.pos and u2.pos + 1)),"
    " k3 as (select * from u3 where not exists (select 1 from u1 where u1.read_id = u3.read_id and u1.pos between u3.pos and u3.pos + 2) and not exists (select 1 from k2 where k2.read_id = u3.read_id and k2.pos between u3.pos and u3.pos + 1))"
    " select read_id, k, cast(count(*) as bigint) as n from (select read_id, 1 as k from u1 union all select read_id, 2 from k2 union all select read_id, 3 from k3) x group by read_id, k"
)

_TOK = "(select read_id, i - 1 as pos, toks[i] as tok from (select read_id, toks, unnest(range(1, len(toks) + 1)) as i from {tokens}) a)"
_STOK = "(select read_id, pos, tok from {tokens} lateral view posexplode(toks) p as pos, tok)"
_TANDEM = "select read_id, cast(count(*) as bigint) as runs, max(n) as longest from (select read_id, tok, pos - rn as g, count(*) as n from (select read_id, pos, tok, row_number() over (partition by read_id, tok order by pos) as rn from T x) y group by read_id, tok, pos - rn having count(*) > 1) z group by read_id"


def tandem_runs(spark, d):
    """Runs of one token, within the row."""
    rows = once(view(spark, d, "tokens"), "toks").where("size(toks) > 0")
    rows = once(rows.select("read_id", "toks", _run_starts("toks").alias("s")), "s")
    sizes = F.transform("s", lambda p, j: F.coalesce(F.get("s", j + 1), F.size("toks")) - p)
    runs = rows.select("read_id", F.filter(sizes, lambda x: x > 1).alias("r")).where("size(r) > 0")
    return runs.select("read_id", F.size("r").cast("long").alias("runs"), F.array_max("r").cast("long").alias("longest"))


QUERIES["tandem_runs"] = tandem_runs
SQL["tandem_runs"] = views.oracle(_TANDEM.replace("T x", _TOK + " x"))
_POIS = "select tok, cast(n as bigint) as n, round(exp(-lam) * lam, 6) as p_one, round(exp(-lam), 6) as p_none, n * reads > total as frequent from (select tok, count(*) as n, count(*) / cast(max(r) as double) as lam, max(r) as reads, max(t) as total from (select tok, (select count(*) from {tokens}) as r, (select count(*) from T x) as t from T x) y group by tok) z"
dual("kmer_poisson", _POIS.replace("T x", _TOK + " x"), _POIS.replace("T x", _STOK + " x"))
_TRIE = "select cast(length(tok) as bigint) as depth, prefix, cast(count(*) as bigint) as n from (select tok, substr(tok, 1, 2) as prefix from T x where length(tok) > 0) y group by length(tok), prefix"
dual("prefix_counts", _TRIE.replace("T x", _TOK + " x"), _TRIE.replace("T x", _STOK + " x"))
dual("prefix_rollup", "select p_brand, p_type, p_size, cast(count(*) as bigint) as n from {part} group by rollup(p_brand, p_type, p_size)")

dual("char_counts", "select repeat, fwd, cast(count(*) as bigint) as n, cast(sum(case when open_start or open_end then 1 else 0 end) as bigint) as open from {alphabet} group by repeat, fwd")
dual("char_symmetrised", "select char_id, cast(sum(1) over (partition by repeat, start_p, end_p, length) as bigint) as n, min(char_id) over (partition by repeat, start_p, end_p, length) as canon from {alphabet}")
dual("count_histogram", "select n, cast(count(*) as bigint) as chars from (select repeat, start_p, cast(count(*) as bigint) as n from {alphabet} group by repeat, start_p) x group by n")
dual("unique_contingency", "select least(n, 10) as times, least(r, 5) as repeats, cast(count(*) as bigint) as cells from (select start_p, end_p, count(*) as n, count(distinct repeat) as r from {alphabet} group by start_p, end_p) x group by least(n, 10), least(r, 5)")
dual("cluster_entropy", "select repeat, round(-sum(p * ln(p)), 6) as entropy, cast(sum(n) as bigint) as n from (select repeat, n, n / cast(sum(n) over (partition by repeat) as double) as p from (select repeat, start_p // 500 as cell, count(*) as n from {alphabet} group by repeat, start_p // 500) x) y group by repeat")
_IMPLIES = "o.repeat = c.repeat and o.fwd = c.fwd and o.char_id <> c.char_id and c.start_p >= 0 and o.start_p <= c.start_p and o.end_p >= c.end_p and (o.start_p < c.start_p or o.end_p > c.end_p) and (c.start_p = o.start_p or c.open_start) and (c.end_p = o.end_p or c.open_end) and (not o.open_start or c.open_start) and (not o.open_end or c.open_end)"
dual("nearest_implying", f"select c.char_id, cast(count(o.char_id) as bigint) as implied_by, min(o.char_id) as first_one, min(o.end_p - o.start_p) as shortest from {{alphabet}} c left join {{alphabet}} o on {_IMPLIES} group by c.char_id")
dual("dominance", f"select repeat, cast(count(*) as bigint) as kept from {{alphabet}} c where not exists (select 1 from {{alphabet}} o where {_IMPLIES}) group by repeat")
dual("close_alphabet", "select repeat, cast(count(*) as bigint) as missing from (select repeat, not fwd as fwd, start_p, end_p, length, open_end as open_start, open_start as open_end from {alphabet} except select repeat, fwd, start_p, end_p, length, open_start, open_end from {alphabet}) x group by repeat")
dual("setminus", "select repeat, start_p, end_p from {alphabet} where fwd except select repeat, start_p, end_p from {alphabet} where not fwd")
dual("set_intersection", "select repeat, start_p, end_p from {alphabet} where fwd intersect select repeat, start_p, end_p from {alphabet} where not fwd")
dual("wobble", "select distinct repeat, fwd, start_p, end_p, length + d as length from {alphabet} cross join (select -100 as d union all select 0 union all select 100) w where start_p = -1 and length + d > 0")
dual("translate", "select l.read_a, cast(count(c.char_id) as bigint) as translated, cast(count(*) as bigint) as blocks, min(c.char_id) as least_char from {alignments} l left join (select repeat, fwd, start_p, min(char_id) as char_id from {alphabet} group by repeat, fwd, start_p) c on l.read_b = c.repeat and l.fwd = c.fwd and c.start_p = (l.start_b + 50) // 100 * 100 group by l.read_a")

_W = "window w as (partition by key order by pos, event_type, value)"
dual("sliding_mean", "select key, pos, event_type, round(avg(value) over (partition by key order by pos, event_type, value rows between 3 preceding and 3 following), 6) as mean7 from {points}")
dual("window_ratio", "select key, pos, event_type, round(a / b, 6) as ratio from (select key, pos, event_type, avg(value) over (partition by key order by pos, event_type, value rows between 3 preceding and current row) as a, avg(value) over (partition by key order by pos, event_type, value rows between 1 following and 4 following) as b from {points}) x where b > 0.001")
dual("gap_runs", "select key, min(pos) as first_pos, max(pos) as last_pos, cast(count(*) as bigint) as n from (select key, pos, sum(case when p is null or pos - p > 86400 then 1 else 0 end) over (partition by key order by pos rows unbounded preceding) as g from (select key, pos, lag(pos) over (partition by key order by pos) as p from (select distinct key, pos from {points}) d) x) y group by key, g")
dual("local_extrema", f"select key, pos, value, case when value > p and value > n then 1 else -1 end as kind from (select key, pos, value, lag(value) over w as p, lead(value) over w as n from {{points}} {_W}) x where (value > p and value > n) or (value < p and value < n)")
dual("second_diff", f"select key, round(max(abs(p + n - 2 * value)), 6) as sharpest from (select key, value, lag(value) over w as p, lead(value) over w as n from {{points}} {_W}) x group by key")
dual("valleys", f"select key, cast(count(*) as bigint) as valleys from (select key, value, lag(value) over w as p, lead(value) over w as n from {{points}} {_W}) x where value <= p / 2 and value <= n / 2 group by key")
dual("factor_segments", "select key, cast(seg as bigint) as seg, min(pos) as first_pos, max(pos) as last_pos, cast(count(*) as bigint) as n, round(avg(value), 6) as mean from (select key, pos, value, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by key order by pos, event_type, value rows unbounded preceding) as seg from {points}) x group by key, seg")
dual("lag_periods", "select key, d // 3600 as hours, cast(count(*) as bigint) as n from (select key, pos - lag(pos) over (partition by key order by pos) as d from {points}) x where d is not null group by key, d // 3600")
dual("positional_windows", "select pos // 86400 as day, event_type, cast(count(*) as bigint) as n, round(sum(value), 4) as total from {points} group by pos // 86400, event_type")
dual("moments_quantiles", "select key, cast(count(*) as bigint) as n, round(avg(value), 6) as mean, round(var_pop(value), 6) as variance, min(value) as least, max(value) as most from {points} group by key")
dual("ks_uniform", "select key, round(max(greatest(abs(i / n - x), abs(x - (i - 1) / n))), 6) as ks from (select key, cast(row_number() over (partition by key order by pos) as double) as i, cast(count(*) over (partition by key) as double) as n, (pos - lo + 1) / cast(hi - lo + 1 as double) as x from (select key, pos, min(pos) over (partition by key) as lo, max(pos) over (partition by key) as hi from {points}) a) b group by key")
dual("chi2_uniform", "select key, round(sum((o - e) * (o - e) / e), 6) as chi2 from (select k.key, b.bin, coalesce(c.o, 0) as o, k.n / cast(8 as double) as e from (select key, count(*) as n from {points} group by key) k cross join (select 0 as bin union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7) b left join (select key, least(7, (pos - lo) * 8 // (hi - lo + 1)) as bin, count(*) as o from (select key, pos, min(pos) over (partition by key) as lo, max(pos) over (partition by key) as hi from {points}) x group by key, least(7, (pos - lo) * 8 // (hi - lo + 1))) c on c.key = k.key and c.bin = b.bin) y group by key")
_SPLIT = "select key, min(pos) as split_pos from (select *, row_number() over (partition by key order by round(SCORE, 6), pos) as rn from (select key, pos, cast(i as double) as i, cast(n as double) as n, s, q, ts, tq, cast(pos - lo as double) as dl, cast(hi - pos as double) as dr from (select key, pos, row_number() over w as i, count(*) over (partition by key) as n, sum(value) over w as s, sum(value * value) over w as q, sum(value) over (partition by key) as ts, sum(value * value) over (partition by key) as tq, min(pos) over (partition by key) as lo, max(pos) over (partition by key) as hi from {points} window w as (partition by key order by pos, event_type, value rows unbounded preceding)) x) y where i > 1 and i < n - 1 and dl > 0 and dr > 0) z where rn = 1 group by key"
dual("det_split", _SPLIT.replace("SCORE", "-1e12 * ((i / n) * (i / n) / dl + ((n - i) / n) * ((n - i) / n) / dr)"))
dual("regression_split", _SPLIT.replace("SCORE", "(q - s * s / i) + (tq - q - (ts - s) * (ts - s) / (n - i))"))
dual("kmeans_1d", "with p as (select value as x, 1 as m from {points}), a0 as (select min(x) as a, max(x) as b from p), a1 as (select avg(case when abs(x - a) <= abs(x - b) then x end) as a, avg(case when abs(x - a) > abs(x - b) then x end) as b from p cross join a0), a2 as (select avg(case when abs(x - a) <= abs(x - b) then x end) as a, avg(case when abs(x - a) > abs(x - b) then x end) as b from p cross join a1), a3 as (select avg(case when abs(x - a) <= abs(x - b) then x end) as a, avg(case when abs(x - a) > abs(x - b) then x end) as b from p cross join a2) select round(a, 6) as low, round(b, 6) as high from a3")
