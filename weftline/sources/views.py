"""Views over the star-schema tables that stand for alignments, reads, tokens, characters, intervals, points and graphs.

SPARK and DUCK hold each view's SQL; {name} refers to another view or table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "documents", "events", "part", "labels", "orders")

_V1 = """select l_orderkey*10 + l_linenumber as aln_id, l_partkey as read_a, l_suppkey as read_b, l_returnflag = 'N' as fwd,
 DAYS as start_a, DAYS + cast(l_quantity as int) as end_a, cast(l_orderkey % 1000 as int) as start_b,
 cast(l_orderkey % 1000 as int) + cast(l_quantity as int) + l_linenumber as end_b, cast(round(l_discount*100) as int) as diffs from {lineitem}"""
_ORDER = "start_a, end_a, read_b, aln_id, start_b, diffs"
_COMMON = {
    "reads": "select read_a as read_id, cast(max(end_a)+50 as int) as length from {alignments} group by read_a",
    "alphabet": """select cast(row_number() over (order by case when start_p=-1 then 0 else 1 end, repeat, case when fwd then 0 else 1 end, start_p, end_p, length,
 case when open_start then 0 else 1 end, case when open_end then 0 else 1 end)-1 as int) as char_id, t.* from (select distinct l_suppkey as repeat, l_returnflag='N' as fwd,
 case when l_suppkey % 5 = 0 then -1 else cast(((l_orderkey % 1000)+50) // 100 * 100 as int) end as start_p,
 case when l_suppkey % 5 = 0 then -1 else cast(((l_orderkey % 1000)+cast(l_quantity as int)*10+50) // 100 * 100 as int) end as end_p,
 case when l_suppkey % 5 = 0 then cast((cast(l_quantity as int)*10+50) // 100 * 100 as int) else 0 end as length,
 l_linestatus='O' as open_start, l_linenumber % 2 = 0 as open_end from {lineitem}) t""",
    "intervals": f"""select read_a, fwd, min(start_a) as start_a, max(end_a) as end_a from (select *, sum(case when m is null or start_a > m + 1 then 1 else 0 end)
 over (partition by read_a, fwd order by {_ORDER} rows unbounded preceding) as grp from (select *, max(end_a) over (partition by read_a, fwd order by {_ORDER}
 rows between unbounded preceding and 1 preceding) as m from {{alignments}}) x) y group by read_a, fwd, grp""",
    "edges": "select read_a as src, read_b + 1000000 as dst, cast(count(*) as bigint) as n from {alignments} where diffs = 0 and end_a - start_a >= 49 group by read_a, read_b",
    "dag": f"""select distinct read_b as src, nxt as dst from (select read_b, lead(read_b) over (partition by read_a order by {_ORDER}) as nxt from {{alignments}}) x
 where nxt > read_b and nxt - read_b <= 3 and read_b // 10 = nxt // 10""",
}
SPARK = {k: v.replace("//", "div") for k, v in _COMMON.items()} | {
    "alignments": _V1.replace("DAYS", "datediff(l_shipdate, timestamp'1995-01-01 00:00:00')"),
    "tokens": "select doc_id as read_id, split(trim(regexp_replace(lower(text), '[^a-z]+', ' ')), ' ') as toks from {documents}",
    "points": "select user_id as key, cast(unix_timestamp(ts) - 1704067200 as bigint) as pos, event_type, value from {events}",
}
# characters are numbered within sections and repeats, whose sizes are added up: no task sees all of them
_CHARS = _COMMON["alphabet"].replace("//", "div")
_CHARS = _CHARS[_CHARS.index("(select distinct") : _CHARS.rindex(")") + 1]
SPARK["alphabet"] = f"""select cast(o.before + row_number() over (partition by t.section, t.repeat order by case when t.fwd then 0 else 1 end, start_p, end_p, length, case when open_start then 0 else 1 end, case when open_end then 0 else 1 end) - 1 as int) as char_id,
 t.repeat, t.fwd, start_p, end_p, length, open_start, open_end from (select *, case when start_p = -1 then 0 else 1 end as section from {_CHARS} c) t
 join (select section, repeat, coalesce(sum(n) over (order by section, repeat rows between unbounded preceding and 1 preceding), 0) as before from (select case when start_p = -1 then 0 else 1 end as section, repeat, count(*) as n from {_CHARS} c group by 1, 2) s) o on o.section = t.section and o.repeat = t.repeat"""
DUCK = _COMMON | {
    "alignments": _V1.replace("DAYS", "cast(date_diff('day', timestamp'1995-01-01 00:00:00', l_shipdate) as int)"),
    "tokens": "select doc_id as read_id, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') as toks from {documents}",
    "points": "select user_id as key, cast(floor(epoch(ts)) - 1704067200 as bigint) as pos, event_type, value from {events}",
}


def names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name not in SPARK:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run(spark, sf_dir, SPARK[name])


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in names(sql)})


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it needs in front."""
    needed: dict[str, str] = {}

    def need(text: str) -> None:
        for n in names(text):
            if n in DUCK and n not in needed:
                need(DUCK[n])
                needed[n] = re.sub(r"\{(\w+)\}", r"\1", DUCK[n])

    need(sql)
    body = re.sub(r"\{(\w+)\}", r"\1", sql)
    if not needed:
        return body
    front = ", ".join(f"{n} as ({q})" for n, q in needed.items())
    return f"with recursive {front}, {body[5:]}" if body.lower().startswith("with ") else f"with recursive {front} {body}"
