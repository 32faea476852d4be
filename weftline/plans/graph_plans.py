"""Graph queries over the edge and path views."""

from __future__ import annotations

import bisect

from pyspark.sql import functions as F

from weftline.operators import graph as ops
from weftline.sources.views import view

from .registry import dual, query

_BOTH = "(select src as a, dst as b from {edges} union all select dst, src from {edges})"
dual("graph_degree", f"select a as node, cast(count(*) as bigint) as degree from {_BOTH} x group by a")
dual("graph_tips", f"select degree, cast(count(*) as bigint) as nodes from (select a, count(*) as degree from {_BOTH} x group by a) y group by degree")


@query(f"with e as {_BOTH}, r(node, near) as (select a, b from e union select r.node, e.b from r join e on r.near = e.a) select node, least(node, min(near)) as component from r group by node")
def components(spark, d):
    return ops.components(view(spark, d, "edges"))


@query(f"with e as {_BOTH}, r(node, near) as (select a, b from e union select r.node, e.b from r join e on r.near = e.a) select size, cast(count(*) as bigint) as components from (select component, count(*) as size from (select node, least(node, min(near)) as component from r group by node) x group by component) y group by size")
def component_sizes(spark, d):
    sizes = ops.components(view(spark, d, "edges")).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("components"))


dual("two_hop_reduction", "select e.src, e.dst from {dag} e where not exists (select 1 from {dag} f join {dag} g on f.dst = g.src where f.src = e.src and g.dst = e.dst)")
def paths_sql() -> str:
    steps = ["p1 as (select src as s, dst as t, cast(1 as bigint) as n from {dag})"]
    steps += [f"p{i} as (select p.s, d.dst as t, cast(sum(p.n) as bigint) as n from p{i - 1} p join {{dag}} d on p.t = d.src group by p.s, d.dst)" for i in range(2, 10)]
    return "with " + ", ".join(steps) + " select s, t, cast(sum(n) as bigint) as paths, max(len) as longest from (" + " union all ".join(f"select s, t, n, {i} as len from p{i}" for i in range(1, 10)) + ") x group by s, t"


dual("dag_paths", paths_sql())
dual("dag_sources_sinks", "select cast(sum(case when i = 0 then 1 else 0 end) as bigint) as sources, cast(sum(case when o = 0 then 1 else 0 end) as bigint) as sinks, cast(count(*) as bigint) as nodes from (select node, sum(i) as i, sum(o) as o from (select src as node, 0 as i, 1 as o from {dag} union all select dst, 1, 0 from {dag}) x group by node) y")
dual("conflicts", "select a.read_a, a.read_b, cast(count(*) as bigint) as conflicts from {alignments} a join {alignments} b on a.read_a = b.read_a and a.read_b = b.read_b and a.start_a <= b.end_a and b.start_a <= a.end_a and (a.aln_id < b.aln_id or (a.aln_id = b.aln_id and a.start_a < b.start_a)) group by a.read_a, a.read_b")


def select_without_conflict(rows: list[tuple]) -> list[tuple]:
    """Best set of intervals (end, start, id, diffs, ...) that do not meet, by squared score: weighted interval scheduling."""
    rows = sorted(rows)
    ends, best, take = [r[0] for r in rows], [0], []
    for i, (e, s, _, d, *_) in enumerate(rows):
        j, w = bisect.bisect_left(ends, s, 0, i), (e - s + 1 - d) ** 2
        take.append((best[j] + w > best[i], j))
        best.append(max(best[i], best[j] + w))
    kept, i = [], len(take)
    while i:
        use, j = take[i - 1]
        if use:
            kept.append(rows[i - 1])
        i = j if use else i - 1
    return kept


def _of_read(frame):
    """All pairs of one read A; a read has few alignments with each other read."""
    import pandas as pd

    out, groups = [], {}
    for b, *row in frame[["read_b", "end_a", "start_a", "aln_id", "diffs", "start_b"]].itertuples(index=False, name=None):
        groups.setdefault(b, []).append(tuple(row))
    for b, rows in groups.items():
        out += [(b, i, s, e, d) for e, s, i, d, _ in select_without_conflict(rows)]
    kept = pd.DataFrame(out, columns=["read_b", "aln_id", "start_a", "end_a", "diffs"])
    kept.insert(0, "read_a", frame["read_a"].iloc[0])
    return kept


@query()
def mwis_filter(spark, d):
    """Alignments of each pair of reads that do not meet on A and have the largest sum of squared scores."""
    a = view(spark, d, "alignments").select("read_a", "read_b", "aln_id", "start_a", "end_a", "start_b", "diffs")
    return a.groupBy("read_a").applyInPandas(_of_read, "read_a long, read_b long, aln_id long, start_a int, end_a int, diffs int")
