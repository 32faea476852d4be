"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from weftline.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DIR}/{f}')")
    return con


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.execute(catalogue.SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert plain(tuple(r) for r in got.select(columns).collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_selection_has_no_conflict(spark):
    kept = catalogue.QUERIES["mwis_filter"](spark, DIR).toPandas().sort_values(["read_a", "read_b", "start_a"])
    same = (kept.read_a == kept.read_a.shift(-1)) & (kept.read_b == kept.read_b.shift(-1))
    assert (kept.end_a[same] < kept.start_a.shift(-1)[same]).all()


def test_intervals_edges(spark):
    from weftline.operators import intervals as ops

    none = spark.createDataFrame([], "read_id long, start_a int, end_a int")
    size = spark.createDataFrame([(1, 10)], "read_id long, length int")
    assert [tuple(r) for r in ops.gaps(none, size, "read_id").collect()] == [(1, 0, 9)]
    some = spark.createDataFrame([(1, 0, 2), (1, 3, 4), (1, 8, 9)], "read_id long, start_a int, end_a int")
    assert [tuple(r) for r in ops.gaps(some, size, "read_id").collect()] == [(1, 5, 7)]
    assert ops.surface(some, ["read_id"]).first()["covered"] == 7


def brute_weight(rows):
    """The largest sum of squared scores of intervals (start, end, diffs) that do not meet, over all subsets."""
    best = 0
    for mask in range(1 << len(rows)):
        some = sorted(r for i, r in enumerate(rows) if mask >> i & 1)
        if all(a[1] < b[0] for a, b in zip(some, some[1:])):
            best = max(best, sum((e - s + 1 - d) ** 2 for s, e, d in some))
    return best


def test_selection_has_the_largest_weight():
    import random

    from weftline.plans.graph_plans import select_without_conflict

    r = random.Random(1)
    for _ in range(200):
        rows = [(s := r.randint(0, 40), s + r.randint(1, 20), r.randint(0, 3)) for _ in range(r.randint(0, 9))]
        kept = select_without_conflict([(e, s, i, d) for i, (s, e, d) in enumerate(rows)])
        assert sum((e - s + 1 - d) ** 2 for e, s, _, d in kept) == brute_weight(rows)


def test_greedy_cover_brute(spark):
    import random

    from weftline.operators import graph

    r = random.Random(2)
    rows = sorted({(g, r.randint(0, 12), r.randint(0, 30)) for g in range(4) for _ in range(60)})
    got = graph.greedy_cover(spark.createDataFrame(rows, "grp long, item long, element long")).collect()
    want = set()
    for g in range(4):
        items = {}
        for _, i, e in (x for x in rows if x[0] == g):
            items.setdefault(i, set()).add(e)
        left, step = set().union(*items.values()), 0
        while left:
            i = min(items, key=lambda x: (-len(items[x] & left), x))
            step += 1
            want.add((g, i, step, len(items[i] & left)))
            left -= items[i]
    assert {tuple(x) for x in got} == want


def test_cut_vertices_brute(spark):
    import random

    from weftline.operators import graph

    r = random.Random(3)
    edges = sorted({tuple(sorted(r.sample(range(c * 20, c * 20 + 12), 2))) for c in range(5) for _ in range(13)})

    def parts(nodes):
        left, n = set(nodes), 0
        while left:
            line, n = [left.pop()], n + 1
            while line:
                x = line.pop()
                for a, b in edges:
                    for y in ((b,) if a == x else (a,) if b == x else ()):
                        if y in left:
                            left.discard(y)
                            line.append(y)
        return n

    nodes = {x for e in edges for x in e}
    want = {v for v in nodes if parts(nodes - {v}) > parts(nodes) - (not any(v in e for e in edges))}
    assert {x["node"] for x in graph.cut_vertices(spark.createDataFrame(edges, "src long, dst long")).collect()} == want


def test_significant_tokens_with_a_very_frequent_one(spark, tmp_path):
    """Sums of the distribution end where it does, not at the most frequent token's number."""
    texts = [" ".join(["common"] * 400 + [f"w{chr(97 + i % 26)}{chr(97 + (i * j) % 26)}" for j in range(12)]) for i in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = catalogue.QUERIES["significant_tokens"](spark, str(tmp_path))
    assert plain(tuple(r) for r in got.collect()) == plain(con.execute(catalogue.SQL["significant_tokens"]).fetchall())
    con.execute("create table t as select unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) as tok from documents")
    most = con.execute("select max(n) from (select count(*) as n from t group by tok)").fetchall()[0][0]
    metrics, todo = [], [got._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName() == "Generate" and "sequence" in node.toString().split("\n")[0]:
            metrics.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert most == 120_000 and metrics and max(metrics) < most // 4
