"""How queries are registered: `query` for a function with its SQL, `dual` for SQL that both engines run (// divides whole numbers)."""

from __future__ import annotations

from weftline.sources import views

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = views.oracle(sql)
        return f

    return add


def dual(name: str, sql: str, spark_sql: str | None = None) -> None:
    text = (spark_sql or sql).replace("//", "div")
    QUERIES[name] = lambda spark, sf_dir: views.run(spark, sf_dir, text)
    SQL[name] = views.oracle(sql)


def binned(sql: str, left: str, right: str, size: int = 64) -> str:
    """Spark's form of a join of two views' closed intervals that meet: by bins of positions, each pair in the first bin that
    both touch, so that one read's rows are not all compared with each other. left and right are '{view} alias'."""
    one = lambda x: f"(select *, explode(sequence(start_a // {size}, end_a // {size})) as bin from {x.split()[0]}) {x.split()[1]}"
    a, b = left.split()[1], right.split()[1]
    before, after = f"{left} join {right} on ", f"{one(left)} join {one(right)} on {a}.bin = {b}.bin and {a}.bin = greatest({a}.start_a, {b}.start_a) // {size} and "
    if before not in sql:
        raise ValueError(f"no join of {left} and {right}")
    return sql.replace(before, after)
