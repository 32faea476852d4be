"""Graph operators as joins: components by falling labels, with tables in the checkpoint folder between rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checkpoint(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="weftline-"))
    return df.checkpoint()


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component): the least node that each is connected with. Labels fall to the least around, then to that
    label's own label, so a round more than halves the way to go."""
    both = _checkpoint(edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).unionAll(edges.select(F.col("dst").alias("node"), F.col("src").alias("near"))))
    labels = both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("component"))
    for _ in range(most_rounds):
        labels = _checkpoint(labels)
        around = both.join(labels.select(F.col("node").alias("near"), F.col("component").alias("c")), "near").groupBy("node").agg(F.min("c").alias("c"))
        fallen = _checkpoint(labels.join(around, "node").select("node", F.least("component", "c").alias("component"), (F.col("c") < F.col("component")).alias("moved")))
        if fallen.where("moved").isEmpty():
            return fallen.select("node", "component")
        jump = fallen.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = fallen.drop("moved").join(jump, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    raise RuntimeError("components did not settle")


def greedy_cover(items: DataFrame, share: float = 1.0, connected: bool = False, most_rounds: int = 100_000) -> DataFrame:
    """(grp, item, round, gain) from distinct rows (grp, item, element): in each round each group takes the item with most
    elements that no earlier one has, the least item of equals, until `share` of its elements are covered. connected: from
    the second round on, only items that are elements covered so far can be taken. All groups go at once; groups leave when
    they are done, so there are as many rounds as the longest cover has items."""
    sizes = items.groupBy("grp").agg(F.countDistinct("element").alias("size"))
    left = _checkpoint(items.join(sizes, "grp"))
    open_items = None
    taken, spark = [], items.sparkSession
    for i in range(1, most_rounds + 1):
        choice = left if open_items is None else left.join(open_items, ["grp", "item"], "left_semi")
        gains = choice.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("gain"))
        best = gains.groupBy("grp").agg(F.max_by(F.struct("item", "gain"), F.struct("gain", -F.col("item"))).alias("x"))
        best = _checkpoint(best.select("grp", "x.item", F.lit(i).alias("round"), "x.gain"))
        if best.isEmpty():
            break
        taken.append(best)
        done = left.join(best.select("grp", "item"), ["grp", "item"], "left_semi").select("grp", "element")
        if connected:
            fresh = done.withColumnRenamed("element", "item")
            open_items = _checkpoint((fresh if open_items is None else open_items.unionAll(fresh)).distinct())
        rest = left.join(done, ["grp", "element"], "left_anti")
        # a group with few elements left is done
        unfinished = rest.groupBy("grp", "size").agg(F.countDistinct("element").alias("n")).where(F.col("n") > (1 - share) * F.col("size") + 1e-9).select("grp")
        left = _checkpoint(rest.join(unfinished, "grp", "left_semi").select("grp", "item", "element", "size"))
        if left.isEmpty():
            break
    out = taken[0] if taken else spark.createDataFrame([], "grp long, item long, round int, gain long")
    for more in taken[1:]:
        out = out.unionAll(more)
    return out


def cut_vertices(edges: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """(node): nodes whose removal parts their component. From one neighbour of each node with several, what can be reached
    without it grows by one step a round; a neighbour that is never met lies in another part. The tables hold up to the
    sum of nodes times the size of their components, so this is for graphs of many components, not for one of all nodes."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(edges.select("dst", "src")).where("a <> b").distinct()
    both = _checkpoint(both)
    beside = both.groupBy("a").agg(F.min("b").alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1")
    reached = _checkpoint(beside.select(F.col("a").alias("cut"), "x"))
    front = reached
    for _ in range(most_rounds):
        step = front.join(both.select(F.col("a").alias("x"), F.col("b").alias("y")), "x").where("y <> cut").select("cut", F.col("y").alias("x")).distinct()
        front = _checkpoint(step.join(reached, ["cut", "x"], "left_anti"))
        if front.isEmpty():
            break
        reached = _checkpoint(reached.unionAll(front))
    missed = both.select(F.col("a").alias("cut"), F.col("b").alias("x")).join(beside.select(F.col("a").alias("cut")), "cut", "left_semi").join(reached, ["cut", "x"], "left_anti")
    return missed.select(F.col("cut").alias("node")).distinct()


def core(edges: DataFrame, least: int, most_rounds: int = 200) -> DataFrame:
    """Edges (src, dst) among nodes that have at least `least` of them, when nodes with fewer are taken away until none is."""
    left = _checkpoint(edges)
    for _ in range(most_rounds):
        ends = left.select(F.col("src").alias("node")).unionAll(left.select("dst"))
        weak = _checkpoint(ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select("node"))
        if weak.isEmpty():
            return left
        left = left.join(weak.withColumnRenamed("node", "src"), "src", "left_anti").join(weak.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = _checkpoint(left.select("src", "dst"))
    raise RuntimeError("the core did not settle")
