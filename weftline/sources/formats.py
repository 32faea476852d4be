"""Readers, writers and codecs of text formats for alignments, sequences, tracks and qualities, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"([0-9,]+)"
#: A B n [s.. e] x [s.. e] ( d diffs ..., with commas in numbers and optional brackets of either kind.
_SHOWN = rf"^\s*{_NUMBER}\s+{_NUMBER}\s+([nc])\s+[\[<]\s*{_NUMBER}\.\.\s*{_NUMBER}[\]>]\s*x\s*[\[<]\s*{_NUMBER}\.\.\s*{_NUMBER}[\]>].*?{_NUMBER}\s+diffs"


def _int(line: Column, pattern: str, group: int) -> Column:
    return F.regexp_replace(F.regexp_extract(line, pattern, group), ",", "").cast("int")


def shown_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignment listing -> read_a, read_b, fwd, closed 0-based intervals and diffs. Lines that are not alignments are left out."""
    line = F.col("value")
    rows = spark.read.text(path).where(line.rlike(_SHOWN))
    n = lambda g: _int(line, _SHOWN, g)
    return rows.select((n(1) - 1).alias("read_a"), (n(2) - 1).alias("read_b"), (F.regexp_extract(line, _SHOWN, 3) == "n").alias("fwd"), n(4).alias("start_a"), (n(5) - 1).alias("end_a"), n(6).alias("start_b"), (n(7) - 1).alias("end_b"), n(8).alias("diffs"))


def show_alignments(df: DataFrame) -> DataFrame:
    """The lines (value) that shown_alignments reads."""
    return df.select(F.format_string("%d %d %s [%d..%d] x [%d..%d] ( %d diffs)", F.col("read_a") + 1, F.col("read_b") + 1, F.when(F.col("fwd"), "n").otherwise("c"), "start_a", F.col("end_a") + 1, "start_b", F.col("end_b") + 1, "diffs").alias("value"))


def paf(spark: SparkSession, path: str) -> DataFrame:
    """PAF -> names, lengths and closed intervals; diffs are the block's length less the matches."""
    p = F.split("value", "\t")
    n = lambda i: p[i].cast("int")
    rows = spark.read.text(path).where(F.size(p) >= 11)
    return rows.select(p[0].alias("query"), n(1).alias("query_length"), n(2).alias("start_a"), (n(3) - 1).alias("end_a"), (p[4] == "+").alias("fwd"), p[5].alias("target"), n(6).alias("target_length"), n(7).alias("start_b"), (n(8) - 1).alias("end_b"), (n(10) - n(9)).alias("diffs"))


def numbered(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, id): ids from 0 in order of name. The sort's own ranges, from sampled bounds, are written down and counted, so
    names with one beginning do not meet in one task."""
    from pyspark.sql import Window as W

    from weftline.operators.graph import _checkpoint

    ordered = names.select(name).distinct().orderBy(name)
    part = _checkpoint(ordered.select(name, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    ranges = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_low"))
    ranges = ranges.withColumn("_first", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return part.join(ranges, "_p").select(name, (F.col("_first") + F.col("_m") - F.col("_low")).cast("long").alias("id"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA -> name, sequence, length; records are split by the reader, so one record is one row."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select(F.regexp_extract("value", r"^(\S*)", 1).alias("name"), body.alias("sequence"), F.length(body).alias("length"))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "acgtACGT", "tgcaTGCA"))


def track(spark: SparkSession, path: str) -> DataFrame:
    """One line for each read of start,end pairs -> line, start, end."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.expr("filter(split(value, '[ ,]+'), x -> x <> '')").alias("n"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("n") - 2, F.lit(2)), lambda i: F.struct(F.get("n", i).cast("int").alias("start"), F.get("n", i + 1).cast("int").alias("end")))
    return lines.where(F.size("n") >= 2).select("file", "line", F.explode(pairs).alias("p")).select("file", "line", "p.start", "p.end")


def quality_score(symbol: Column) -> Column:
    """a to z are 1 to 26, A to Y are 27 to 51; any other symbol counts from the exclamation mark."""
    c = F.ascii(symbol)
    return F.when(c.between(97, 122), c - 96).when(c.between(65, 89), c - 38).otherwise(c - 33)


def quality_symbol(score: Column) -> Column:
    return F.when(score <= 26, F.char(score + 96)).otherwise(F.char(score + 38))


def low_quality(scores: Column, random_from: int = 25) -> Column:
    """Half the scores, or their mean, reach the random threshold."""
    n = F.size(scores)
    return (2 * F.size(F.filter(scores, lambda x: x >= random_from)) >= n) | (F.aggregate(scores, F.lit(0), lambda a, x: a + x.cast("int")) >= n * random_from)


def fasta_lines(df: DataFrame, width: int = 100) -> DataFrame:
    """The records (value) of rows (name, sequence): a header and lines of at most `width` characters."""
    return df.select(F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace("sequence", rf"(.{{{width}}})(?=.)", "$1\n")).alias("value"))


def dumped_reads(spark: SparkSession, path: str) -> DataFrame:
    """Database dump of `R` (1-based number), `H` (name) and `L` (well, start, end) lines -> read_id from 0, length.
    Each line belongs to the last R line before it, within one file."""
    from pyspark.sql import Window as W

    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    p = F.split(F.trim("line"), " +")
    rows = lines.where(F.substring("line", 1, 1).isin("R", "L")).select("file", "at", F.substring("line", 1, 1).alias("kind"), p.alias("p"))
    last = F.last(F.when(F.col("kind") == "R", F.col("p")[1].cast("long") - 1), True).over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    n = lambda i: F.get("p", F.lit(i)).cast("int")
    return rows.select("kind", "p", last.alias("read_id")).where("kind = 'L' and read_id is not null").select("read_id", (n(3) - n(2)).alias("length"))


def translation(spark: SparkSession, path: str) -> DataFrame:
    """Translated reads -> file, line, block, character: blocks lie between colons, their characters between commas."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value").where(F.length("value") > 0)
    blocks = lines.select("file", "line", F.posexplode(F.split("value", ":")).alias("block", "b"))
    return blocks.select("file", "line", "block", F.explode(F.split("b", ",")).alias("c")).select("file", "line", "block", F.col("c").cast("int").alias("character"))


def translation_lines(df: DataFrame) -> DataFrame:
    """(read_id, value): the lines that `translation` reads, of rows (read_id, block, character)."""
    blocks = df.groupBy("read_id", "block").agg(F.array_join(F.array_sort(F.collect_list("character")).cast("array<string>"), ",").alias("b"))
    inside = F.array_sort(F.collect_list(F.struct("block", "b")))
    return blocks.groupBy("read_id").agg(F.array_join(F.transform(inside, lambda x: x["b"]), ":").alias("value"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def dot(edges: DataFrame) -> DataFrame:
    """The lines (value) of the links of an undirected drawing, each once."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.select(F.format_string("%d -- %d;", a, b).alias("value")).distinct()
