"""Readers and writers of interval tables, connections, alphabets, side tables, spacers, trees and periods as text.

A layout is a list of (column, type, separator after it); the last separator ends the line. Fields are split at every
separator, so the reader needs no more than the order of columns. Booleans are 0 and 1. Typed Parquet of the same columns
is the better form for large tables; these are for exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _layout(text: str) -> list[tuple[str, str, str]]:
    out = []
    for word in text.split():
        name, kind, sep = word.split(":")
        out.append((name, {"i": "int", "b": "boolean", "d": "double"}[kind], {"c": ",", "p": "|", "e": ""}[sep]))
    return out


_TAIL = "assigned:i:c coverage:d:e"
#: The formats' columns in order (i whole number, b 0 or 1, d decimal; c comma, p bar, e end of line).
LAYOUTS = {
    "alignment": _layout("read_a:i:c id:i:c start:i:c end:i:c is_long:b:c left_maximal:b:c right_maximal:b:c contained:i:p " + _TAIL),
    "dense": _layout(
        "read_a:i:c id:i:p weak:b:p start:i:c end:i:p prefix:b:c prefix_length:i:c suffix:b:c suffix_length:i:c substring:b:c period:i:c strong_period:b:p prefix_biased:b:c prefix_bias_from:i:c"
        " prefix_bias_to:i:c suffix_biased:b:c suffix_bias_from:i:c suffix_bias_to:i:p single_deletion:b:c deletions:i:c shortest_deletion:i:c longest_deletion:i:p left_maximal:b:c right_maximal:b:c"
        " contained:i:c least_prefix:i:c least_suffix:i:p first_maximal_start:i:c last_maximal_end:i:p " + _TAIL
    ),
    "periodic": _layout("read_a:i:c id:i:p start:i:c end:i:c period:i:p left_maximal:b:c right_maximal:b:c contained:i:c long_period:b:c one_period:b:p " + _TAIL),
    "factor": _layout("read_a:i:c start:i:c end:i:p maximal:b:p period:i:p " + " ".join(f"coverage{i}:i:c identity{i}:i:{'p' if i == 5 else 'c'}" for i in range(6)) + " periodic_coverage:i:c periodic_identity:i:p"
                      " palindrome0:i:c palindrome1:i:c palindrome2:i:c palindrome3:i:c palindrome4:i:p self_similar:b:p variants:i:e"),
    "spacer": _layout("read:i:c first:i:c last:i:c breakpoint:i:c rigid_left:b:c rigid_right:b:e"),
}


def _typed(value: Column, kind: str) -> Column:
    return (F.trim(value) == "1") if kind == "boolean" else F.trim(value).cast(kind)


def _shown(name: str, kind: str) -> Column:
    c = F.col(name)
    return F.when(c, "1").otherwise("0") if kind == "boolean" else c.cast("string")


def read_table(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """The rows of a layout; lines with too few fields are left out."""
    columns = LAYOUTS[layout]
    p = F.split("value", "[,|]")
    rows = spark.read.text(path).where(F.size(p) >= len(columns))
    return rows.select(*(_typed(p[i], kind).alias(name) for i, (name, kind, _) in enumerate(columns)))


def table_lines(df: DataFrame, layout: str) -> DataFrame:
    """The lines (value) that read_table reads, in order of read and place within the files that one writes."""
    parts = [x for name, kind, sep in LAYOUTS[layout] for x in (F.coalesce(_shown(name, kind), F.lit("-1")), F.lit(sep))]
    keys = [c for c in ("read_a", "read", "start", "first", "id") if c in df.columns]
    return df.sortWithinPartitions(*keys).select(F.concat(*parts).alias("value"))


def count_table(spark: SparkSession, path: str) -> DataFrame:
    """(read_a, n): lines of each read, without the rest of them."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\d+)\s*[,|]", 1).alias("r")).where("r <> ''").groupBy(F.col("r").cast("int").alias("read_a")).agg(F.count(F.lit(1)).alias("n"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) with lines from 0: files are read whole, since a line's number is its key."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("line", "value"))


#: Fields of a connection after the nine that all kinds have (fixed values), by kind: periodic 6, dense 1 to 5, alignment 0.
_MORE = {6: ("period", "long_period"), 1: ("least_prefix", "least_suffix", "first_maximal_start", "last_maximal_end"), 0: ()}
_COMMON = ("kind", "id", "start", "end", "weak", "implied", "left_maximal", "right_maximal", "contained")


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, connection): what each alignment is assigned to; the struct is null where the line is blank."""
    rows = numbered_lines(spark, path).withColumn("p", F.split("value", ","))
    kind, n = F.col("p")[0].cast("int"), F.size("p")
    at = lambda i: F.get("p", F.lit(i))
    own = {}
    for k, names in _MORE.items():
        for i, name in enumerate(names):
            own[name] = F.when((kind == 6) if k == 6 else (kind.between(1, 5) if k else kind == 0), at(len(_COMMON) + i).cast("int"))
    fields = [at(i).cast("int").alias(name) for i, name in enumerate(_COMMON)] + [c.alias(name) for name, c in own.items()]
    fields += [F.element_at("p", n - 1).cast("int").alias("assigned"), F.element_at("p", n).cast("double").alias("coverage")]
    return rows.select("file", "line", F.when(F.trim("value") != "", F.struct(*fields)).alias("connection"))


def connection_lines(df: DataFrame) -> DataFrame:
    """(line, value) of rows (line, connection)."""
    c = F.col("connection")
    some = lambda names: [c[n].cast("string") for n in names]
    whole = lambda names: F.concat_ws(",", *some([*_COMMON, *names, "assigned"]), c["coverage"].cast("string"))
    value = F.when(c["kind"] == 6, whole(_MORE[6])).when(c["kind"].between(1, 5), whole(_MORE[1])).otherwise(whole(()))
    return df.select("line", F.when(c.isNull(), "").otherwise(value).alias("value"))


ALPHABET = ("repeat", "fwd", "start_p", "end_p", "length", "open_start", "open_end")


def alphabet_order() -> list[Column]:
    """Unique characters (repeat -1) first, then periodic ones (start -1), then the rest; forward and open ones before others."""
    return [F.col("repeat") != -1, F.col("start_p") != -1, "repeat", ~F.col("fwd"), "start_p", "end_p", "length", ~F.col("open_start"), ~F.col("open_end")]


def alphabet_header(chars: DataFrame) -> DataFrame:
    """(last_unique, last_periodic, last_alphabet, longest_open) of characters; sizes count from -1 for none."""
    unique, periodic = F.col("repeat") == -1, (F.col("repeat") != -1) & (F.col("start_p") == -1)
    return chars.agg(
        (F.count_if(unique) - 1).alias("last_unique"), (F.count_if(unique | periodic) - 1).alias("last_periodic"), (F.count(F.lit(1)) - 1).alias("last_alphabet"),
        F.coalesce(F.max(F.when(unique & (F.col("open_start") | F.col("open_end")), F.col("length"))), F.lit(-1)).alias("longest_open"),
    )


def merge_headers(headers: DataFrame) -> DataFrame:
    """One header of several parts: sizes of sections add up, the longest open length is the greatest."""
    section = lambda c: (F.sum(F.col(c) + 1) - 1).alias(c)
    return headers.agg(section("last_unique"), section("last_periodic"), section("last_alphabet"), F.max("longest_open").alias("longest_open"))


def read_alphabet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header and characters (char_id, flags, repeat, ...) of one file: flags are 1 for forward, open start, open end."""
    lines = numbered_lines(spark, path)
    h, p = F.split("value", ","), F.split("value", ",")
    header = lines.where("line = 0").select(*(F.trim(h[i]).cast("int").alias(n) for i, n in enumerate(("last_unique", "last_periodic", "last_alphabet", "longest_open"))))
    n = lambda i: F.trim(p[i]).cast("int")
    chars = lines.where("line > 0 and value <> ''").select((F.col("line") - 1).alias("char_id"), n(0).alias("repeat"), (n(1) == 1).alias("fwd"), n(2).alias("start_p"), n(3).alias("end_p"), n(4).alias("length"), (n(5) == 1).alias("open_start"), (n(6) == 1).alias("open_end"))
    return header, chars


def alphabet_lines(chars: DataFrame) -> DataFrame:
    """(line, value): the header, then the characters in order. One file: an alphabet is a dictionary, small beside reads."""
    head = alphabet_header(chars).select(F.lit(0).alias("line"), F.concat_ws(",", "last_unique", "last_periodic", "last_alphabet", "longest_open").alias("value"))
    flag = lambda c: F.col(c).cast("int")
    body = chars.withColumn("line", F.row_number().over(W.orderBy(*alphabet_order()))).select("line", F.concat_ws(",", "repeat", flag("fwd"), "start_p", "end_p", "length", flag("open_start"), flag("open_end")).alias("value"))
    return head.unionAll(body).orderBy("line")


def _numbers(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, "[, ]+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def unique_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Lines of triples -> (read, position, length, haplotypes); a read's line may be empty."""
    lines = numbered_lines(spark, path).select(F.col("line").alias("read"), _numbers(F.col("value")).alias("n")).where(F.size("n") >= 3)
    triples = F.transform(F.sequence(F.lit(0), F.size("n") - 3, F.lit(3)), lambda i: F.struct(F.get("n", i).alias("position"), F.get("n", i + 1).alias("length"), F.get("n", i + 2).alias("haplotypes")))
    return lines.select("read", F.explode(triples).alias("t")).select("read", "t.*")


def tandem_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Lines of pairs -> (read, first, last) blocks."""
    lines = numbered_lines(spark, path).select(F.col("line").alias("read"), _numbers(F.col("value")).alias("n")).where(F.size("n") >= 2)
    pairs = F.transform(F.sequence(F.lit(0), F.size("n") - 2, F.lit(2)), lambda i: F.struct(F.get("n", i).alias("first"), F.get("n", i + 1).alias("last")))
    return lines.select("read", F.explode(pairs).alias("t")).select("read", "t.*")


def id_list(spark: SparkSession, path: str, name: str = "read") -> DataFrame:
    """One number a line; to be joined as a semi or anti join."""
    return spark.read.text(path).select(F.trim("value").try_cast("int").alias(name)).where(F.col(name).isNotNull()).distinct()


def quality_track(spark: SparkSession, path: str) -> DataFrame:
    """One string of symbols a read -> (read, scores)."""
    from .formats import quality_score

    return numbered_lines(spark, path).where("value <> ''").select(F.col("line").alias("read"), F.transform(F.split("value", ""), quality_score).alias("scores"))


def track_lines(df: DataFrame) -> DataFrame:
    """(read, value): start,end pairs of each read in order, as formats.track reads them."""
    pair = lambda x: F.concat_ws(",", x["start"].cast("string"), x["end"].cast("string"))
    return df.groupBy("read").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), pair), " ").alias("value"))


def write_tracks(tracks: dict[str, DataFrame], path: str) -> None:
    """Several tracks (read, start, end) as one typed table, partitioned by name."""
    every = None
    for name, df in tracks.items():
        one = df.select(F.lit(name).alias("track"), "read", "start", "end")
        every = one if every is None else every.unionAll(one)
    every.write.mode("overwrite").partitionBy("track").parquet(path)


def read_tracks(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """(track, read, start, end); with names, only their folders are read."""
    df = spark.read.parquet(path)
    return df.where(F.col("track").isin(*names)) if names else df


def repeat_alignments(paf: DataFrame, names: DataFrame) -> DataFrame:
    """Alignments (formats.paf) whose target is a repeat of names (name, id) -> repeat, query, intervals; the repeat is read A."""
    return paf.join(names.select(F.col("name").alias("target"), F.col("id").alias("repeat")), "target").select(
        "repeat", "query", "fwd", F.col("start_b").alias("start_a"), F.col("end_b").alias("end_a"), F.col("start_a").alias("start_b"), F.col("end_a").alias("end_b"), "diffs", F.col("target_length").alias("length_a")
    )


def fan_out(fasta: DataFrame, groups: DataFrame, path: str) -> None:
    """Sequences (name, sequence) of groups (name, group) as FASTA text, a folder for each group."""
    rows = fasta.join(groups, "name").select("group", F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value"))
    rows.write.mode("overwrite").partitionBy("group").text(path)


def taxonomy(spark: SparkSession, path: str, deepest: int = 12) -> DataFrame:
    """Options of a drop-down list -> (line, label, depth, parent): a label's depth is the number of semicolons before it,
    and its parent the last line above with less depth (-1 for none). The list is one small file."""
    text = F.regexp_extract("value", r">([^<]*)<", 1)
    label = F.regexp_replace(F.lower(F.trim(F.regexp_extract(text, r"([^;]*)$", 1))), " ", "-")
    rows = numbered_lines(spark, path).where(text != "").select("line", label.alias("label"), (F.length(text) - F.length(F.replace(text, F.lit(";")))).alias("depth"))
    above = W.orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    last = [F.when(F.col("depth") > d, F.max(F.when(F.col("depth") == d, F.col("line"))).over(above)) for d in range(deepest)]
    return rows.select("line", "label", "depth", F.coalesce(F.greatest(*last), F.lit(-1)).alias("parent"))


def periods(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct known periods of files with a number first or in a tab-separated column; lines of # are notes."""
    words = spark.read.text(list(paths)).where(~F.col("value").startswith("#")).select(F.explode(F.split("value", "[\t,;/ ]+")).alias("w"))
    return words.where(F.col("w").rlike(r"^\d{1,6}$")).select(F.col("w").cast("int").alias("period")).where("period > 0").distinct()


#: Ranges of periods of known repeats: micro-, mini- and satellites, nucleosomes without and with a linker,
#: telomeres, and boxes.
KNOWN = ((2, 6), (10, 60), (150, 180), (146, 146), (156, 226), (6, 6), (17, 17))


def is_known_period(p: Column, ranges=KNOWN) -> Column:
    """Whether p lies between a low and a high bound times the same whole number, for some range: the least number that
    brings the high bound up to p has to keep the low one at most p."""
    out = F.lit(False)
    for low, high in ranges:
        out = out | ((p >= low) & (F.ceil(p / high) * low <= p))
    return out


def pack_dna(sequence: Column) -> Column:
    """Two bits a base as lower-case hex, four bases a byte, first base in the high bits; the last byte is filled with A.
    Only for sequences of ACGT; their length has to be kept beside."""
    padded = F.concat(F.upper(sequence), F.repeat(F.lit("A"), F.pmod(-F.length(sequence), F.lit(4))))
    digits = F.translate(padded, "ACGT", "0123")
    byte = lambda i: F.lpad(F.hex(F.conv(F.substring(digits, 4 * i + 1, F.lit(4)), 4, 10).cast("long")), 2, "0")
    return F.when(F.length(sequence) == 0, "").otherwise(F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.length(sequence) / 4).cast("int") - 1), byte), "")))


def unpack_dna(packed: Column, length: Column) -> Column:
    """The first `length` bases of pack_dna's text."""
    digit = lambda i: F.lpad(F.conv(F.substring(packed, 2 * i + 1, F.lit(2)), 16, 4), 4, "0")
    every = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(length / 4).cast("int") - 1)), digit), "")
    return F.when(length == 0, "").otherwise(F.translate(F.substring(every, F.lit(1), length.cast("int")), "0123", "ACGT"))


def little_endian(value: Column, size: int) -> Column:
    """Whole numbers as `size` bytes, the low one first."""
    hexed = F.lpad(F.right(F.hex(value.cast("long")), F.lit(2 * size)), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(hexed, 2 * (size - i) - 1, 2) for i in range(size))))


def from_little_endian(data: Column, size: int) -> Column:
    """The signed number of the first `size` bytes (at most 8)."""
    hexed = F.hex(data)
    turned = F.concat(*(F.substring(hexed, 2 * (size - i) - 1, 2) for i in range(size)))
    high = F.conv(F.substring(turned, 1, size), 16, 10).cast("long")
    low = F.conv(F.substring(turned, size + 1, size), 16, 10).cast("long")
    half = 1 << (4 * size)
    return F.when(high >= half // 2, high - half).otherwise(high) * F.lit(half) + low


def random_qualities(ids: DataFrame, sets: DataFrame, seed: int = 0) -> DataFrame:
    """(read, scores): each read takes one of the given sets (set, scores), by a hash of its id; sets are few."""
    n = sets.count()
    numbered = sets.withColumn("nth", F.row_number().over(W.orderBy("set")) - 1)
    return ids.withColumn("nth", F.pmod(F.xxhash64("read", F.lit(seed)), F.lit(max(1, n))).cast("int")).join(F.broadcast(numbered), "nth").select("read", "scores")


def graph_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): nodes with labels and directed links with weights, as the lines of a drawing."""
    a = nodes.select(F.format_string('%d [label="%s"];', "node", "label").alias("value"))
    return a.unionAll(edges.select(F.format_string("%d -> %d [weight=%d];", "src", "dst", "n").alias("value")))
