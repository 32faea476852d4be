"""Text tables: what is written is read back; rules on single values against loops."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.sources import formats, tables


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


@pytest.mark.parametrize("layout", sorted(tables.LAYOUTS))
def test_layouts_round_trip(spark, tmp_path, layout):
    r = random.Random(1)
    columns = tables.LAYOUTS[layout]
    make = {"int": lambda: r.randint(-1, 5000), "boolean": lambda: r.random() < 0.5, "double": lambda: round(r.random() * 50, 2)}
    rows = [tuple(make[kind]() for _, kind, _ in columns) for _ in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k, _ in columns))
    tables.table_lines(df, layout).coalesce(1).write.text(str(tmp_path / "t"))
    back = tables.read_table(spark, str(tmp_path / "t"), layout)
    assert back.columns == df.columns and sorted(tuple(x) for x in back.collect()) == sorted(rows)


def test_alignment_lines_and_counts(spark, tmp_path):
    path = write(tmp_path, "a.txt", "3,0,10,20,1,0,1,2|5,3.5\n3,1,30,40,0,0,0,0|1,1.0\n4,0,5,9,0,1,1,0|2,2.25\nbad\n")
    assert [tuple(x) for x in tables.read_table(spark, path, "alignment").orderBy("read_a", "id").collect()][0] == (3, 0, 10, 20, True, False, True, 2, 5, 3.5)
    assert sorted(tuple(x) for x in tables.count_table(spark, path).collect()) == [(3, 2), (4, 1)]


def test_connections(spark, tmp_path):
    text = "6,7,10,90,0,1,0,1,2,35,1,12,4.5\n\n3,2,5,50,1,0,1,0,0,11,12,5,50,9,2.0\n0,4,1,9,0,0,1,1,0,3,1.5\n"
    df = tables.read_connections(spark, write(tmp_path, "c.txt", text))
    got = {x["line"]: x["connection"] for x in df.collect()}
    assert got[1] is None and got[0]["period"] == 35 and got[0]["least_prefix"] is None and got[0]["assigned"] == 12
    assert got[2]["last_maximal_end"] == 50 and got[2]["coverage"] == 2.0 and got[3]["id"] == 4 and got[3]["assigned"] == 3
    assert [x["value"] for x in tables.connection_lines(df).orderBy("line").collect()] == text.split("\n")[:4]


def test_alphabet(spark, tmp_path):
    rows = [(5, False, 100, 300, 0, False, True), (5, True, 100, 300, 0, True, False), (2, True, -1, -1, 400, False, False), (-1, True, -1, -1, 900, True, False), (-1, True, -1, -1, 700, False, False)]
    chars = spark.createDataFrame(rows, "repeat int, fwd boolean, start_p int, end_p int, length int, open_start boolean, open_end boolean")
    lines = [x["value"] for x in tables.alphabet_lines(chars).collect()]
    assert lines[0] == "1,2,4,900" and lines[3].startswith("2,1,-1")
    header, back = tables.read_alphabet(spark, write(tmp_path, "a.txt", "\n".join(lines) + "\n"))
    assert tuple(header.first()) == (1, 2, 4, 900)
    assert sorted(tuple(x)[1:] for x in back.collect()) == sorted(rows) and [x["char_id"] for x in back.orderBy("char_id").collect()] == [0, 1, 2, 3, 4]
    merged = tables.merge_headers(tables.alphabet_header(chars).unionAll(tables.alphabet_header(chars.where("repeat <> -1"))))
    assert tuple(merged.first()) == (1, 3, 7, 900)


def test_side_tables(spark, tmp_path):
    path = write(tmp_path, "u.txt", "1,100,2,7,50,1\n\n3,30,1\n")
    assert sorted(tuple(x) for x in tables.unique_intervals(spark, path).collect()) == [(0, 1, 100, 2), (0, 7, 50, 1), (2, 3, 30, 1)]
    path = write(tmp_path, "t.txt", "\n0,3,5,9\n")
    assert sorted(tuple(x) for x in tables.tandem_intervals(spark, path).collect()) == [(1, 0, 3), (1, 5, 9)]
    assert sorted(x["read"] for x in tables.id_list(spark, write(tmp_path, "i.txt", "4\n\n4\n9\n")).collect()) == [4, 9]
    assert [tuple(x) for x in tables.quality_track(spark, write(tmp_path, "q.txt", "azA\n!\n")).orderBy("read").collect()] == [(0, [1, 26, 27]), (1, [0])]


def test_tracks(spark, tmp_path):
    df = spark.createDataFrame([(0, 5, 9), (0, 1, 3), (2, 7, 8)], "read int, start int, end int")
    assert sorted(tuple(x) for x in tables.track_lines(df).collect()) == [(0, "1,3 5,9"), (2, "7,8")]
    tables.write_tracks({"dust": df, "tandem": df.where("read = 2")}, str(tmp_path / "tracks"))
    assert tables.read_tracks(spark, str(tmp_path / "tracks")).count() == 4
    assert [tuple(x) for x in tables.read_tracks(spark, str(tmp_path / "tracks"), "tandem").select("read", "start", "end").collect()] == [(2, 7, 8)]


def test_names_and_groups(spark, tmp_path):
    paf = formats.paf(spark, write(tmp_path, "p.paf", "q1\t100\t0\t50\t+\trep1\t200\t10\t60\t45\t50\t60\nq2\t100\t0\t50\t-\tother\t200\t10\t60\t45\t50\t60\n"))
    names = spark.createDataFrame([("rep1", 3)], "name string, id int")
    assert [tuple(x) for x in tables.repeat_alignments(paf, names).collect()] == [(3, "q1", True, 10, 59, 0, 49, 5, 200)]
    fasta = spark.createDataFrame([("a", "ACGT"), ("b", "GG"), ("c", "T")], "name string, sequence string")
    tables.fan_out(fasta, spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "name string, group int"), str(tmp_path / "out"))
    assert sorted(x["name"] for x in formats.fasta(spark, str(tmp_path / "out" / "group=2")).collect()) == ["b", "c"]


def test_taxonomy(spark, tmp_path):
    text = "".join(f"<option value='x'>{'&nbsp;' * d}{n}</option>\n" for d, n in ((0, "All Repeats"), (1, "Class I"), (2, "LTR"), (2, "LINE"), (1, "Class II"), (3, "Deep")))
    got = {x["label"]: x for x in tables.taxonomy(spark, write(tmp_path, "t.html", text)).collect()}
    assert {k: (v["depth"], v["parent"]) for k, v in got.items()} == {"all-repeats": (0, -1), "class-i": (1, 0), "ltr": (2, 1), "line": (2, 1), "class-ii": (1, 0), "deep": (3, 4)}


def test_periods(spark, tmp_path):
    got = tables.periods(spark, write(tmp_path, "a.txt", "# note 5\n2\n17\n17\n"), write(tmp_path, "b.txt", "Homo sapiens\thuman\t171\n"))
    assert sorted(x["period"] for x in got.collect()) == [2, 17, 171]

    def known(p):
        return any(low * i <= p <= high * i for low, high in tables.KNOWN for i in range(1, p + 1))

    df = spark.range(1, 1000).select(F.col("id").cast("int").alias("p"))
    assert {x["p"]: x["k"] for x in df.select("p", tables.is_known_period(F.col("p")).alias("k")).collect()} == {p: known(p) for p in range(1, 1000)}


def test_dna_and_numbers(spark):
    r = random.Random(2)
    rows = [("".join(r.choices("ACGT", k=n)),) for n in [0, 1, 2, 3, 4, 5, 8, 31, 100]]
    df = spark.createDataFrame(rows, "s string").withColumn("packed", tables.pack_dna(F.col("s")))
    for x in df.select("s", "packed", tables.unpack_dna(F.col("packed"), F.length("s")).alias("back")).collect():
        assert x["back"] == x["s"] and len(x["packed"]) == 2 * -(-len(x["s"]) // 4)
        assert x["packed"] == bytes(sum("ACGT".index(c) << (6 - 2 * j) for j, c in enumerate(x["s"][i : i + 4])) for i in range(0, len(x["s"]), 4)).hex()
    numbers = [0, 1, 255, 256, -1, -2, 2**31 - 1, -(2**31), 123456789]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").withColumn("b", tables.little_endian(F.col("n"), 4))
    for x in df.select("n", "b", tables.from_little_endian(F.col("b"), 4).alias("back")).collect():
        assert bytes(x["b"]) == x["n"].to_bytes(4, "little", signed=True) and x["back"] == x["n"]
    big = spark.createDataFrame([(n,) for n in (2**62 + 5, -(2**63), 2**63 - 1)], "n long").withColumn("b", tables.little_endian(F.col("n"), 8))
    assert all(bytes(x["b"]) == x["n"].to_bytes(8, "little", signed=True) and x["back"] == x["n"] for x in big.select("n", "b", tables.from_little_endian(F.col("b"), 8).alias("back")).collect())


def test_qualities_and_drawings(spark):
    sets = spark.createDataFrame([("x", [1, 2]), ("y", [3])], "set string, scores array<int>")
    got = tables.random_qualities(spark.range(50).withColumnRenamed("id", "read"), sets)
    assert got.count() == 50 and {tuple(x["scores"]) for x in got.collect()} == {(1, 2), (3,)}
    nodes, edges = spark.createDataFrame([(1, "a")], "node long, label string"), spark.createDataFrame([(1, 2, 9)], "src long, dst long, n long")
    assert [x["value"] for x in tables.graph_export(nodes, edges).collect()] == ['1 [label="a"];', "1 -> 2 [weight=9];"]
