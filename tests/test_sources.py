from pyspark.sql import functions as F

from weftline.sources import formats
from weftline.streaming import windows


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_shown_alignments_round_trip(spark, tmp_path):
    text = "\nx: 3 records\n 1 2 n [ 0.. 100] x [ 5.. 110] ( 7 diffs, 2 trace pts)\n 1,234 5 c [10..1,020] x [0..900] ~ 12.3% ( 64 diffs)\n"
    df = formats.shown_alignments(spark, write(tmp_path, "a.txt", text))
    want = [(0, 1, True, 0, 99, 5, 109, 7), (1233, 4, False, 10, 1019, 0, 899, 64)]
    assert sorted(tuple(r) for r in df.collect()) == want
    formats.show_alignments(df).write.text(str(tmp_path / "b"))
    assert sorted(tuple(r) for r in formats.shown_alignments(spark, str(tmp_path / "b")).collect()) == want


def test_paf_and_names(spark, tmp_path):
    df = formats.paf(spark, write(tmp_path, "p.paf", "q1\t100\t0\t50\t+\tt1\t200\t10\t60\t45\t50\t60\nbad line\n"))
    assert [tuple(r) for r in df.collect()] == [("q1", 100, 0, 49, True, "t1", 200, 10, 59, 5)]
    names = spark.createDataFrame([("read10",), ("read2",), ("a",), ("a",), ("zzzz9",)], "name string")
    assert sorted((r["id"], r["name"]) for r in formats.numbered(names).collect()) == [(0, "a"), (1, "read10"), (2, "read2"), (3, "zzzz9")]


def test_fasta_and_track(spark, tmp_path):
    df = formats.fasta(spark, write(tmp_path, "x.fa", ">r1 note\nACGT\nAC\n>r2\nTT\n"))
    assert sorted(tuple(r) for r in df.collect()) == [("r1", "ACGTAC", 6), ("r2", "TT", 2)]
    assert spark.range(1).select(formats.reverse_complement(F.lit("AACg"))).first()[0] == "cGTT"
    t = formats.track(spark, write(tmp_path, "t.txt", "0 5 9 12\n\n3,4\n")).collect()
    assert sorted((r["start"], r["end"]) for r in t) == [(0, 5), (3, 4), (9, 12)]


def test_quality_codec(spark):
    df = spark.range(1, 52).select(F.col("id").cast("int").alias("q"))
    assert df.where(formats.quality_score(formats.quality_symbol(F.col("q"))) != F.col("q")).count() == 0
    low = lambda *x: spark.range(1).select(formats.low_quality(F.array(*map(F.lit, x)))).first()[0]
    assert low(30, 30, 1, 1) and low(51, 2, 24, 24) and not low(1, 2, 30)


def test_stream_is_the_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "events"))
    q = windows.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r)[:4] for r in spark.table("tumbled").collect()}
    assert got == {tuple(r)[:4] for r in windows.tumbling(table).collect()}
    assert windows.sessions(table).agg(F.sum("n")).first()[0] == table.count()


def test_fasta_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r1", "ACGTACGTA"), ("r2", "ACGT"), ("r3", "")], "name string, sequence string")
    lines = formats.fasta_lines(df, 4)
    assert sorted(r[0] for r in lines.collect()) == [">r1\nACGT\nACGT\nA", ">r2\nACGT", ">r3\n"]
    lines.coalesce(1).write.text(str(tmp_path / "f"))
    assert sorted((r["name"], r["sequence"]) for r in formats.fasta(spark, str(tmp_path / "f")).collect()) == [("r1", "ACGTACGTA"), ("r2", "ACGT"), ("r3", "")]


def test_dumped_reads(spark, tmp_path):
    text = "+ R 3\nR 1\nH 4 name\nL 0 5 105\nR 2\nH 4 name\nL 1 0 70\nR 9\nL 2 10 11\n"
    assert sorted(tuple(r) for r in formats.dumped_reads(spark, write(tmp_path, "d.txt", text)).collect()) == [(0, 100), (1, 70), (8, 1)]
    assert formats.dumped_reads(spark, write(tmp_path, "e.txt", "L 0 5 105\n")).count() == 0


def test_translation_and_graph(spark, tmp_path):
    df = formats.translation(spark, write(tmp_path, "t.txt", "3,1:-4:7\n\n10\n"))
    rows = sorted((r["line"], r["block"], r["character"]) for r in df.collect())
    assert [r[1:] for r in rows] == [(0, 1), (0, 3), (1, -4), (2, 7), (0, 10)]
    assert sorted(r["value"] for r in formats.translation_lines(df.withColumnRenamed("line", "read_id")).collect()) == ["1,3:-4:7", "10"]
    edges = spark.createDataFrame([(2, 1), (1, 2), (3, 4)], "src long, dst long")
    formats.write_graph(spark.range(5), edges, str(tmp_path / "g"))
    nodes, again = formats.read_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == 5 and sorted(r[0] for r in formats.dot(again).collect()) == ["1 -- 2;", "3 -- 4;"]
