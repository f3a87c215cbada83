import pytest
from pyspark.sql import functions as F

from knotwork import Graph
from knotwork.functions import parse
from knotwork.graph import dense_index, exclusive_sums
from knotwork.sources import binary, logs, tables, text
from knotwork.streaming import maintain
from knotwork.operators import strategies


def lines(spark, tmp_path, *rows):
    path = str(tmp_path / "in.txt")
    with open(path, "w") as f:
        f.write("\n".join(rows) + "\n")
    return path


def test_edge_list(spark, tmp_path):
    path = lines(spark, tmp_path, "1 2", "2 3 ignored 9", "3\t3", "", "bad line", "1 2")
    assert sorted(tuple(r) for r in text.read_edges(spark, path).collect()) == [(0, 1), (0, 1), (1, 2), (2, 2)]
    assert tuple(text.largest_id(text.read_edges(spark, path)).first()) == (4, 3)


def test_matrix(spark, tmp_path):
    path = lines(spark, tmp_path, "%%MatrixMarket", "% note", "3 3 4", "1 2", "2 2", "3 1")
    assert sorted(tuple(r) for r in text.read_matrix(spark, path).collect()) == [(0, 1), (2, 0)]


def test_adjacency_with_properties(spark, tmp_path):
    path = lines(spark, tmp_path, '0 "a b" 1 2.5 2 3.5', "1 c", '2 "d" 0 1')
    edges, vertices = text.read_adjacency(spark, path, vertex_props={"name": "string"}, edge_props={"w": "double"})
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 1, 2.5), (0, 2, 3.5), (2, 0, 1.0)]
    assert sorted(tuple(r) for r in vertices.collect()) == [(0, "a b"), (1, "c"), (2, "d")]


def test_binary_files(spark, tmp_path):
    g = Graph(spark.createDataFrame([(0, 2), (2, 1), (0, 1)], "src long, dst long").withColumn("w", F.col("dst") * 0.5), spark.range(4).selectExpr("id as v", "id = 1 as one"))
    binary.write(g, str(tmp_path / "basic"))
    back = binary.read(spark, str(tmp_path / "basic"))
    assert sorted(tuple(r) for r in back.edges.collect()) == [(0, 1, 0), (0, 2, 1), (2, 1, 2)] and back.vertices.count() == 4
    with open(tmp_path / "basic", "rb") as f:
        assert f.read(4) == bytes.fromhex("03939999")
    binary.write(g, str(tmp_path / "ext"), g.vertices.selectExpr("v", "v + 100 as key"), {"one": "bool"}, {"w": "double"})
    edges, vertices = binary.read_extended(spark, str(tmp_path / "ext"), {"one": "bool"}, {"w": "double"})
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 1, 0.5), (0, 2, 1.0), (2, 1, 0.5)]
    assert sorted(tuple(r) for r in vertices.collect()) == [(0, 100, False), (1, 101, True), (2, 102, False), (3, 103, False)]
    with pytest.raises(Exception, match="kind"):
        binary.read_extended(spark, str(tmp_path / "ext"), {"one": "int"}, {"w": "double"})[1].collect()
    with pytest.raises(Exception, match="magic"):
        binary.read(spark, str(tmp_path / "ext")).edges.collect()


def test_flipped_binary_files(spark, tmp_path):
    """Old files, every number little-endian, give what the others give."""
    import struct

    basic = struct.pack("<IIIii", binary.BASIC_MAGIC, 4, 4, 3, 2) + struct.pack("<4i", 0, 1, 1, 2) + struct.pack("<2i", 2, 1)
    (tmp_path / "old").write_bytes(basic)
    back = binary.read(spark, str(tmp_path / "old"))
    assert sorted(tuple(r) for r in back.edges.collect()) == [(0, 2, 0), (2, 1, 1)] and back.vertices.count() == 3
    more = struct.pack("<?3q", True, 7, 8, 9) + struct.pack("<IIQ3q", 1, binary.KINDS["long"], 24, 4, 5, 6) + struct.pack("<IIQ2d", 1, binary.KINDS["double"], 16, 0.5, 1.5)
    (tmp_path / "old_ext").write_bytes(struct.pack("<I", binary.EXTENDED_MAGIC) + basic[4:] + more)
    edges, vertices = binary.read_extended(spark, str(tmp_path / "old_ext"), {"x": "long"}, {"w": "double"})
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 2, 0.5), (2, 1, 1.5)]
    assert sorted(tuple(r) for r in vertices.collect()) == [(0, 7, 4), (1, 8, 5), (2, 9, 6)]


def test_parquet_schema_is_checked(spark, tmp_path):
    g = Graph(spark.createDataFrame([(0, 1)], "src long, dst long"), spark.range(2).withColumnRenamed("id", "v"))
    tables.write(g, str(tmp_path / "g"))
    from pyspark.sql import types as T

    with pytest.raises(ValueError):
        tables.read(spark, str(tmp_path / "g"), T.StructType([T.StructField("w", T.DoubleType())]))


def test_tokens_and_values(spark):
    df = spark.createDataFrame([(r'a "b c" d\ e  "x\"y"',), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(parse.tokens(F.col("t"))).collect()] == [["a", '"b c"', r"d\ e", r'"x\"y"'], [], []]
    one = spark.createDataFrame([("12abc", "TRUE", "-3.5e1x", r'"q\"z"', "abc")], "i string, b string, d string, s string, n string")
    got = one.select(parse.parse(F.col("i"), "int"), parse.parse(F.col("b"), "bool"), parse.parse(F.col("d"), "double"), parse.parse(F.col("s"), "string"), parse.parse(F.col("n"), "long")).first()
    assert tuple(got) == (12, True, -35.0, 'q"z', 0)


def test_numbering(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 100_003).repartition(7)
    want = sorted(r.x for r in df.collect())
    assert [r.idx for r in dense_index(df, "x", "idx").orderBy("x").collect()] == list(range(1000))
    sums, total = exclusive_sums(df, "x", "x", "before").orderBy("x").collect(), 0
    for r, x in zip(sums, want):
        assert r.before == total
        total += x


def test_logs(spark, tmp_path):
    path = lines(spark, tmp_path, "data=g 2 8", "[0]running_time(ms)=1.5", "Total # SCCs = 3", "data=g 5 8", "[0]running_time(ms)=2", "Total # SCCs = 3")
    found = logs.runs(logs.read_log(spark, path))
    assert sorted((r.method, r.runtime_ms, r.scc_count) for r in found.collect()) == [(2, 1.5, 3), (5, 2.0, 3)]
    logs.write_runs(found, str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("g", "5", "8", "2.0", "3")]


def test_stream_replay_is_harmless(spark, tmp_path):
    g = Graph(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), spark.range(3).withColumnRenamed("id", "v"))
    folder, source = str(tmp_path / "state"), str(tmp_path / "source")
    maintain.start_state(g, strategies.scc(g), folder)
    spark.createDataFrame([("+", 2, 0)], "op string, src long, dst long").write.parquet(source)
    for attempt in range(2):  # the second query knows nothing of the first and sends batch 0 again
        stream = spark.readStream.schema("op string, src long, dst long").parquet(source)
        maintain.maintain(stream, folder, str(tmp_path / f"checkpoint{attempt}")).awaitTermination()
        graph, labels = maintain.current(spark, folder)
        assert {r.v: r.scc for r in labels.collect()} == {0: 0, 1: 0, 2: 0} and graph.edges.count() == 3
