"""The registered queries of the graph engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, parse
from ..graph import Graph, encode_edges, key_dictionary, path_graph, star_graph
from ..loop import cut, shared_dir
from ..operators import collections as coll
from ..operators import dynamic, report, split, strategies, traverse, trim
from ..sources import binary, logs, tables, text
from ..streaming import maintain
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _first_vertex(spark: SparkSession) -> DataFrame:
    return spark.range(1).withColumnRenamed("id", "v")


_LABELS = "SELECT v, scc FROM l"
_EDGES = "SELECT s AS src, d AS dst FROM {}"

# --- sources and sinks -----------------------------------------------------------------------


@query(fx.sql(_EDGES.format("base")))
def text_edges(spark, sf_dir):
    path = _folder(spark)
    text.write_edges(fx.base(spark, sf_dir).edges, path)
    return text.read_edges(spark, path)


@query(fx.sql("SELECT count(*) AS edges, max(greatest(s, d)) + 1 AS vertices FROM base"))
def text_numbers(spark, sf_dir):
    path = _folder(spark)
    text.write_edges(fx.base(spark, sf_dir).edges, path)
    return text.largest_id(text.read_edges(spark, path))


@query(fx.sql("SELECT s AS src, d AS dst FROM multi WHERE s <> d"))
def matrix_edges(spark, sf_dir):
    path = _folder(spark)
    lines = fx.multigraph(spark, sf_dir).edges.select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1).alias("value"))
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate pattern general",), ("% made from events",), ("9 9 9",)], "value string")
    head.coalesce(1).union(lines.coalesce(1)).coalesce(1).write.text(path)
    return text.read_matrix(spark, path)


@query(fx.sql("SELECT s AS src, d AS dst FROM base"))
def tab_edges(spark, sf_dir):
    raw, path = _folder(spark), _folder(spark)
    lines = fx.base(spark, sf_dir).edges.select(F.concat_ws("\t", "src", "dst").alias("value"))
    spark.createDataFrame([("# a tab-separated list",)], "value string").union(lines).write.text(raw)
    text.convert_tabs(spark, raw, path)
    return text.read_edges(spark, path, one_based=False)


@query(fx.sql("SELECT v, dense_rank() OVER (ORDER BY scc) - 1 AS label FROM l", fx.closure()))
def label_file(spark, sf_dir):
    path = _folder(spark)
    text.write_labels(report.export(strategies.scc(fx.base(spark, sf_dir))), path)
    return text.read_labels(spark, path)


@query(fx.sql("SELECT v, scc AS label FROM l", fx.closure()))
def raw_label_file(spark, sf_dir):
    """Labels written as they are, not renumbered."""
    path = _folder(spark)
    text.write_labels(strategies.scc(fx.base(spark, sf_dir)).withColumnRenamed("scc", "label"), path)
    return text.read_labels(spark, path)


@query(fx.sql("SELECT v, v * 0.5 AS half, count(s) AS degree, sum(d) AS ends, sum(s * 3) AS weights FROM vx LEFT JOIN base ON s = v GROUP BY v"))
def adjacency_records(spark, sf_dir):
    """Nested records, as Avro files hold them, written as parquet and taken apart again."""
    path, g = _folder(spark), fx.base(spark, sf_dir)
    text.to_records(g.edges.withColumn("w", F.col("src") * 3), g.vertices.withColumn("half", F.col("v") * 0.5)).write.parquet(path)
    edges, vertices = text.from_records(spark.read.parquet(path))
    near = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"), F.sum("dst").alias("ends"), F.sum("w").alias("weights"))
    return vertices.join(near, "v", "left").fillna(0, ["degree"])


@query(fx.sql("SELECT s AS src, d AS dst, s * 1.5 AS w, s > d AS up FROM base"))
def typed_edges(spark, sf_dir):
    path = _folder(spark)
    e = fx.base(spark, sf_dir).edges.select("src", "dst", (F.col("src") * F.lit(1.5)).alias("w"), (F.col("src") > F.col("dst")).alias("up"))
    text.write_typed_edges(e, path)
    return text.read_typed_edges(spark, path, {"w": "double", "up": "bool"})


@query(fx.sql("SELECT s AS src, d AS dst FROM base"))
def adjacency_file(spark, sf_dir):
    path, g = _folder(spark), fx.base(spark, sf_dir)
    text.write_adjacency(g.edges, g.vertices, path)
    return text.read_adjacency(spark, path)[0]


@query(fx.sql("SELECT v, v % 3 = 0 AS third, v * 0.5 AS half, count(s) AS degree, coalesce(sum(s + d), 0)::BIGINT AS weights FROM vx LEFT JOIN base ON s = v GROUP BY v"))
def adjacency_properties(spark, sf_dir):
    """Vertex and edge properties through an adjacency file."""
    path, g = _folder(spark), fx.base(spark, sf_dir)
    text.write_adjacency(g.edges.withColumn("w", F.col("src") + F.col("dst")), g.vertices.withColumns({"third": F.col("v") % 3 == 0, "half": F.col("v") * 0.5}), path)
    edges, vertices = text.read_adjacency(spark, path, vertex_props={"third": "bool", "half": "double"}, edge_props={"w": "long"})
    near = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"), F.sum("w").alias("weights"))
    return vertices.join(near, "v", "left").fillna(0, ["degree", "weights"])


@query(fx.sql("SELECT v, v * 7 AS key, v % 2 = 0 AS even FROM vx WHERE v <= (SELECT max(greatest(s, d)) FROM base)"))
def extended_binary_vertices(spark, sf_dir):
    path, g = _folder(spark), Graph.from_edges(fx.base(spark, sf_dir).edges)
    g = Graph(g.edges, g.vertices.withColumn("even", F.col("v") % 2 == 0))
    binary.write(g, path, g.vertices.select("v", (F.col("v") * 7).alias("key")), {"even": "bool"}, {})
    return binary.read_extended(spark, path, {"even": "bool"}, {})[1]


@query(fx.sql("SELECT s AS src, d AS dst, row_number() OVER (ORDER BY s, d) - 1 AS eid FROM base"))
def binary_file(spark, sf_dir):
    path, g = _folder(spark), fx.base(spark, sf_dir)
    binary.write(Graph.from_edges(g.edges), path)
    return binary.read(spark, path).edges


@query(fx.sql("SELECT s AS src, d AS dst, CAST(s * 2 AS DOUBLE) AS w FROM base"))
def extended_binary_file(spark, sf_dir):
    path, g = _folder(spark), Graph.from_edges(fx.base(spark, sf_dir).edges)
    g = Graph(g.edges.withColumn("w", (F.col("src") * 2).cast("double")), g.vertices.withColumn("even", F.col("v") % 2 == 0))
    binary.write(g, path, g.vertices.select("v", (F.col("v") * 7).alias("key")), {"even": "bool"}, {"w": "double"})
    return binary.read_extended(spark, path, {"even": "bool"}, {"w": "double"})[0]


@query(fx.sql("SELECT s AS src, d AS dst FROM base"))
def parquet_graph(spark, sf_dir):
    path = _folder(spark)
    tables.write(fx.base(spark, sf_dir), path)
    return tables.read(spark, path).edges


@query(r"""SELECT event_id, len(regexp_extract_all(props, '[^ \t]+')) + 3 AS n_tokens, event_type || ' "x\y' AS quoted, event_type IN ('1', 'true') AS flag, lower(event_type) = 'view' AS seen,
    CAST(trunc(CAST(value AS DOUBLE)) AS BIGINT) AS whole, CAST(trunc(CAST(value AS DOUBLE)) AS INTEGER) AS small, -CAST(value AS DOUBLE) AS number, 0::BIGINT AS none FROM events""")
def tokenize_parse(spark, sf_dir):
    """Lines of blanks, tabs, a quoted token with blanks, an escaped quote and an escaped
    backslash inside, and numbers with garbage behind them."""
    e = fx.table(spark, sf_dir, "events")
    value = F.col("value").cast("decimal(20,6)").cast("string")
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit(r' \"x\\y"'))
    line = F.concat(F.lit(" \t"), F.col("props"), F.lit("\t"), quoted, F.lit("  "), value, F.lit("x7 -"), value, F.lit("e0,1 "))
    t = e.select("event_id", "event_type", parse.tokens(line).alias("t"))
    last = lambda n: F.element_at("t", -n)
    seen = F.when(F.col("event_type") == "view", "TRUE").otherwise(F.col("event_type"))
    return t.select(
        "event_id", F.size("t").cast("long").alias("n_tokens"), parse.parse(last(3), "string").alias("quoted"), parse.parse(F.col("event_type"), "bool").alias("flag"), parse.parse(seen, "bool").alias("seen"),
        parse.parse(last(2), "long").alias("whole"), parse.parse(last(2), "int").alias("small"), parse.parse(last(1), "double").alias("number"), parse.parse(F.lit("x1"), "node").alias("none"),
    )


_LOG = """VALUES ('a', 0, 'data=g1 2 8'), ('a', 1, '[0]running_time(ms)=12.500000'), ('a', 2, 'Total # SCCs = 40'),
 ('a', 3, 'data=g1 5 8'), ('a', 4, '[0]running_time(ms)=30.0'), ('a', 5, 'noise'), ('a', 6, 'Total # SCCs = 38'),
 ('b', 0, 'data=g1 2 8'), ('b', 1, '[0]running_time(ms)=10.0'), ('b', 2, 'Total # SCCs = 40'),
 ('b', 3, 'data=g1 5 8'), ('b', 4, '[0]running_time(ms)=31.0'), ('b', 5, 'Total # SCCs = 39')"""
_RUNS = "VALUES ('a','g1',2,8,12.5,40), ('a','g1',5,8,30.0,38), ('b','g1',2,8,10.0,40), ('b','g1',5,8,31.0,39)"


def _log_lines(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT col1 AS log, col2 AS line, col3 AS value FROM ({_LOG})")


@query(f"SELECT a AS log, b AS file, c AS method, d AS threads, CAST(e AS DOUBLE) AS runtime_ms, CAST(f AS BIGINT) AS scc_count FROM ({_RUNS}) t(a, b, c, d, e, f)")
def run_log_extract(spark, sf_dir):
    return logs.runs(_log_lines(spark))


@query("SELECT 'g1' AS file, * FROM (VALUES (2, 12.5::DOUBLE, 40::BIGINT, 10.0::DOUBLE, 40::BIGINT, 1.25::DOUBLE, true, 'b'), (5, 30.0::DOUBLE, 38::BIGINT, 31.0::DOUBLE, 39::BIGINT, 30.0::DOUBLE / 31.0::DOUBLE, false, 'tie')) t(method, a_ms, a_count, b_ms, b_count, speedup, counts_match, winner)")
def run_comparison(spark, sf_dir):
    r = logs.runs(_log_lines(spark))
    return logs.compare(r.filter("log = 'a'"), r.filter("log = 'b'"))


@query("SELECT 2::BIGINT AS runs, 42.5::DOUBLE AS a_ms, 41.0::DOUBLE AS b_ms, 0::BIGINT AS a_wins, 1::BIGINT AS b_wins, 1::BIGINT AS matches, 42.5::DOUBLE / 41.0::DOUBLE AS speedup")
def run_totals(spark, sf_dir):
    return logs.totals(run_comparison(spark, sf_dir))


# --- construction and indexing ---------------------------------------------------------------


@query(fx.sql(_EDGES.format("base")))
def edges_base(spark, sf_dir):
    return fx.base(spark, sf_dir).edges


@query(fx.sql("SELECT unnest(range(0, 9 + max(greatest(s, d)))) AS v FROM base"))
def dense_vertices(spark, sf_dir):
    """Vertices made from the edges, and eight added."""
    g = Graph.from_edges(fx.base(spark, sf_dir).edges)
    top = g.vertices.agg(F.max("v")).first()[0]
    return g.with_vertices(spark.range(top - 5, top + 9)).vertices


@query(fx.sql(_EDGES.format("base")))
def frozen_edges(spark, sf_dir):
    return fx.base(spark, sf_dir).frozen().edges


@query("SELECT 'path' AS kind, i AS src, i + 1 AS dst FROM range(999) t(i) UNION ALL SELECT 'star', 0, i + 1 FROM range(999) t(i)")
def toy_graphs(spark, sf_dir):
    path, star = path_graph(spark, 1000).edges, star_graph(spark, 1000).edges
    return path.select(F.lit("path").alias("kind"), "src", "dst").union(star.select(F.lit("star").alias("kind"), "src", "dst"))


@query(fx.sql("SELECT d AS src, s AS dst FROM base"))
def edges_reverse(spark, sf_dir):
    return fx.base(spark, sf_dir).reversed().edges


@query(fx.sql("SELECT v, count(s) AS degree FROM vx LEFT JOIN base ON s = v GROUP BY 1"))
def out_degree(spark, sf_dir):
    return fx.base(spark, sf_dir).out_degrees()


@query(fx.sql("SELECT v, count(d) AS degree FROM vx LEFT JOIN base ON d = v GROUP BY 1"))
def in_degree(spark, sf_dir):
    return fx.base(spark, sf_dir).in_degrees()


@query(fx.sql("SELECT s AS src, d AS dst, count(*) AS copies FROM multi GROUP BY ALL"))
def edge_multiplicity(spark, sf_dir):
    return fx.multigraph(spark, sf_dir).multiplicity()


@query(fx.sql("SELECT s AS src, d AS dst, eid FROM multi WHERE s = d"))
def self_loops(spark, sf_dir):
    return fx.multigraph(spark, sf_dir).edges.filter("src = dst")


@query(fx.sql("SELECT c_custkey AS src, 2 AS dst, count(s) AS copies, count(s) > 0 AS found, min(eid) AS eid FROM customer LEFT JOIN multi ON s = c_custkey AND d = 2 GROUP BY 1"))
def has_edge_lookup(spark, sf_dir):
    asked = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), F.lit(2).alias("dst"))
    return fx.multigraph(spark, sf_dir).has_edges(asked)


@query(fx.sql("SELECT s AS src, d AS dst FROM base UNION SELECT d, s FROM base"))
def undirected_edges(spark, sf_dir):
    return fx.base(spark, sf_dir).undirected().edges


@query(fx.sql("SELECT s AS src, d AS dst FROM multi WHERE s <> d GROUP BY ALL"))
def simple_edges(spark, sf_dir):
    return fx.multigraph(spark, sf_dir).simple().edges


@query("SELECT event_type AS key, row_number() OVER (ORDER BY min(event_id)) - 1 AS idx FROM events GROUP BY event_type")
def key_dictionary_first(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return key_dictionary(e, F.col("event_type"), F.col("event_id"))


@query("""WITH k AS (SELECT event_type AS key, row_number() OVER (ORDER BY min(event_id)) - 1 AS idx FROM events GROUP BY 1),
p AS (SELECT event_type s, lead(event_type) OVER (ORDER BY event_id) d FROM events)
SELECT a.idx AS src, b.idx AS dst, count(*) AS n FROM p JOIN k a ON s = a.key JOIN k b ON d = b.key GROUP BY ALL""")
def keyed_edges(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", "event_type")
    keys = key_dictionary(e, F.col("event_type"), F.col("event_id"))
    after = e.join(e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("next")), "event_id")
    return encode_edges(after, "event_type", "next", keys).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(fx.sql("SELECT s AS v, count(*) AS degree FROM base GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"))
def max_degree_vertex(spark, sf_dir):
    return fx.base(spark, sf_dir).max_degree_vertex()


@query(fx.sql("SELECT max(n) AS max_out_degree FROM (SELECT count(*) AS n FROM (SELECT s FROM base UNION ALL SELECT s FROM ins) GROUP BY s)"))
def max_out_degree(spark, sf_dir):
    g = fx.base(spark, sf_dir).with_edges(fx.insertions(spark, sf_dir))
    return g.out_degrees().agg(F.max("degree").alias("max_out_degree"))


@query(fx.sql("SELECT v, coalesce(string_agg(d, ' ' ORDER BY d), '') AS neighbours FROM vx LEFT JOIN base ON s = v GROUP BY 1"))
def adjacency_sorted(spark, sf_dir):
    return fx.base(spark, sf_dir).adjacency().select("v", F.array_join(F.col("neighbours").cast("array<string>"), " ").alias("neighbours"))


@query(fx.sql("SELECT v, CAST(coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin, n AS degree FROM (SELECT v, count(s) AS n FROM vx LEFT JOIN base ON s = v GROUP BY 1)"))
def csr_offsets(spark, sf_dir):
    return fx.base(spark, sf_dir).offsets()


@query(fx.sql("SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events)) AS vertices, count(*) AS edges, count(*) FILTER (s = d) AS loops, count(DISTINCT (s, d)) AS different FROM multi"))
def graph_numbers(spark, sf_dir):
    return fx.multigraph(spark, sf_dir).numbers()


@query(fx.sql("SELECT s AS src, d AS dst FROM base WHERE s % 7 <> 0 AND d % 7 <> 0"))
def detach_vertices(spark, sf_dir):
    g = fx.base(spark, sf_dir)
    return g.without_vertices(g.vertices.filter("v % 7 = 0")).edges


@query(fx.sql("SELECT a.i AS src, b.i AS dst FROM base JOIN k a ON s = a.v JOIN k b ON d = b.v", "k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM vx WHERE v % 7 <> 0)"))
def compress_graph(spark, sf_dir):
    g = fx.base(spark, sf_dir)
    return g.without_vertices(g.vertices.filter("v % 7 = 0")).compressed()[0].edges


@query(fx.sql("SELECT s AS v, arg_min(d, md5('7:' || s || ':' || d)) AS neighbour FROM base WHERE s IN (SELECT v FROM vx ORDER BY md5('7:' || v), v LIMIT 200) GROUP BY s"))
def pick_random(spark, sf_dir):
    g = fx.base(spark, sf_dir)
    return g.pick_out_neighbours(7).join(g.pick_vertices(200, 7), "v", "left_semi")


# --- traversal ---------------------------------------------------------------------------------


def _bfs(edges: str = "base") -> str:
    """Each vertex once, at its first level: without a bound on the levels."""
    return f"q(v, l) USING KEY (v) AS (SELECT CAST(0 AS BIGINT) AS v, CAST(0 AS BIGINT) AS l UNION SELECT e.d, l + 1 FROM q JOIN {edges} e ON e.s = q.v WHERE e.d NOT IN (SELECT v FROM recurring.q))"


def _bfs_sql(edges: str) -> str:
    return fx.sql("SELECT v, l AS level FROM q", f"e AS ({edges})", _bfs("e"))


@query(_bfs_sql(fx.BASE))
def bfs_levels(spark, sf_dir):
    return traverse.bfs(fx.base(spark, sf_dir).edges, _first_vertex(spark))


@query(_bfs_sql("SELECT d AS s, s AS d FROM base"))
def bfs_reverse_levels(spark, sf_dir):
    return traverse.bfs(fx.base(spark, sf_dir).edges, _first_vertex(spark), reverse=True)


@query(_bfs_sql("SELECT s, d FROM base WHERE (s + d) % 5 <> 0 AND d % 11 <> 0"))
def bfs_navigated(spark, sf_dir):
    return traverse.bfs(fx.base(spark, sf_dir).edges, _first_vertex(spark), navigate=lambda s, d: (s + d) % 5 != 0, visit=lambda v: (v % 11 != 0) | (v == 0))


@query(fx.sql("SELECT l AS level, count(*) AS n FROM q GROUP BY l", _bfs()))
def level_counts(spark, sf_dir):
    return bfs_levels(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


@query(fx.sql("SELECT DISTINCT d AS v FROM q", fx.closure(), "i AS (SELECT s, d FROM base JOIN l a ON s = a.v JOIN l b ON d = b.v WHERE a.scc = b.scc)", "q AS (SELECT (SELECT min(v) FROM l WHERE scc = (SELECT scc FROM l GROUP BY scc ORDER BY count(*) DESC, scc LIMIT 1)) AS d UNION SELECT i.d FROM q JOIN i ON i.s = q.d)"))
def reach_confined(spark, sf_dir):
    g = fx.base(spark, sf_dir)
    labels = cut(strategies.scc(g))
    top = coll.extreme(report.sizes(labels).select(F.col("scc").alias("key"), F.col("size").alias("value"))).select(F.col("key").alias("v"))
    return traverse.reach(g.edges, top, within=labels)


@query(fx.sql("SELECT DISTINCT d AS v FROM q", "q AS (SELECT CAST(0 AS BIGINT) AS d UNION SELECT base.d FROM q JOIN base ON base.s = q.d)"))
def dfs_reach(spark, sf_dir):
    return traverse.reach(fx.base(spark, sf_dir).edges, _first_vertex(spark))


_LEVELS = (_bfs(), "lv AS (SELECT v, l AS level FROM q)", "dn AS (SELECT s, d, a.level FROM base JOIN lv a ON s = a.v JOIN lv b ON d = b.v WHERE b.level = a.level + 1)")


@query(fx.sql("SELECT s AS src, d AS dst, level FROM dn", *_LEVELS))
def down_edges(spark, sf_dir):
    e = fx.base(spark, sf_dir).edges
    return traverse.down_edges(e, cut(traverse.bfs(e, _first_vertex(spark))))


@query(fx.sql("SELECT lv.v, lv.level, max(o.level) AS value FROM lv JOIN t ON lv.v = t.v JOIN lv o ON o.v = t.w GROUP BY ALL", *_LEVELS, "t AS (SELECT v, v AS w FROM lv UNION SELECT t.v, dn.d FROM t JOIN dn ON dn.s = t.w)"))
def level_fold(spark, sf_dir):
    e = fx.base(spark, sf_dir).edges
    levels = cut(traverse.bfs(e, _first_vertex(spark)))
    return traverse.fold_levels(e, levels, lambda v, level: level, F.max, F.greatest)


_TOPO = ("dag AS (SELECT DISTINCT a.scc AS s, b.scc AS d FROM base JOIN l a ON s = a.v JOIN l b ON d = b.v WHERE a.scc <> b.scc)", "tp AS (SELECT DISTINCT scc AS v, 0 AS l FROM l WHERE scc NOT IN (SELECT d FROM dag) UNION SELECT dag.d, l + 1 FROM tp JOIN dag ON dag.s = tp.v)")


@query(fx.sql("SELECT v, CAST(max(l) AS BIGINT) AS level FROM tp GROUP BY v", fx.closure(), *_TOPO))
def condensation_levels(spark, sf_dir):
    g = fx.base(spark, sf_dir)
    return dynamic.condensation_levels(g.edges, cut(strategies.scc(g)))


@query("SELECT DISTINCT l_partkey AS v, 0::BIGINT AS level FROM lineitem UNION ALL SELECT DISTINCT l_suppkey + 1000000, 1 FROM lineitem")
def topo_levels(spark, sf_dir):
    g = fx.supply(spark, sf_dir)
    return traverse.topological_levels(g.edges, g.vertices).select(fx.supply_key("v").alias("v"), "level")


# --- trimming and splitting -------------------------------------------------------------------------


def _state(g: Graph) -> tuple[DataFrame, DataFrame]:
    active = cut(g.vertices.select("v", F.lit(0).cast("long").alias("color")))
    return active, cut(trim.restrict(g.edges, active))


@query(fx.sql("SELECT v FROM vx WHERE v IN (SELECT s FROM base WHERE s <> d) AND v IN (SELECT d FROM base WHERE s <> d)"))
def trim1_once(spark, sf_dir):
    return trim.trim1_once(*_state(fx.base(spark, sf_dir)))[0].select("v")


_SURVIVE = ("cy AS (SELECT s AS v FROM r WHERE s = d)", "tv AS (SELECT v FROM vx WHERE (v IN (SELECT v FROM cy) OR v IN (SELECT d FROM r WHERE s IN (SELECT v FROM cy))) AND (v IN (SELECT v FROM cy) OR v IN (SELECT s FROM r WHERE d IN (SELECT v FROM cy))))")


@query(fx.sql("SELECT v FROM tv", fx.closure(), *_SURVIVE))
def trim1_fixpoint(spark, sf_dir):
    return trim.trim1(*_state(fx.base(spark, sf_dir)))[0].select("v")


_TRIMMED = ("te AS (SELECT s, d FROM base WHERE s <> d AND s IN (SELECT v FROM tv) AND d IN (SELECT v FROM tv))", "po AS (SELECT s AS v, min(d) AS n FROM te GROUP BY s HAVING count(DISTINCT d) = 1)", "pi AS (SELECT d AS v, min(s) AS n FROM te GROUP BY d HAVING count(DISTINCT s) = 1)")


def _pairs_sql(select: str) -> str:
    return fx.sql(select, fx.closure(), *_SURVIVE, *_TRIMMED)


def _trimmed_edges(spark, sf_dir) -> DataFrame:
    return trim.trim1(*_state(fx.base(spark, sf_dir)))[1]


@query(_pairs_sql("SELECT x.v AS a, x.n AS b FROM po x JOIN po y ON x.n = y.v AND y.n = x.v WHERE x.v < x.n"))
def trim2_out(spark, sf_dir):
    return trim.trim2_out(_trimmed_edges(spark, sf_dir))


@query(_pairs_sql("SELECT x.v AS a, x.n AS b FROM pi x JOIN pi y ON x.n = y.v AND y.n = x.v WHERE x.v < x.n"))
def trim2_in(spark, sf_dir):
    return trim.trim2_in(_trimmed_edges(spark, sf_dir))


@query(_pairs_sql("SELECT x.v AS a, x.n AS b FROM po x JOIN po y ON x.n = y.v AND y.n = x.v WHERE x.v < x.n UNION SELECT x.v, x.n FROM pi x JOIN pi y ON x.n = y.v AND y.n = x.v WHERE x.v < x.n"))
def trim2_either(spark, sf_dir):
    return trim.trim2(_trimmed_edges(spark, sf_dir))


@query(_pairs_sql("SELECT DISTINCT least(po.v, po.n) AS a, greatest(po.v, po.n) AS b FROM po JOIN pi ON po.v = pi.v AND po.n = pi.n WHERE po.n IN (SELECT v FROM po UNION SELECT v FROM pi)"))
def trim2_two_phase(spark, sf_dir):
    return trim.trim2_two_phase(_trimmed_edges(spark, sf_dir))


@query(fx.sql("SELECT v, CAST(v IN (SELECT v FROM f) AS INTEGER) AS fw, CAST(v IN (SELECT v FROM g) AS INTEGER) AS bw FROM vx", "f AS (SELECT CAST(0 AS BIGINT) AS v UNION SELECT base.d FROM f JOIN base ON base.s = f.v)", "g AS (SELECT CAST(0 AS BIGINT) AS v UNION SELECT base.s FROM g JOIN base ON base.d = g.v)"))
def fwbw_split(spark, sf_dir):
    active, edges = _state(fx.base(spark, sf_dir))
    classes, _ = split.fwbw(active, edges, split.pivots(active))
    return classes.select("v", F.col("fw").cast("int").alias("fw"), F.col("bw").cast("int").alias("bw"))


@query(fx.sql("SELECT v, least(v, coalesce(min(d), v)) AS label FROM vx LEFT JOIN r ON s = v GROUP BY v", fx.closure()))
def min_label_forward(spark, sf_dir):
    return split.min_label_forward(*_state(fx.base(spark, sf_dir)))


@query(fx.sql("SELECT v, least(v, coalesce(min(d), v)) AS label FROM vx LEFT JOIN r ON s = v GROUP BY v", fx.closure("SELECT s, d FROM base UNION SELECT d, s FROM base")))
def wcc_labels(spark, sf_dir):
    return split.weak_components(*_state(fx.base(spark, sf_dir)))


@query("SELECT c_nationkey::BIGINT AS color, min(c_custkey) AS pivot, count(*) AS n FROM customer GROUP BY 1")
def color_pivots(spark, sf_dir):
    active = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("v"), F.col("c_nationkey").cast("long").alias("color"))
    return split.pivots(active).join(split.color_sizes(active), "color")


@query("SELECT c_custkey AS v FROM customer WHERE c_nationkey = 3")
def color_members(spark, sf_dir):
    return split.members_of(fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("v"), F.col("c_nationkey").alias("color")), 3)


@query()
def trim2_repeated(spark, sf_dir):
    """Pairs taken out until none is left; which ones a pass takes is tested by brute force."""
    active, edges = _state(fx.base(spark, sf_dir))
    return trim.trim2_repeated(active, edges)[2]


# --- components by every plan ---------------------------------------------------------------------------


def _scc_query(name: str, strategy: str, **how) -> None:
    def run(spark, sf_dir):
        return strategies.scc(fx.base(spark, sf_dir), strategy, **how)

    run.__name__ = name
    query(fx.sql(_LABELS, fx.closure()))(run)


for _name, _strategy in (("scc_m0_baseline", "baseline"), ("scc_m1_global_fb", "global_fb"), ("scc_m2_full", "full"), ("scc_m3_tarjan", "tarjan"), ("scc_m4_trim_tarjan", "trim_tarjan"), ("scc_coloring", "coloring")):
    _scc_query(_name, _strategy)
_scc_query("scc_m2_degree_pivot", "full", pivot="degree")


#: The same plans with no part ever finished in a task: every step is a join, but that "auto" first
#: merges components of blocks of a graph that has more than one block.
for _strategy in ("baseline", "global_fb", "full", "tarjan", "trim_tarjan", "coloring", "auto"):
    _scc_query(f"scc_{_strategy}_distributed", _strategy, local_rows=0)


@query("SELECT DISTINCT l_partkey AS v, l_partkey AS scc FROM lineitem UNION ALL SELECT DISTINCT l_suppkey + 1000000, l_suppkey + 1000000 FROM lineitem")
def scc_acyclic(spark, sf_dir):
    return strategies.scc(fx.supply(spark, sf_dir)).select(fx.supply_key("v").alias("v"), fx.supply_key("scc").alias("scc"))


@query("SELECT DISTINCT user_id AS v, (SELECT min(user_id) FROM events) AS scc FROM events")
def scc_single(spark, sf_dir):
    return strategies.scc(fx.multigraph(spark, sf_dir))


def _labels(spark, sf_dir) -> DataFrame:
    return cut(strategies.scc(fx.base(spark, sf_dir)))


@query(fx.sql("SELECT count(DISTINCT scc) AS n_sccs FROM l", fx.closure()))
def scc_count(spark, sf_dir):
    return report.count(_labels(spark, sf_dir))


@query(fx.sql("SELECT scc, count(*) AS size FROM l GROUP BY scc", fx.closure()))
def scc_sizes(spark, sf_dir):
    return report.sizes(_labels(spark, sf_dir))


@query(fx.sql("SELECT size, count(*) AS n_sccs FROM (SELECT scc, count(*) AS size FROM l GROUP BY scc) GROUP BY size", fx.closure()))
def scc_size_histogram(spark, sf_dir):
    return report.histogram(_labels(spark, sf_dir))


@query(fx.sql("SELECT v, dense_rank() OVER (ORDER BY scc) - 1 AS label FROM l", fx.closure()))
def scc_export_dense(spark, sf_dir):
    return report.export(_labels(spark, sf_dir))


@query(fx.sql("SELECT scc, size, v // 100000 AS part, string_agg(v, ' ' ORDER BY v) AS members FROM l JOIN (SELECT scc, count(*) AS size FROM l GROUP BY scc HAVING count(*) = 3) USING (scc) GROUP BY ALL", fx.closure()))
def scc_members_of_size(spark, sf_dir):
    return report.member_lists(_labels(spark, sf_dir), size=3)


@query(fx.sql("SELECT scc, size, v // 100000 AS part, string_agg(v, ' ' ORDER BY v) AS members FROM l JOIN (SELECT scc, count(*) AS size FROM l GROUP BY scc HAVING count(*) >= 2) USING (scc) GROUP BY ALL", fx.closure()))
def scc_members_min_size(spark, sf_dir):
    return report.member_lists(_labels(spark, sf_dir), min_size=2)


@query(fx.sql("SELECT 'trim1' AS phase, (SELECT count(*) FROM vx) - (SELECT count(*) FROM tv) AS resolved UNION ALL SELECT 'all', count(*) FROM vx", fx.closure(), *_SURVIVE))
def scc_phases(spark, sf_dir):
    """What the first phase resolved, and all of them together."""
    phases = strategies.full(fx.base(spark, sf_dir), stop=0).phases.frame(spark).filter("millis >= 0")
    return phases.filter("step = 0").select("phase", "resolved").union(phases.agg(F.lit("all"), F.sum("resolved")))


# --- condensation and batches ---------------------------------------------------------------------------------


@query(fx.sql("SELECT a.scc AS src, b.scc AS dst FROM base JOIN l a ON s = a.v JOIN l b ON d = b.v WHERE a.scc <> b.scc", fx.closure()))
def condensation_edges(spark, sf_dir):
    return dynamic.condense(fx.base(spark, sf_dir).edges, _labels(spark, sf_dir))


@query(fx.sql("SELECT a.scc AS src, b.scc AS dst, count(*) AS copies FROM base JOIN l a ON s = a.v JOIN l b ON d = b.v WHERE a.scc <> b.scc GROUP BY ALL", fx.closure()))
def condensation_mult(spark, sf_dir):
    return dynamic.condense_counted(fx.base(spark, sf_dir).edges, _labels(spark, sf_dir))


_INSERTED, _DELETED = fx.sql(_LABELS, fx.closure(fx.INSERTED)), fx.sql(_LABELS, fx.closure(fx.DELETED))


@query(_INSERTED)
def insert_m5(spark, sf_dir):
    return dynamic.insert_naive(fx.base(spark, sf_dir), fx.insertions(spark, sf_dir))


def _batch_query(name: str, sql: str, apply, batch) -> None:
    def run(spark, sf_dir):
        placed = fx.placed_orders(spark, sf_dir)
        g = fx.base(spark, sf_dir, placed)
        return apply(g, cut(strategies.scc(g)), batch(spark, sf_dir, placed))

    run.__name__ = name
    query(sql)(run)


_batch_query("insert_m6", _INSERTED, dynamic.insert_condensed, fx.insertions)
_batch_query("insert_m7", _INSERTED, dynamic.insert_levels, fx.insertions)
_batch_query("insert_m11", _INSERTED, dynamic.insert_touched, fx.insertions)
_batch_query("delete_m9", _DELETED, dynamic.delete_affected, fx.deletions)
for _name, _apply in (("m6", dynamic.insert_condensed), ("m7", dynamic.insert_levels), ("m11", dynamic.insert_touched)):
    _batch_query(f"insert_{_name}_distributed", _INSERTED, functools.partial(_apply, local_rows=0), fx.insertions)
for _name, _apply in (("m9", dynamic.delete_affected), ("m10", dynamic.delete_confined)):
    _batch_query(f"delete_{_name}_distributed", _DELETED, functools.partial(_apply, local_rows=0), fx.deletions)
_batch_query("delete_m10", _DELETED, dynamic.delete_confined, fx.deletions)


def _mixed(spark, sf_dir, placed: DataFrame) -> DataFrame:
    return fx.deletions(spark, sf_dir, placed).select(F.lit("-").alias("op"), "src", "dst").union(fx.insertions(spark, sf_dir, placed).select(F.lit("+").alias("op"), "src", "dst"))


@query(fx.sql(_LABELS, fx.closure(fx.MIXED)))
def mixed_batch(spark, sf_dir):
    placed = fx.placed_orders(spark, sf_dir)
    g = fx.base(spark, sf_dir, placed)
    return dynamic.apply_batch(g, cut(strategies.scc(g)), _mixed(spark, sf_dir, placed))[1]


def _kept_state(spark, sf_dir) -> tuple[Graph, DataFrame, DataFrame]:
    """Labels after the mixed batch, by way of the kept condensation, which goes along."""
    placed = fx.placed_orders(spark, sf_dir)
    g = fx.base(spark, sf_dir, placed)
    labels = cut(strategies.scc(g, layers=fx.DAYS))
    ends = cut(dynamic.relabelled(g.edges, labels))
    state = cut(dynamic.counted(ends))
    return g, *dynamic.apply_to_state(ends, state, labels, _mixed(spark, sf_dir, placed), layers=fx.DAYS)


@query(fx.sql(_LABELS, fx.closure(fx.MIXED)))
def mixed_batch_on_state(spark, sf_dir):
    return _kept_state(spark, sf_dir)[1]


@query(fx.sql("SELECT a.scc AS src, b.scc AS dst, count(*) AS copies FROM e JOIN l a ON s = a.v JOIN l b ON d = b.v WHERE a.scc <> b.scc GROUP BY ALL", fx.closure(f"SELECT s, d FROM ({fx.MIXED})")).replace(" FROM e JOIN l a", " FROM (SELECT s, d FROM base WHERE (s, d) NOT IN (SELECT (s, d) FROM del) UNION ALL SELECT s, d FROM ins) JOIN l a"))
def kept_condensation(spark, sf_dir):
    """The condensation that was kept through a mixed batch, copies counted."""
    return _kept_state(spark, sf_dir)[2]


@query("SELECT DISTINCT user_id AS v, (SELECT min(user_id) FROM events) AS scc FROM events")
def insert_single(spark, sf_dir):
    """A batch into a graph of one component changes nothing."""
    g = fx.multigraph(spark, sf_dir)
    labels = cut(strategies.scc(g))
    return dynamic.insert_condensed(g, labels, g.reversed().edges.select("src", "dst"))


_CROSS = ("lv AS (SELECT v, CAST(max(l) AS BIGINT) AS level FROM tp GROUP BY v)", "cx AS (SELECT least(x.level, y.level) AS lo, greatest(x.level, y.level) AS hi FROM ins JOIN l a ON s = a.v JOIN l b ON d = b.v JOIN lv x ON x.v = a.scc JOIN lv y ON y.v = b.scc WHERE a.scc <> b.scc)")


@query(fx.sql("SELECT level, count(lo) AS spans FROM (SELECT DISTINCT level FROM lv) LEFT JOIN cx ON level BETWEEN lo AND hi GROUP BY level", fx.closure(), *_TOPO, *_CROSS))
def affected_levels(spark, sf_dir):
    g, labels = fx.base(spark, sf_dir), _labels(spark, sf_dir)
    return dynamic.affected_levels(cut(dynamic.condensation_levels(g.edges, labels)), dynamic.condense(fx.insertions(spark, sf_dir), labels))


@query(fx.sql("SELECT DISTINCT a.scc AS v FROM ins JOIN l a ON s = a.v JOIN l b ON d = b.v WHERE a.scc <> b.scc", fx.closure()))
def touched_components(spark, sf_dir):
    return dynamic.touched(_labels(spark, sf_dir), fx.insertions(spark, sf_dir))


@query(fx.sql("SELECT DISTINCT a.scc FROM del JOIN l a ON s = a.v JOIN l b ON d = b.v WHERE a.scc = b.scc", fx.closure()))
def affected_sccs(spark, sf_dir):
    return dynamic.affected(_labels(spark, sf_dir), fx.deletions(spark, sf_dir))


@query(fx.sql("SELECT s AS src, d AS dst FROM base EXCEPT SELECT s, d FROM del"))
def delete_survivors(spark, sf_dir):
    return dynamic.survivors(fx.base(spark, sf_dir).edges, fx.deletions(spark, sf_dir))


@query(fx.sql("SELECT s AS src, d AS dst FROM (SELECT s, d, row_number() OVER (ORDER BY s, d) AS n FROM base) WHERE n % 4 = 0"))
def sample_every_kth(spark, sf_dir):
    return dynamic.every_kth(fx.base(spark, sf_dir).edges, 4)


_GAPS = ("gp AS (SELECT s, d, n - d - 1 AS room FROM (SELECT s, d, lead(d) OVER (PARTITION BY s ORDER BY d) AS n FROM base) WHERE n > d + 1)", "dr AS (SELECT s, d, room, unnest(range(1, ceil(room * (2.0::DOUBLE * 1000 / (SELECT sum(room) FROM gp)))::BIGINT + 1)) AS i FROM gp)")


@query(fx.sql("SELECT DISTINCT g AS src, s AS dst FROM (SELECT s, d + 1 + (s * 7919 + d * 104729 + i * 1299709 + 5) % room AS g FROM dr) w WHERE g <> s AND NOT EXISTS (SELECT 1 FROM base b WHERE b.s = g AND b.d = w.s)", *_GAPS))
def gen_insert_candidates(spark, sf_dir):
    return dynamic.insert_candidates(fx.base(spark, sf_dir).edges, 1000, 5)


@query(fx.sql("SELECT f, (f * m)::BIGINT AS inserted, (f * m)::BIGINT AS deleted, true AS apart FROM (SELECT count(*)::DOUBLE AS m FROM base), (VALUES (0.015625), (0.0625), (0.125)) t(f)".replace("(f * m)::BIGINT", "floor(f * m)::BIGINT").replace("SELECT f,", "SELECT f::DOUBLE AS fraction,")))
def gen_batches(spark, sf_dir):
    """How many edges each batch inserts and deletes; inserted ones are new, deleted ones old."""
    e = fx.base(spark, sf_dir).edges
    out = None
    for f, (new, old) in dynamic.make_batches(e, (0.015625, 0.0625, 0.125), 0.2, 3).items():
        apart = new.join(e, ["src", "dst"], "left_semi").isEmpty() and old.join(e, ["src", "dst"], "left_anti").isEmpty()
        row = new.agg(F.lit(f).alias("fraction"), F.count("*").alias("inserted")).join(old.agg(F.count("*").alias("deleted"))).withColumn("apart", F.lit(apart))
        out = row if out is None else out.union(row)
    return out


@query(fx.sql("SELECT s AS src, d AS dst FROM base ORDER BY md5('3:' || s || ':' || d), s, d LIMIT 100"))
def gen_delete_batch(spark, sf_dir):
    return dynamic.hash_ordered(fx.base(spark, sf_dir).edges, 100, 3)


# --- collections -------------------------------------------------------------------------------------------------------


def _two_sets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    b = fx.base(spark, sf_dir).edges
    return b.select(F.col("src").alias("x")).distinct(), b.select(F.col("dst").alias("x")).distinct()


_SETS = "SELECT x FROM (SELECT s AS x FROM base {} SELECT d FROM base)"


@query(fx.sql(_SETS.format("UNION")))
def set_union(spark, sf_dir):
    return coll.union(*_two_sets(spark, sf_dir))


@query(fx.sql(_SETS.format("INTERSECT")))
def set_intersect(spark, sf_dir):
    return coll.intersection(*_two_sets(spark, sf_dir))


@query(fx.sql(_SETS.format("EXCEPT")))
def set_difference(spark, sf_dir):
    return coll.difference(*_two_sets(spark, sf_dir))


@query(fx.sql("SELECT NOT EXISTS (SELECT s FROM base EXCEPT SELECT d FROM base) AS is_subset"))
def set_subset(spark, sf_dir):
    return coll.is_subset(*_two_sets(spark, sf_dir))


@query(fx.sql("SELECT c_custkey AS x, c_custkey IN (SELECT s FROM base) AS found FROM customer"))
def set_contains(spark, sf_dir):
    return coll.contains(_two_sets(spark, sf_dir)[0], fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("x")))


def _sequence(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("x"))


@query("SELECT (SELECT max(event_id) + min(event_id) FROM events) - event_id AS pos, user_id AS x FROM events")
def seq_reverse(spark, sf_dir):
    return coll.reversed_sequence(_sequence(spark, sf_dir), "pos")


@query("SELECT user_id AS x, min(event_id) AS pos FROM events GROUP BY 1")
def order_dedup(spark, sf_dir):
    return coll.first_appearances(_sequence(spark, sf_dir), "x", "pos")


@query("""WITH b AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events) SELECT event_id AS pos, user_id AS x FROM events, b WHERE event_id < hi
UNION ALL SELECT lo - 1, -1 FROM b UNION ALL SELECT hi, -2 FROM b""")
def deque_push_pop(spark, sf_dir):
    one = lambda x: spark.sql(f"SELECT 0L AS pos, {x}L AS x")
    shorter = coll.pop(_sequence(spark, sf_dir), "pos")
    return coll.push_back(coll.push_front(shorter, one(-1), "pos"), one(-2), "pos")


def _map(spark, sf_dir) -> DataFrame:
    return fx.base(spark, sf_dir).edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("value"))


_MAP = "mp AS (SELECT s AS key, count(*) AS value FROM base GROUP BY s)"


@query(fx.sql("SELECT key, value FROM mp ORDER BY value DESC, key LIMIT 1", _MAP))
def map_max_key(spark, sf_dir):
    return coll.extreme(_map(spark, sf_dir))


@query(fx.sql("SELECT key, value FROM mp ORDER BY value, key LIMIT 1", _MAP))
def map_min_key(spark, sf_dir):
    return coll.extreme(_map(spark, sf_dir), largest=False)


@query(fx.sql("SELECT c_custkey AS key, coalesce(value, -1) AS value FROM customer LEFT JOIN mp ON key = c_custkey", _MAP))
def map_default(spark, sf_dir):
    return coll.get(_map(spark, sf_dir), fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), -1)


@query(fx.sql("SELECT key, CAST(sum(value) AS BIGINT) AS value FROM (SELECT * FROM mp UNION ALL SELECT d, count(*) FROM base GROUP BY d) GROUP BY key", _MAP))
def map_add(spark, sf_dir):
    more = fx.base(spark, sf_dir).edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("value"))
    return coll.add(_map(spark, sf_dir), more)


@query(fx.sql("SELECT key, CASE WHEN key % 3 = 0 THEN 0 ELSE value END AS value FROM mp WHERE key % 5 <> 0", _MAP))
def map_put_remove(spark, sf_dir):
    m = _map(spark, sf_dir)
    new = m.filter("key % 3 = 0").select("key", F.lit(0).cast("long").alias("value"))
    return coll.remove(coll.put(m, new), m.filter("key % 5 = 0").select("key"))


@query("""SELECT c_nationkey, sum(x) AS total, product(x) AS product, min(x) AS least, max(x) AS most, bool_and(c_acctbal > -500) AS every, bool_or(c_acctbal > 9900) AS some
    FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN -1.0 ELSE 1.0 END::DOUBLE * CASE c_custkey WHEN 3 THEN 0.5 WHEN 5 THEN 4 ELSE 1 END::DOUBLE AS x FROM customer) GROUP BY 1""")
def reductions(spark, sf_dir):
    """Over all customers; of factors whose product is exact in any order: signs, a half, a four."""
    c = fx.table(spark, sf_dir, "customer")
    x = F.when(F.col("c_acctbal") < 0, -1.0).otherwise(1.0) * F.when(F.col("c_custkey") == 3, 0.5).when(F.col("c_custkey") == 5, 4.0).otherwise(1.0)
    both = c.select("c_nationkey", x.alias("x"), (F.col("c_acctbal") > -500).alias("low"), (F.col("c_acctbal") > 9900).alias("high"))
    every = coll.reductions(both, "x", "low", "c_nationkey").drop("some")
    return every.join(coll.reductions(both, "x", "high", "c_nationkey").select("c_nationkey", "some"), "c_nationkey")


@query(fx.sql("SELECT s // 32768 AS bucket, count(DISTINCT s) AS members FROM base GROUP BY 1"))
def bitmap_members(spark, sf_dir):
    sets = coll.bitmaps(_two_sets(spark, sf_dir)[0], "x")
    return sets.select((F.col("bucket") - 1).alias("bucket"), F.bitmap_count("bits").alias("members"))


@query("SELECT c_custkey AS v, (c_custkey >> 3) & 1 AS bit, c_custkey | 16 AS with_bit FROM customer")
def bit_tests(spark, sf_dir):
    v = F.col("c_custkey")
    return fx.table(spark, sf_dir, "customer").select(v.alias("v"), numeric.bit(v, F.lit(3)).cast("long").alias("bit"), numeric.with_bit(v, F.lit(4)).alias("with_bit"))


@query("""WITH a AS (SELECT c_custkey AS v, c_custkey + 1 AS x FROM customer), b AS (SELECT v, xor(x, (x << 13) & 4294967295) AS x FROM a), c AS (SELECT v, xor(x, x >> 17) AS x FROM b)
SELECT v, xor(x, (x << 5) & 4294967295) & 4294967295 AS state FROM c""")
def random_states(spark, sf_dir):
    v = F.col("c_custkey")
    return fx.table(spark, sf_dir, "customer").select(v.alias("v"), numeric.xorshift32(v + 1).alias("state"))


def _left(x: str, n: int) -> str:
    """x shifted left by n within 64 signed bits, without overflow on the way."""
    return f"((({x} & {(1 << 63 - n) - 1}) << {n}) + CASE WHEN ({x} >> {63 - n}) & 1 = 1 THEN -9223372036854775807 - 1 ELSE 0 END)"


@query(f"""WITH a AS (SELECT c_custkey AS v, (c_custkey + 1) * 4611686018427 AS x FROM customer), b AS (SELECT v, xor(x, {_left("x", 13)}) AS x FROM a), c AS (SELECT v, xor(x, x >> 7) AS x FROM b)
SELECT v, xor(x, {_left("x", 17)}) AS state FROM c""")
def random_states_64(spark, sf_dir):
    v = F.col("c_custkey")
    return fx.table(spark, sf_dir, "customer").select(v.alias("v"), numeric.xorshift64((v + 1) * F.lit(4611686018427)).alias("state"))


@query("SELECT true AS inside, true AS centred, true AS below, count(*) AS n FROM customer")
def random_draws(spark, sf_dir):
    """Uniform draws lie in [0, 1) around a half, and bounded ones below their bound."""
    c = fx.table(spark, sf_dir, "customer").select(numeric.random_uniform(F.col("c_custkey"), 3).alias("u"), numeric.random_below(F.col("c_custkey"), 4, 10).alias("k"))
    return c.agg(F.bool_and((F.col("u") >= 0) & (F.col("u") < 1)).alias("inside"), (F.abs(F.avg("u") - 0.5) < 2 / F.sqrt(F.count("*"))).alias("centred"), F.bool_and(F.col("k").between(0, 9)).alias("below"), F.count("*").alias("n"))


# --- streaming -----------------------------------------------------------------------------------------------------------


@query(fx.sql(_LABELS, fx.closure(fx.MIXED)))
def stream_maintained(spark, sf_dir):
    """Deletions in one micro-batch, insertions in two more; the labels at the end."""
    placed = fx.placed_orders(spark, sf_dir)
    g, folder, source = fx.base(spark, sf_dir, placed), _folder(spark), _folder(spark)
    maintain.start_state(g, strategies.scc(g), folder)
    mixed = _mixed(spark, sf_dir, placed)
    for part in ("op = '-'", "op = '+' and src % 2 = 0", "op = '+' and src % 2 = 1"):
        mixed.filter(part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("op string, src long, dst long").option("maxFilesPerTrigger", 1).parquet(source)
    maintain.maintain(stream, folder, _folder(spark)).awaitTermination()
    return maintain.current(spark, folder)[1].select("v", "scc")
