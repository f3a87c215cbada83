"""Graphs derived from the given tables, as DataFrames and as the SQL that checks them.

The hand-over graph holds all orders: an order's customer hands over to the customer of the next
order of the same priority, in a layer for the weekday of the order. A vertex is a customer on a
weekday, so each weekday is a graph of its own and one graph holds them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, dense_index
from ..loop import cut

#: Layers: the days of a week.
DAYS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _followed(rows: DataFrame, order: str, value: str, steps: int, name: str) -> DataFrame:
    """rows with the value `steps` rows later in the order of a unique column, by numbering and
    a join: no window over the whole table."""
    placed = cut(dense_index(rows, order, "_at"))
    later = placed.select((F.col("_at") - steps).alias("_at"), F.col(value).alias(name))
    return placed.join(later, "_at").drop("_at")


#: Orders later that hand_overs() may ask for.
STEPS = 2


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with priority and customer of the next STEPS orders (priority_1, custkey_1, ...),
    null behind the last, and whether these are of the order's own priority (same_1, ...): made once
    for a query, of which hand_overs() reads what it needs. Range partitions are read in order, each
    row with those that follow it; only a partition's first and last STEPS rows meet those of the
    others. Of the later priorities only those that differ are written."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"))
    order = ["priority", "date", "key"]
    own = ["key", "custkey", "priority", F.weekday("date").cast("byte").alias("weekday"), F.dayofmonth("date").cast("byte").alias("day"), F.expr("coalesce(status = 'P' and priority = '1-URGENT', false)").alias("back")]
    rows = o.repartitionByRange(*order).sortWithinPartitions(*order).select(*own, F.spark_partition_id().alias("_p"))
    steps = range(1, STEPS + 1)
    typed = lambda c: rows.schema[c].dataType.simpleString()
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), *(f"same_{k} boolean, other_{k} {typed('priority')}, custkey_{k} {typed('custkey')}" for k in steps), "_at long, _last boolean"])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        held, begun = None, 0

        def out(t: pa.Table, n: int, last: bool):
            cols = [t.column(c).slice(0, n) for c in t.column_names]
            priority, custkey = t.column("priority"), t.column("custkey")
            for k in steps:
                if last:
                    cols += [pa.nulls(n, pa.bool_()), pa.nulls(n, priority.type), pa.nulls(n, custkey.type)]
                else:
                    later = priority.slice(k, n)
                    same = pc.fill_null(pc.equal(later, priority.slice(0, n)), False).combine_chunks()
                    cols += [same, later.take(pa.array(np.arange(n), mask=same.to_numpy(zero_copy_only=False))), custkey.slice(k, n)]
            cols += [pa.array(np.arange(begun, begun + n)), pa.array(np.full(n, last))]
            return pa.table(cols, names=names).to_batches()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            n = held.num_rows - STEPS
            if n > 0:
                yield from out(held, n, False)
                held, begun = held.slice(n), begun + n
        if held is not None and held.num_rows:
            yield from out(held, held.num_rows, True)

    found = cut(rows.mapInArrow(run, schema))
    ends = Window.orderBy("_p", "_at")  # 2 * STEPS rows of a partition
    met = found.filter(f"_at < {STEPS} or _last")
    for k in steps:
        found = found.withColumn(f"priority_{k}", F.when(F.col(f"same_{k}"), F.col("priority")).otherwise(F.col(f"other_{k}")))
        met = met.withColumns({f"{c}_{k}": F.lead(c, k).over(ends) for c in ("priority", "custkey")})
        met = met.withColumn(f"same_{k}", F.coalesce(F.col(f"priority_{k}") == F.col("priority"), F.lit(False)))
    keep = [*(c for c in rows.columns if c != "_p"), *(f"{c}_{k}" for k in steps for c in ("same", "priority", "custkey"))]
    return found.filter("not _last").select(keep).union(met.filter("_last").select(keep))


def hand_overs(spark: SparkSession, sf_dir: str, steps: int = 1, placed: DataFrame | None = None) -> DataFrame:
    """(src, dst, day, back): the customers of an order and of the one `steps` later of its
    priority, on the order's weekday, and whether the order is urgent and in progress; loops left
    out. placed: placed_orders(), where they are there already."""
    o = placed_orders(spark, sf_dir) if placed is None else placed
    rows = o.filter(f"same_{steps} and custkey_{steps} <> custkey")
    place = lambda c: F.col(c) * DAYS + F.col("weekday")
    return rows.select(place("custkey").alias("src"), place(f"custkey_{steps}").alias("dst"), "day", "back")


def base_edges(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> DataFrame:
    """All hand-overs; urgent orders in progress are handed back, too."""
    h = hand_overs(spark, sf_dir, placed=placed)
    return h.select("src", "dst").union(h.filter("back").select("dst", "src")).distinct()


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer on every weekday."""
    days = F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1)))
    return table(spark, sf_dir, "customer").select("c_custkey", days.alias("day")).select((F.col("c_custkey") * DAYS + F.col("day")).alias("v"))


def base(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> Graph:
    """The hand-over graph over all orders, and all customers on all weekdays."""
    return Graph(cut(base_edges(spark, sf_dir, placed)), vertices(spark, sf_dir))


def multigraph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users handing over to the next event's user: copies and loops stay; eid in that order."""
    e = table(spark, sf_dir, "events").select(F.struct("ts", "event_id").alias("o"), "user_id")
    rows = _followed(e, "o", "user_id", 1, "dst").select(F.col("user_id").alias("src"), "dst", F.col("o.event_id").alias("eid"))
    return Graph(cut(rows), e.select(F.col("user_id").alias("v")).distinct())


def insertions(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> DataFrame:
    """A batch: hand-overs two orders on, of the first day of each month."""
    return cut(hand_overs(spark, sf_dir, 2, placed).filter("day = 1").select("src", "dst").distinct())


def deletions(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> DataFrame:
    """A batch: the hand-overs of the fifteenth of each month."""
    return cut(hand_overs(spark, sf_dir, 1, placed).filter("day = 15").select("src", "dst").distinct())


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts to suppliers: a bipartite graph without cycles. Parts are even vertices and suppliers
    odd ones, so a part and a supplier are never one vertex, whatever their keys."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()
    return Graph(e, e.select(F.explode(F.array("src", "dst")).alias("v")).distinct())


def supply_key(v: str) -> Column:
    """A vertex of supply() as its SQL names it: a part's key, a supplier's from 1 000 000 on. Both
    may give the same number; these stay two rows."""
    return F.shiftright(v, 1) + F.when(F.col(v).bitwiseAND(1) == 1, 1_000_000).otherwise(0)


# --- the same in SQL ---------------------------------------------------------------------------

CTE = """h AS (SELECT o_custkey c, lead(o_custkey) OVER w n, lead(o_custkey, 2) OVER w nn, isodow(o_orderdate) - 1 AS g, day(o_orderdate) AS day, o_orderstatus AS status, o_orderpriority AS priority
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)),
hb AS (SELECT c * 7 + g AS s, n * 7 + g AS d, day, status, priority FROM h WHERE n IS NOT NULL AND c <> n),
base AS (SELECT s, d FROM hb UNION SELECT d, s FROM hb WHERE status = 'P' AND priority = '1-URGENT'),
vx AS (SELECT c_custkey * 7 + i AS v FROM customer, range(7) t(i)),
ins AS (SELECT DISTINCT c * 7 + g AS s, nn * 7 + g AS d FROM h WHERE nn IS NOT NULL AND c <> nn AND day = 1),
del AS (SELECT DISTINCT s, d FROM hb WHERE day = 15),
multi AS (SELECT * FROM (SELECT user_id s, lead(user_id) OVER (ORDER BY ts, event_id) d, event_id eid FROM events) WHERE d IS NOT NULL)"""

BASE, INSERTED, DELETED = "SELECT s, d FROM base", "SELECT s, d FROM base UNION SELECT s, d FROM ins", "SELECT s, d FROM base EXCEPT SELECT s, d FROM del"
MIXED = f"({DELETED}) UNION SELECT s, d FROM ins"


def closure(edges: str = BASE, name: str = "") -> str:
    """CTEs e, r (transitive closure) and l(v, scc) of an edge query; name is put behind."""
    return f"""e{name} AS ({edges}), r{name} AS (SELECT s, d FROM e{name} UNION SELECT r{name}.s, e{name}.d FROM r{name} JOIN e{name} ON e{name}.s = r{name}.d),
m{name} AS (SELECT a.s AS v, min(a.d) AS c FROM r{name} a JOIN r{name} b ON a.s = b.d AND a.d = b.s GROUP BY 1),
l{name} AS (SELECT vx.v, least(vx.v, coalesce(c, vx.v)) AS scc FROM vx LEFT JOIN m{name} ON m{name}.v = vx.v)"""


def sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([CTE, *ctes]) + "\n" + select
