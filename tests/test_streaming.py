"""A stream of batches against recomputation: replays, the log of edges, and its tables."""

import os
import random
from collections import Counter

import pytest

from knotwork import Graph
from knotwork.operators import strategies
from knotwork.streaming import maintain


@pytest.mark.parametrize("log", [2, 32])
def test_stream_of_batches(spark, tmp_path, monkeypatch, log):
    monkeypatch.setattr(maintain, "LOG", log)
    rng = random.Random(1)
    n = 14
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(18)]
    g = Graph(spark.createDataFrame(edges, "src long, dst long"), spark.range(n).withColumnRenamed("id", "v"))
    folder, source, check = (str(tmp_path / x) for x in ("state", "source", "check"))
    maintain.start_state(g, strategies.scc(g), folder)
    stream = lambda: spark.readStream.schema("op string, src long, dst long").option("maxFilesPerTrigger", 1).parquet(source)
    for i in range(4):
        gone = {rng.choice(edges)} if i != 1 else set()
        new = [(rng.randrange(n), rng.randrange(n)), rng.choice(edges)]  # a copy of an edge that may just have gone
        spark.createDataFrame([("-", *e) for e in gone] + [("+", *e) for e in new], "op string, src long, dst long").coalesce(1).write.mode("append").parquet(source)
        edges = [e for e in edges if e not in gone] + new
        maintain.maintain(stream(), folder, check).awaitTermination()
        after, labels = maintain.current(spark, folder)
        assert Counter((r.src, r.dst) for r in after.edges.collect()) == Counter(edges)
        again = strategies.scc(Graph(spark.createDataFrame(edges, "src long, dst long"), g.vertices))
        assert {r.v: r.scc for r in labels.collect()} == {r.v: r.scc for r in again.collect()}
        assert sum(x.startswith("v") for x in os.listdir(folder)) <= 2
    # a batch that is given again, its result half written, is made again from the version before
    os.remove(f"{folder}/v3/DONE")
    os.remove(f"{check}/commits/3")
    for f in os.listdir(f"{check}/commits"):
        if f.startswith(".3"):
            os.remove(f"{check}/commits/{f}")
    maintain.maintain(stream(), folder, check).awaitTermination()
    after, labels = maintain.current(spark, folder)
    assert Counter((r.src, r.dst) for r in after.edges.collect()) == Counter(edges)
    assert {r.v: r.scc for r in labels.collect()} == {r.v: r.scc for r in again.collect()}
