"""Micro graphs, equivalence of the plans, batches against recomputation."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork import Graph
from knotwork.loop import cut
from knotwork.operators import dynamic, local, report, split, strategies, traverse, trim

MICRO = {
    "empty": (3, [], [[0], [1], [2]]),
    "self_loop": (2, [(0, 0), (0, 1)], [[0], [1]]),
    "path": (4, [(0, 1), (1, 2), (2, 3)], [[0], [1], [2], [3]]),
    "cycle3": (3, [(0, 1), (1, 2), (2, 0)], [[0, 1, 2]]),
    "pair_out": (4, [(0, 1), (1, 0), (2, 0), (2, 3), (3, 2)], [[0, 1], [2, 3]]),
    "pair_dup": (2, [(0, 1), (0, 1), (1, 0)], [[0, 1]]),
    "two_cycles_bridge": (6, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)], [[0, 1, 2], [3, 4, 5]]),
    "bowtie": (5, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2)], [[0, 1, 2, 3, 4]]),
}


def graph(spark, n, edges):
    return Graph(spark.createDataFrame(edges, "src long, dst long"), spark.range(n).withColumnRenamed("id", "v"))


def labels_of(parts):
    return {v: min(p) for p in parts for v in p}


def rows(df):
    return {r["v"]: r["scc"] for r in df.collect()}


def closure_labels(n, edges):
    reach = {v: {v} for v in range(n)}
    while True:
        size = sum(map(len, reach.values()))
        for s, d in edges:
            reach[s] |= reach[d]
        if sum(map(len, reach.values())) == size:
            return {v: min(w for w in reach[v] if v in reach[w]) for v in range(n)}


def test_local_finisher():
    for n, edges, parts in MICRO.values():
        assert local.strong_components(list(range(n)), edges) == labels_of(parts)
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 12)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 25))]
        assert local.strong_components(list(range(n)), edges) == closure_labels(n, edges)
    assert len(set(local.strong_components(list(range(50_000)), [(i, i + 1) for i in range(49_999)]).values())) == 50_000


@pytest.mark.parametrize("strategy", sorted(strategies.STRATEGIES))
def test_micro_graphs_together(spark, strategy):
    """All micro graphs side by side in one graph, with and without the local finisher."""
    n, edges, want = 0, [], {}
    for size, e, parts in MICRO.values():
        edges += [(a + n, b + n) for a, b in e]
        want |= {v + n: c + n for v, c in labels_of(parts).items()}
        n += size
    g = graph(spark, n, edges)
    assert rows(strategies.scc(g, strategy)) == want
    assert rows(strategies.scc(g, strategy, local_rows=0)) == want


def test_empty_graph(spark):
    g = graph(spark, 0, [])
    for strategy in ("full", "auto", "trim_tarjan"):
        assert rows(strategies.scc(g, strategy)) == {}
    assert report.histogram(strategies.scc(g)).count() == 0


def test_trim_counts_different_neighbours(spark):
    g = graph(spark, 2, MICRO["pair_dup"][1])
    active = g.vertices.selectExpr("v", "0L as color")
    e = trim.restrict(g.edges, active)
    for pairs in (trim.trim2(e), trim.trim2_two_phase(e)):
        assert [tuple(r) for r in pairs.collect()] == [(0, 1)]


def test_forward_label_is_not_weak(spark):
    g = graph(spark, 2, [(1, 0)])
    assert {r.v: r.label for r in split.min_label_forward(g.vertices, g.edges).collect()} == {0: 0, 1: 0}
    g = graph(spark, 2, [(0, 1)])
    assert {r.v: r.label for r in split.min_label_forward(g.vertices, g.edges).collect()} == {0: 0, 1: 1}
    assert {r.v: r.label for r in split.weak_components(g.vertices, g.edges).collect()} == {0: 0, 1: 0}


def test_levels(spark):
    g = graph(spark, 4, [(0, 1), (1, 2), (0, 2)])
    assert {r.v: r.level for r in traverse.topological_levels(g.edges, g.vertices).collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
    seen = []
    found = traverse.bfs(g.edges, spark.range(1).withColumnRenamed("id", "v"), on_level=lambda f, n: seen.append(n))
    assert {r.v: r.level for r in found.collect()} == {0: 0, 1: 1, 2: 1} and seen == [0, 1]
    assert traverse.bfs(g.edges, spark.range(0).withColumnRenamed("id", "v")).count() == 0


BATCHES = {
    "insert_merge": (4, [(0, 1), (1, 2), (2, 3)], [("+", 3, 1)]),
    "insert_forward": (3, [(0, 1), (1, 2)], [("+", 0, 2)]),
    "insert_unrelated": (4, [(0, 1), (1, 0), (2, 3)], [("+", 3, 2)]),
    "delete_split": (4, [(0, 1), (1, 2), (2, 0), (2, 3)], [("-", 2, 0)]),
    "delete_cross": (4, [(0, 1), (1, 0), (2, 3), (3, 2), (1, 2)], [("-", 1, 2)]),
    "delete_parallel": (2, [(0, 1), (0, 1), (1, 0)], [("-", 0, 1)]),
    "one_component": (3, [(0, 1), (1, 2), (2, 0)], [("+", 0, 2)]),
}


@pytest.mark.parametrize("name", sorted(BATCHES))
def test_batches(spark, name):
    n, edges, ops = BATCHES[name]
    g = graph(spark, n, edges)
    labels = strategies.scc(g)
    gone, new = {(s, d) for o, s, d in ops if o == "-"}, [(s, d) for o, s, d in ops if o == "+"]
    want = closure_labels(n, [e for e in edges if e not in gone] + new)
    batch = spark.createDataFrame([(s, d) for _, s, d in ops], "src long, dst long")
    if new:
        for method in (dynamic.insert_condensed, dynamic.insert_levels, dynamic.insert_touched):
            assert rows(method(g, labels, batch)) == want, method
        assert rows(dynamic.insert_naive(g, batch)) == want
    else:
        for method in (dynamic.delete_affected, dynamic.delete_confined):
            assert rows(method(g, labels, batch)) == want, method
    mixed = spark.createDataFrame(ops, "op string, src long, dst long")
    assert rows(dynamic.apply_batch(g, labels, mixed)[1]) == want
    after, state = dynamic.apply_to_state(g.edges, dynamic.condense_counted(g.edges, labels), labels, mixed)
    left = [e for e in edges if e not in gone] + new
    assert rows(after) == want
    assert {(r.src, r.dst): r.copies for r in state.collect()} == Counter((want[s], want[d]) for s, d in left if want[s] != want[d])


@pytest.mark.parametrize("method, name", [("insert_condensed", "insert_merge"), ("insert_levels", "insert_merge"), ("insert_touched", "insert_merge"), ("delete_affected", "delete_split"), ("delete_confined", "delete_split")])
def test_batches_without_a_local_finisher(spark, method, name):
    n, edges, ops = BATCHES[name]
    g = graph(spark, n, edges)
    gone, new = {(s, d) for o, s, d in ops if o == "-"}, [(s, d) for o, s, d in ops if o == "+"]
    batch = spark.createDataFrame([(s, d) for _, s, d in ops], "src long, dst long")
    want = closure_labels(n, [e for e in edges if e not in gone] + new)
    assert rows(getattr(dynamic, method)(g, strategies.scc(g), batch, local_rows=0)) == want


def test_state_through_random_batches(spark):
    """Labels and condensation kept through batches that insert and delete, copies and loops in."""
    rng = random.Random(12)
    n = 24
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(30)]
    g = graph(spark, n, edges)
    labels = strategies.scc(g)
    state = dynamic.condense_counted(g.edges, labels)
    for _ in range(3):
        gone = {rng.choice(edges) for _ in range(4)}
        new = [(rng.randrange(n), rng.randrange(n)) for _ in range(4)]
        ops = spark.createDataFrame([("-", *e) for e in gone] + [("+", *e) for e in new], "op string, src long, dst long")
        labels, state = (cut(x) for x in dynamic.apply_to_state(graph(spark, n, edges).edges, state, labels, ops))
        edges = [e for e in edges if e not in gone] + new
        want = closure_labels(n, edges)
        assert rows(labels) == want
        assert {(r.src, r.dst): r.copies for r in state.collect()} == Counter((want[s], want[d]) for s, d in edges if want[s] != want[d])


def test_repeated_pairs(spark):
    """A chain of pairs: each pass takes out those that are each other's only neighbour."""
    edges = [(0, 1), (1, 0), (2, 3), (3, 2), (1, 2), (4, 5), (5, 4), (3, 4)]
    g = graph(spark, 6, edges)
    active = g.vertices.selectExpr("v", "0L as color")
    a, e, found, n = trim.trim2_repeated(active, trim.restrict(g.edges, active))
    assert rows(found) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4} and n == 6 and a.isEmpty() and e.isEmpty()


def test_trim_of_a_path_stops(spark):
    """Each pass takes both ends of a path; a stop leaves the middle to others."""
    g = graph(spark, 60, [(i, i + 1) for i in range(59)])
    active = g.vertices.selectExpr("v", "0L as color")
    e = trim.restrict(g.edges, active)
    assert trim.trim1(active, e, stop=2)[3] == 2
    a, left, found, n = trim.trim1(active, e)
    assert n == 60 and a.isEmpty() and left.isEmpty() and rows(found) == {v: v for v in range(60)}


def test_search_prunes_and_goes_on(spark, monkeypatch):
    """Levels do not depend on how many a job takes, on pruning, or on tables put together."""
    rng = random.Random(13)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    g = graph(spark, 60, edges)
    start = spark.range(1).withColumnRenamed("id", "v")
    level, todo = {0: 0}, [0]
    for v in todo:
        for s, d in edges:
            if s == v and d not in level:
                level[d] = level[v] + 1
                todo.append(d)
    for hops, compact, prune in ((1, 2, 0.0), (4, 8, 0.25), (3, 1, 0.05)):
        monkeypatch.setattr(traverse, "HOPS", hops)
        monkeypatch.setattr(traverse, "COMPACT", compact)
        monkeypatch.setattr(traverse, "PRUNE", prune)
        assert {r.v: r.level for r in traverse.bfs(g.edges, start).collect()} == level
        assert {r.v: r.level for r in traverse.bfs(g.edges, start, max_level=2).collect()} == {v: n for v, n in level.items() if n <= 2}
    dag = spark.createDataFrame([(min(e), max(e)) for e in edges if e[0] != e[1]], "src long, dst long")
    one, many = (sorted(tuple(r) for r in traverse.topological_levels(dag, g.vertices, local_rows=n).collect()) for n in (1000, 0))
    assert one == many and len(one) == 60


def test_affected_levels_and_touched(spark):
    n, edges, ops = BATCHES["insert_merge"]
    g = graph(spark, n, edges)
    labels = strategies.scc(g)
    batch = spark.createDataFrame([(3, 1)], "src long, dst long")
    levels = dynamic.condensation_levels(g.edges, labels)
    assert {r.level: r.spans for r in dynamic.affected_levels(levels, dynamic.condense(batch, labels)).collect()} == {0: 0, 1: 1, 2: 1, 3: 1}
    assert [r.v for r in dynamic.touched(labels, batch).collect()] == [3]


def test_reports(spark):
    g = graph(spark, *MICRO["pair_out"][:2])
    labels = strategies.scc(g)
    assert report.count(labels).first()[0] == 2
    assert [tuple(r) for r in report.histogram(labels).collect()] == [(2, 2)]
    assert sorted(tuple(r) for r in report.export(labels).collect()) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert {r.members for r in report.member_lists(labels, min_size=2).collect()} == {"0 1", "2 3"}


def test_edges_must_end_at_vertices(spark):
    g = graph(spark, 2, [(0, 1)])
    with pytest.raises(ValueError):
        g.with_edges(spark.createDataFrame([(0, 9)], "src long, dst long"), check=True)


def test_components_of_blocks_are_merged_first(spark, monkeypatch):
    """Blocks of ids with cycles inside, in a cycle through all of them, before and after a
    deletion: labels as without blocks, and what is left fits into a task."""
    rng = random.Random(14)
    edges = [(10 * b + i, 10 * b + (i + 1) % 6) for b in range(12) for i in range(6)] + [(10 * b + 5, 10 * (b + 1) % 120) for b in range(12)]
    edges += [(rng.randrange(10 * b, 10 * b + 10), rng.randrange(120)) for b in range(12) for _ in range(2)]
    g = graph(spark, 120, edges)
    monkeypatch.setattr(strategies.contract, "BLOCK_ROWS", 40)
    plan = strategies.auto(g, local_rows=40)
    labels = cut(plan.result())
    assert rows(labels) == closure_labels(120, edges) and labels.count() == 120
    assert sum(n for phase, n, _ in plan.phases.rows if phase == "contract") >= 60
    assert "global_fwbw" not in {phase for phase, _, _ in plan.phases.rows}
    gone = spark.createDataFrame([(5, 10), (20, 21)], "src long, dst long")
    assert rows(dynamic.delete_confined(g, labels, gone, local_rows=40)) == closure_labels(120, [e for e in edges if e not in ((5, 10), (20, 21))])


def test_contraction_leaves_out_crowded_cells_and_takes_any_ids(spark, monkeypatch):
    far = [-(1 << 62), (1 << 62) - 1]
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1), *((a, b) for a in far for b in far if a != b)], "src long, dst long")
    v = spark.createDataFrame([(1,), (2,), (3,), *((x,) for x in far)], "v long")
    assert strategies.contract.merged_in_blocks(v, edges, 6).count() == 1
    assert {tuple(r) for r in strategies.contract.merged_in_blocks(v, edges, 10).collect()} >= {(2, 1)}
    assert strategies.contract.merged_in_blocks(v.limit(0), edges, 6) is None
    steps = [spark.createDataFrame(x, "v long, rep long") for x in ([(3, 2), (5, 4)], [(2, 1)], [(1, 0), (4, 0)])]
    assert {tuple(r) for r in strategies.contract.composed(steps).collect()} == {(3, 0), (5, 0), (2, 0), (1, 0), (4, 0)}


def test_a_block_resolves_what_no_way_leads_through(spark, monkeypatch):
    """Components on no way through their block are done, whatever the rest looks like; chains in
    blocks need no passes."""
    solved, local = strategies.contract.solved, strategies.local.strong_components
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 20)
        e = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(40))) if a != b]
        want, h = local(list(range(n)), e), rng.randrange(1, n + 1)
        rows_ = [(0, v, v) for v in range(h)] + [({(True, True): 1, (True, False): 2, (False, True): 3}[a < h, b < h], a, b) for a, b in e if a < h or b < h]
        found = list(zip(*(x.tolist() for x in solved(*(np.array(x, np.int64) for x in zip(*rows_))))))
        assert [v for v, _, _ in found] == list(range(h))
        for v, rep, done in found:
            assert want[v] == want[rep]
            if done:
                assert {x for x in range(n) if want[x] == want[v]} == {x for x, r, _ in found if r == rep}
    monkeypatch.setattr(strategies.contract, "BLOCK_ROWS", 60)
    edges = [(i, i + 1) for i in range(119) if i % 20 != 19] + [(5, 3), (25, 23), (30, 50), (1, 10**6)]
    plan = strategies.auto(graph(spark, 120, edges[:-1]).with_edges(spark.createDataFrame(edges[-1:], "src long, dst long")), local_rows=60)
    assert rows(plan.result()) == closure_labels(120, edges[:-1])
    assert {phase for phase, _, _ in plan.phases.rows} <= {"contract", "local"}


def test_a_round_of_contraction_sends_packs_and_not_single_rows(spark, monkeypatch):
    """Chains of two-cycles over several blocks, ids of type int, edges to unknown vertices and a
    null vertex: the same rounds as a search over the whole finds, from few rows to the blocks."""
    contract, sent = strategies.contract, []
    packed = contract._packed
    monkeypatch.setattr(contract, "_packed", lambda *how: sent.append(packed(*how)) or sent[-1])
    edges = [(i, i + 1) for i in range(199)] + [(i + 1, i) for i in range(0, 199, 2)] + [(150, 20), (7, 900), (900, 3), (500, 5)]
    v = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "v int")
    found = contract.contracted(v, spark.createDataFrame(edges, "src int, dst int"), 60)
    assert {r.n for r in (df.groupBy("block").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first() for df in sent)} <= set(range(1, 3 * 4 + 1))
    known = [(a, b) for a, b in edges if a < 200 and b < 200]
    want = closure_labels(200, known)
    got = {r.v: (r.rep, r.done) for r in found.found.filter("v is not null").collect()}
    assert set(got) == set(range(200))
    assert all(rep == dict(want)[i] for i, (rep, done) in got.items() if done)
    assert {r.color for r in found.active.collect()} == {r.color for r in found.edges.collect()} == {0}
    left = {tuple(r) for r in found.edges.select("src", "dst").collect()}
    assert left <= {(got[a][0], got[b][0]) for a, b in known} and all(not got[x][1] for e in left for x in e)


def test_deletions_search_inside_old_components(spark, monkeypatch):
    """The first colors are the old components, so one search finds a part of each at once."""
    rng = random.Random(11)
    edges = [(c * 100 + i, c * 100 + (i + 1) % 40) for c in range(6) for i in range(40)]
    edges += [(c * 100 + rng.randrange(40), c * 100 + rng.randrange(40)) for c in range(6) for _ in range(20)]
    edges += [(c * 100 + 5, c * 100 + 107) for c in range(5)]
    g = graph(spark, 700, edges)
    labels = cut(strategies.scc(g))
    gone = {edges[c * 40 + i] for c in range(5) for i in (3, 21)}
    left = [e for e in edges if e not in gone]
    batch = spark.createDataFrame(sorted(gone), "src long, dst long")
    want = local.strong_components(list(range(700)), left)
    colors, made = [], strategies.Plan.phases_of_full
    monkeypatch.setattr(strategies.Plan, "phases_of_full", lambda self, *a, **k: (colors.append(self.active.select("color").distinct().count()), made(self, *a, **k))[1])
    for delete in (dynamic.delete_affected, dynamic.delete_confined):
        assert rows(delete(g, labels, batch, local_rows=0)) == want
    assert min(colors) > 1


def test_insertions_into_kept_state_meet_only_linked_components(spark, monkeypatch):
    """Components without an edge between components are no vertices of the graph that is searched."""
    g = graph(spark, 1000, [(0, 1), (1, 2)])
    labels = cut(strategies.scc(g))
    asked, made = [], strategies.auto
    monkeypatch.setattr(strategies, "auto", lambda graph, **how: (asked.append(graph.vertices.count()), made(graph, **how))[1])
    batch = spark.createDataFrame([(2, 0), (5, 6)], "src long, dst long")
    after, condensed = dynamic.insert_into(dynamic.condense_counted(g.edges, labels), labels, batch)
    assert rows(after) == {v: 0 if v < 3 else v for v in range(1000)}
    assert [tuple(r) for r in condensed.collect()] == [(5, 6, 1)] and asked == [5]


def test_kept_state_counts_copies_after_labels_moved(spark):
    """A split that moves the least vertex out of its component renames the rest: edges that touch
    it, and copies of them, are counted under the new labels."""
    edges = [(0, 1), (1, 2), (2, 3), (3, 1), (3, 0), (3, 4), (3, 4), (4, 5), (5, 4), (9, 2), (9, 2), (4, 8)]
    g = graph(spark, 10, edges)
    labels = cut(strategies.scc(g))
    batch = spark.createDataFrame([(3, 0), (4, 8), (3, 0)], "src long, dst long")
    after, state = dynamic.delete_from(g.edges, cut(dynamic.condense_counted(g.edges, labels)), labels, batch)
    left = [e for e in edges if e not in {(3, 0), (4, 8)}]
    want = local.strong_components(list(range(10)), left)
    assert rows(after) == want
    assert {(r.src, r.dst): r.copies for r in state.collect()} == Counter((want[s], want[d]) for s, d in left if want[s] != want[d])


def test_blocks_of_a_graph_in_layers_reach_further(spark, monkeypatch):
    """Cycles over far ids of one layer lie in a block each, where blocks of ids side by side cut them
    all; labels are the same by any number of layers, even one that edges cross."""
    contract = strategies.contract
    v = spark.range(-70, 70).withColumnRenamed("id", "v")
    cycles = spark.createDataFrame([(7 * i + k - 70, 7 * ((i + 1) % 20) + k - 70) for k in range(7) for i in range(20)], "src long, dst long")
    apart, together = (contract.contracted(v, cycles, 40, **how).found for how in ({}, {"layers": 7}))
    assert apart.filter("done").isEmpty()
    assert {(r.v, r.rep, r.done) for r in together.collect()} == {(x, x % 7 - 70, True) for x in range(-70, 70)}
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(3, 10**6), (-9, 4)]
    monkeypatch.setattr(contract, "BLOCK_ROWS", 20)
    g = graph(spark, 60, edges)
    for layers in (3, 7, 100):
        assert rows(strategies.scc(g, local_rows=20, layers=layers)) == closure_labels(60, edges[:-2])


def test_deletions_look_no_label_up_that_edges_carry(spark, monkeypatch):
    """Edges with their ends' labels give the same state as without, and meet no table of labels."""
    rng = random.Random(8)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)] * 2
    g = graph(spark, 45, edges)
    labels = cut(strategies.scc(g))
    ends = cut(dynamic.relabelled(g.edges, labels))
    condensed = cut(dynamic.counted(ends))
    gone = set(edges[::6]) | {(1, 44)}
    batch = spark.createDataFrame(sorted(gone) * 2, "src long, dst long")
    monkeypatch.delattr(dynamic, "relabelled")
    after, state = dynamic.delete_from(ends, condensed, labels, batch)
    left = [e for e in edges if e not in gone]
    want = local.strong_components(list(range(45)), left)
    assert rows(after) == want
    assert {(r.src, r.dst): r.copies for r in state.collect()} == Counter((want[s], want[d]) for s, d in left if want[s] != want[d])
