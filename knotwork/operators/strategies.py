"""Plans for strongly connected components: phases over the operators, all with equal labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..loop import Phases, cut
from . import contract, local, split, trim

#: Parts with so many vertices and edges are finished by one task; larger ones are split on.
LOCAL_ROWS = 400_000
#: Contraction rounds go on while each takes away this share of the vertices and edges.
CONTRACT_SHARE = 0.1


class Plan:
    """The state of a running plan: active vertices, the edges inside colors, and labels."""

    def __init__(self, graph: Graph, local_rows: int = LOCAL_ROWS, stop: int = trim.TRIM_STOP, blocks: bool = False, within: DataFrame | None = None, layers: int = 1):
        """blocks: components of blocks are merged first, see contract(); layers: no edge links ids
        that leave different remainders by it, which only makes blocks reach further. within: labels(v, scc) of
        all vertices that no component of the graph crosses; edges between them go, the first
        colors are theirs. Blocks are merged before that: no component of a block crosses one."""
        self.local_rows, self.stop, self.layers = local_rows, stop, layers
        self.labels: list[DataFrame] = []
        self.rounds: list[contract.Round] = []
        self.phases = Phases()
        self.active, self.edges = graph.vertices.select("v"), graph.edges
        merged = blocks and self.contract()
        if within is not None:
            self.active = cut(self.active.select("v").distinct().join(within.select("v", F.col("scc").alias("color")), "v"))
        elif not merged:
            self.active = cut(self.active.distinct().withColumn("color", F.lit(0).cast("long")))
        if within is not None or not merged:
            self.edges = cut(trim.restrict(self.edges, self.active))

    # --- phases, each resolving some vertices -------------------------------------------------

    def _took(self, name: str, work):
        self.phases.timed(name, work)

    def trim1(self) -> None:
        def work():
            self.active, self.edges, gone, n = trim.trim1(self.active, self.edges, self.stop)
            self.labels.append(gone)
            return (n,)

        self._took("trim1", work)

    def trim2(self) -> None:
        def work():
            self.active, self.edges, gone, n = trim.resolve_pairs(self.active, self.edges, trim.trim2(self.edges))
            self.labels.append(gone)
            return (n,)

        self._took("trim2", work)

    def drop(self, labels: DataFrame) -> None:
        """Resolve vertices whose labels are known beforehand."""

        def work():
            gone = cut(labels.join(self.active.select("v"), "v", "left_semi").select("v", "scc"))
            n = gone.count()
            if n:
                self.labels.append(gone)
                self.active = cut(self.active.join(gone.select("v"), "v", "left_anti"))
                self.edges = cut(trim.without(self.edges, gone))
            return (n,)

        self._took("known", work)

    def contract(self) -> bool:
        """Merge components of blocks and drop what is resolved, while a round takes away much;
        whether there was one. A graph of a single block is left to the finisher, or, where that is
        turned off, to the joins. Vertices and edges need not be restricted to each other yet."""

        named = self.active.columns  # without a color, all are of one in every round

        def work():
            found = contract.contracted(self.active.select(named), self.edges, contract.BLOCK_ROWS, self.layers)
            if found is None:
                return (0,)
            self.rounds.append(found)
            self.active, self.edges = found.active, found.edges
            return (found.found.filter("done or v <> rep").count(),)

        rows = self.active.count() + self.edges.count()
        while rows > max(contract.BLOCK_ROWS, self.local_rows):
            self._took("contract", work)
            before, rows = rows, self.active.count() + self.edges.count()
            if rows > (1 - CONTRACT_SHARE) * before:
                break
        return bool(self.rounds)

    def fwbw(self, chosen: DataFrame | None = None, name: str = "fwbw") -> DataFrame | None:
        """One forward-backward round; chosen: pivots(color, pivot), default the least."""

        def work():
            classes, found = split.fwbw(self.active, self.edges, chosen if chosen is not None else split.pivots(self.active))
            self.labels.append(found)
            self.active, self.edges = split.recolored(classes, self.edges)
            return found, found.count()

        if self.active.isEmpty():
            return None
        self._took(name, work)
        return self.labels[-1]

    def global_fwbw(self, pivot: str = "least") -> None:
        """The round meant for the giant component: pivot "least" or "degree" (most out-edges)."""
        chosen = None
        if pivot == "degree":
            top = Graph(self.edges, self.active).max_degree_vertex().select(F.col("v").alias("pivot"))
            chosen = self.active.join(top, F.col("v") == F.col("pivot")).select("color", "pivot")
            if chosen.isEmpty():
                chosen = None
        self.fwbw(chosen, "global_fwbw")

    def min_label(self) -> None:
        """Split by least reachable vertex."""

        def work():
            labels = split.min_label_forward(self.active, self.edges)
            self.active = cut(labels.withColumnRenamed("label", "color"))
            self.edges = cut(trim.restrict(self.edges, self.active))
            return (0,)

        if not self.active.isEmpty():
            self._took("split", work)

    def finish(self) -> None:
        """Until nothing is active: colors that fit into a task go to tasks whole, the others
        are trimmed and go through a coloring round, which finds a component in every part that
        a least vertex leads to, so a chain of components takes few rounds."""
        while not self.active.isEmpty():
            n = self.active.groupBy("color").agg(F.count("*").alias("n")).join(self.edges.groupBy("color").agg(F.count("*").alias("m")), "color", "left").select("color", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
            sizes = cut(n.filter(F.col("n") <= self.local_rows))
            rows = sizes.agg(F.sum("n")).first()[0]
            if rows:
                self.local(sizes.select("color"), rows)
            else:
                self.trim1()
                if not self.active.isEmpty():
                    self.coloring_round()

    def local(self, small: DataFrame, rows: int) -> None:
        """Finish the colors `small`, of so many vertices and edges in all, in tasks."""

        def work():
            found = cut(local.finish(self.active.join(small, "color", "left_semi"), self.edges.join(small, "color", "left_semi"), rows))
            self.labels.append(found)
            self.active = cut(self.active.join(small, "color", "left_anti"))
            self.edges = cut(self.edges.join(small, "color", "left_anti"))
            return (found.count(),)

        self._took("local", work)

    def coloring_round(self) -> None:
        def work():
            self.active, self.edges, found = split.coloring_round(self.active, self.edges)
            self.labels.append(found)
            return (found.count(),)

        self._took("coloring", work)

    def fits(self) -> bool:
        """Whether all that is active fits into a task."""
        return self.active.count() + self.edges.count() <= self.local_rows

    def coloring(self) -> None:
        """Coloring rounds until no more is active than fits into a task."""
        while not self.active.isEmpty() and not self.fits():
            self.coloring_round()

    def phases_of_full(self, pivot: str, split: bool = True) -> None:
        """split: by least reachable vertex, so that parts may fit into tasks."""
        self.trim1()
        self.global_fwbw(pivot)
        self.trim1()
        self.trim2()
        self.trim1()
        if split and not self.fits():
            self.min_label()

    def result(self) -> DataFrame:
        out = self.active.limit(0).select("v", F.col("v").alias("scc")) if not self.labels else self.labels[0]
        for more in self.labels[1:]:
            out = out.union(more)
        return contract.labelled(self.rounds, out.select("v", "scc"))


def baseline(graph: Graph, **how) -> Plan:
    """Method 0: trim, then forward-backward rounds."""
    plan = Plan(graph, **how)
    plan.trim1()
    plan.fwbw()
    plan.finish()
    return plan


def global_fb(graph: Graph, pivot: str = "least", **how) -> Plan:
    """Method 1: trim, the giant component, trim, rounds."""
    plan = Plan(graph, **how)
    plan.trim1()
    plan.global_fwbw(pivot)
    plan.trim1()
    plan.finish()
    return plan


def full(graph: Graph, pivot: str = "least", known=None, **how) -> Plan:
    """Method 2, the main one: trim, the giant component, trim, pairs, trim, split, rounds.
    known: labels resolved before anything else."""
    plan = Plan(graph, **how)
    if known is not None:
        plan.drop(known)
    plan.phases_of_full(pivot)
    plan.finish()
    return plan


def tarjan(graph: Graph, **how) -> Plan:
    """Method 3: depth-first search of each weak component in one task; components too large
    for a task are split by rounds first."""
    plan = Plan(graph, **how)
    plan.active = cut(split.weak_components(plan.active, plan.edges).withColumnRenamed("label", "color"))
    plan.edges = cut(trim.restrict(plan.edges, plan.active))
    plan.finish()
    return plan


def trim_tarjan(graph: Graph, **how) -> Plan:
    """Method 4: trim, then method 3."""
    plan = Plan(graph, **how)
    plan.trim1()
    plan.active = cut(split.weak_components(plan.active, plan.edges).withColumnRenamed("label", "color"))
    plan.edges = cut(trim.restrict(plan.edges, plan.active))
    plan.finish()
    return plan


def coloring(graph: Graph, **how) -> Plan:
    """Trim, then coloring rounds, every step a join, until what is left fits into tasks."""
    plan = Plan(graph, **how)
    plan.trim1()
    plan.coloring()
    plan.finish()
    return plan


def auto(graph: Graph, pivot: str = "least", known: DataFrame | None = None, **how) -> Plan:
    """A graph that fits into a task goes there whole; of a larger one, components of blocks are
    merged first, and what is left goes through the main plan. within: see Plan."""
    plan = Plan(graph, blocks=known is None, **how)
    if known is not None:
        plan.drop(known)
        plan.contract()
    if not plan.fits():
        plan.phases_of_full(pivot, split=plan.local_rows > 0)  # else the first coloring round splits so
    plan.finish()
    return plan


STRATEGIES = {"baseline": baseline, "global_fb": global_fb, "full": full, "tarjan": tarjan, "trim_tarjan": trim_tarjan, "coloring": coloring, "auto": auto}


def scc(graph: Graph, strategy: str = "auto", **how) -> DataFrame:
    """labels(v, scc) of every vertex."""
    return STRATEGIES[strategy](graph, **how).result()
