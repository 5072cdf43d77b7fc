"""Base learners chosen by name, with the same three steps for each.

``learner("nb")`` and ``learner("hoeffding", tie=0.1, …)`` give an object that
trains on a weighted fan-out, carries its state between batches, and votes.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from polyphon.functions.weights import with_poisson_weight
from polyphon.operators import evaluation as ev
from polyphon.operators import hoeffding as ht
from polyphon.operators import naive_bayes as nb
from polyphon.operators import scoring as sc
from polyphon.operators.streams import ensemble_fanout
from polyphon.plans.bagging import labelled
from polyphon.sources.instances import FeatureSpec
from polyphon.sources.workspace import materialize


class Learner(Protocol):
    def train(self, weighted: DataFrame, state: object | None, ensemble: int) -> object:
        """State after training on one batch of weighted (instance, member) rows."""

    def bag_numbered(self, instances: DataFrame, batches: int, ensemble: int, seed: int, weight: str) -> object | None:
        """State of a bagged ensemble after batches 0, 1, … of instances that carry their ``batch``; None: train them one by one."""

    def alike(self, instances: DataFrame, key: str, weight: str) -> DataFrame:
        """Instances with the same votes and ``key`` as one with their whole weight, where that makes few of many."""

    def votes(self, fanned: DataFrame, state: object, ensemble: int) -> DataFrame:
        """Vote vector of each (instance, member) row."""

    def row_votes(self, instances: DataFrame, state: object, ensemble: int) -> DataFrame:
        """``votes`` of all members on the instance's own row."""


@dataclass(frozen=True)
class NaiveBayes:
    """State: the statistics table."""

    spec: FeatureSpec

    def train(self, weighted: DataFrame, state: DataFrame | None, ensemble: int) -> DataFrame:
        delta = nb.nb_train(weighted, self.spec)
        merged = delta if state is None else nb.merge_stats(state, delta)
        return materialize(merged, "nb-state")

    def bag_numbered(self, instances: DataFrame, batches: int, ensemble: int, seed: int, weight: str) -> None:
        """None: a batch is one aggregation already."""

    def alike(self, instances: DataFrame, key: str, weight: str) -> DataFrame:
        return instances

    def votes(self, fanned: DataFrame, state: DataFrame, ensemble: int) -> DataFrame:
        return nb.member_votes(fanned, nb.nb_model(state, self.spec), self.spec, ensemble)

    def row_votes(self, instances: DataFrame, state: DataFrame, ensemble: int) -> DataFrame:
        return sc.row_votes(instances, state, self.spec, ensemble)


@dataclass
class TreeState:
    """Trees of all members: their nodes, the leaves' counts, the deepest leaf, and how many nodes there are."""

    nodes: DataFrame
    stats: DataFrame
    depth: int
    size: int


@dataclass(frozen=True)
class HoeffdingTrees:
    """Trees that grow by one level per batch at most."""

    spec: FeatureSpec
    params: ht.TreeParams

    def node_bytes(self, nodes: int) -> int:
        """Size of that many nodes, each with its leaf's vote vector and what it took over."""
        return nodes * (96 + 16 * len(self.spec.classes))

    def train(self, weighted: DataFrame, state: TreeState | None, ensemble: int) -> TreeState:
        """Route a batch to the leaves, add its counts, split the leaves that are ready.

        A leaf's counts are dropped when it splits: its children start empty, but vote
        with their sides of the split. A member that outgrew its cap starts from an
        empty root.
        """
        rows = ht.binned(weighted, self.spec, self.params)
        if ht.cell_count(self.spec, self.params) > ht.CELLS:
            return self._grow(rows, state, ensemble, "instance_id")
        return self._grow(ht.cells(rows, self.spec), state, ensemble, "cell")

    def bag_numbered(self, instances: DataFrame, batches: int, ensemble: int, seed: int, weight: str) -> TreeState | None:
        """The same batch after batch, with one pass over the instances of all of them.

        Bins are found before the fan-out. The rows are added up to their cells, which
        are written once; what follows works on the cells alone. None when there may be
        too many of them.
        """
        if ht.cell_count(self.spec, self.params) > ht.CELLS:
            return None
        weighted = _bagged(ht.binned(instances, self.spec, self.params), ensemble, seed, weight)
        cells = materialize(ht.cells(weighted, self.spec, keys=("batch", "member")), "batch-cells", ["batch"])
        state = None
        for b in range(batches):
            state = self._grow(cells.where(F.col("batch") == b), state, ensemble, "cell")
        return state

    def _grow(self, rows: DataFrame, state: TreeState | None, ensemble: int, spread_by: str) -> TreeState:
        spark = rows.sparkSession
        nodes = state.nodes if state else ht.root_nodes(spark, ensemble)
        depth = state.depth if state else 0
        size = self.node_bytes(state.size if state else ensemble)
        stats = ht.leaf_stats(ht.route(rows, nodes, self.spec, depth, size, spread_by), self.spec)
        if state:
            stats = ht.merge_leaf_stats(state.stats, stats)
        stats = materialize(stats, "leaf-stats")
        open_leaves = stats
        if self.params.max_depth is not None:
            shallow = nodes.where(F.col("is_leaf") & (F.col("depth") < self.params.max_depth)).select("member", "node_id")
            open_leaves = stats.join(shallow, ["member", "node_id"], "left_semi")
        splits = ht.tree_split(open_leaves, self.spec, self.params)
        grown = ht.apply_splits(nodes, splits)
        if self.params.max_split_nodes is not None:
            grown = ht.tree_size_limit(grown, self.params.max_split_nodes)
        grown = materialize(grown, "tree-nodes")
        # Counts stay with the nodes that were leaves before and still are. A
        # restarted root was no leaf, so it begins with nothing.
        still = nodes.where("is_leaf").join(grown.where("is_leaf"), ["member", "node_id"], "left_semi")
        kept = stats.join(still.select("member", "node_id"), ["member", "node_id"], "left_semi")
        deepest, count = grown.agg(F.max("depth"), F.count(F.lit(1))).first()
        return TreeState(grown, kept, deepest, count)

    def alike(self, instances: DataFrame, key: str, weight: str) -> DataFrame:
        if ht.cell_count(self.spec, self.params) > ht.CELLS:
            return instances
        return ht.alike(instances, self.spec, self.params, key, weight)

    def votes(self, fanned: DataFrame, state: TreeState, ensemble: int) -> DataFrame:
        size = self.node_bytes(state.size)
        routed = ht.route(ht.binned(fanned, self.spec, self.params), state.nodes, self.spec, state.depth, size)
        return ht.leaf_votes(routed, state.stats, self.spec, size, state.nodes)

    def row_votes(self, instances: DataFrame, state: TreeState, ensemble: int) -> DataFrame:
        size = self.node_bytes(state.size)
        return ht.row_votes(instances, state.nodes, state.stats, self.spec, self.params, ensemble, state.depth, size)


def learner(name: str, spec: FeatureSpec, **options) -> Learner:
    """A base learner by name; options are those of ``TreeParams``."""
    if name == "nb":
        if options:
            raise ValueError(f"naive Bayes has no options, got {sorted(options)}")
        return NaiveBayes(spec)
    if name == "hoeffding":
        unknown = set(options) - {f.name for f in fields(ht.TreeParams)}
        if unknown:
            raise ValueError(f"unknown tree options {sorted(unknown)}")
        return HoeffdingTrees(spec, ht.TreeParams(**options))
    raise ValueError(f"unknown learner {name!r}")


def _bagged(instances: DataFrame, ensemble: int, seed: int, weight: str) -> DataFrame:
    return with_poisson_weight(ensemble_fanout(instances, ensemble), weight_col=weight, seed=seed)


def bag_batches(batches: list[DataFrame], base: Learner, ensemble: int, seed: int, weight: str = "weight") -> object:
    """Train a bagged ensemble of any base learner, batch by batch."""
    state = None
    for batch in batches:
        state = base.train(_bagged(batch, ensemble, seed, weight), state, ensemble)
    return state


def bag_stream(instances: DataFrame, ends: list[Column | None], base: Learner, ensemble: int, seed: int, weight: str = "weight") -> object:
    """The same for batches that follow each other in one stream.

    ``ends`` are the stream numbers that the batches stop before, in ascending order;
    None as the last one is the end of the stream. A learner that can add rows up
    reads the stream once, with all tasks, and not one slice of it per batch.
    """
    seq = F.col("seq")
    inside = [seq.isNotNull() if end is None else seq < end for end in ends]
    cases = reduce(lambda case, b: case.when(inside[b], b), range(1, len(ends)), F.when(inside[0], 0))
    state = base.bag_numbered(instances.where(inside[-1]).withColumn("batch", cases), len(ends), ensemble, seed, weight)
    if state is not None:
        return state
    batches = [instances.where(inside[0]), *(instances.where((seq >= a) & now) for a, now in zip(ends, inside[1:]))]
    return bag_batches(batches, base, ensemble, seed, weight)


def bag_evaluate(instances: DataFrame, base: Learner, state: object, spec: FeatureSpec, ensemble: int) -> DataFrame:
    """Accuracy of a trained ensemble of any base learner on held-out instances; one row."""
    rows = instances.select("instance_id", F.col(spec.label).alias("truth"), F.col(spec.weight).alias("weight"), *spec.numeric, *spec.nominal, *spec.open)
    return ev.basic_evaluator(labelled(base.row_votes(base.alike(rows, "truth", "weight"), state, ensemble), spec))
