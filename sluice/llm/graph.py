"""Connected components over an edge table: forests in tasks, then one task or a loop of DataFrame steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import cut, map_batches

#: Edges that a task holds, and up to which the forests of all tasks meet in one.
AT_ONCE = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, sorted, and the smallest node that edges reach from each."""
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(node))
    while len(x):
        x, y = up[x], up[y]
        low, high = np.minimum(x, y), np.maximum(x, y)
        x, y = low[low != high], high[low != high]
        np.minimum.at(up, y, x)  # a root goes below its smallest neighbour
        while not np.array_equal(further := up[up], up):
            up = further
    return node, node[up]


def _forest(at_once: int):
    """Edges to fewer ones that connect the same nodes; a task holds about `at_once`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows > at_once:
                held = [_inner(held)]
                rows = len(held[0][0])
                if 2 * rows > at_once:
                    yield pa.record_batch([*map(pa.array, held[0])], names=["a", "b"])
                    held, rows = [], 0
        if rows:
            yield pa.record_batch([*map(pa.array, _inner(held))], names=["a", "b"])

    return run


def _inner(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    node, label = stars(*map(np.concatenate, zip(*held)))
    return node[node != label], label[node != label]


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        yield pa.record_batch([*map(pa.array, stars(*map(np.concatenate, zip(*held))))], names=["node", "label"])


def components(edges: DataFrame, max_rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """(node, label): the smallest node that edges reach from each node.

    `edges` has columns a, b of type long; direction does not matter.  Each
    task first makes a forest of its edges.  If all forests together have at
    most `at_once` edges, one task joins them.  More go through rounds, none of
    which sees them all in one task: each round takes the smallest label among a node's neighbours and then the
    label of that label (pointer jumping), so chains shorten geometrically.
    Rounds end when no label changes.  Nodes without edges do not appear; an
    empty edge table gives an empty result.  Labels are written to the
    checkpoint folder each round, so a lost executor costs one round.
    """
    forest = cut(edges.select("a", "b").where("a <> b").transform(map_batches, _forest(at_once), "a long, b long"))
    if forest.count() <= at_once:
        return cut(forest.coalesce(1).transform(map_batches, _labels, "node long, label long"))
    both = cut(forest.union(forest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(step.join(jump, "label").select("node", "was", F.least("label", "further").alias("label")))
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
