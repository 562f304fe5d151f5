"""One group id for all records that are linked directly or indirectly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.shared import Scratch, lookup


def priority(ids: np.ndarray, turn: int) -> np.ndarray:
    """A random order of all 64-bit ids, another one each turn, without ties (every step can be undone)."""
    x = ids.view(np.uint64) ^ np.uint64((turn * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def spanning_stars(one: np.ndarray, two: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the edges (one, two): each node that is not its tree's root, and that root.

    The root is the node of least `priority`. All finds and unions of a sweep are done at once.
    """
    nodes = np.unique(np.concatenate([one, two]))
    nodes = nodes[np.argsort(priority(nodes, turn), kind="stable")]
    by_id = np.argsort(nodes)
    a, b = (by_id[np.searchsorted(nodes, x, sorter=by_id)] for x in (one, two))
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != (up := root[root])).any():
            root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _forest(turn: int, chunk: int):
    def emit(one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
        arrays = [one, two, priority(two, turn)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["node", "root", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)))
            size += batch.num_rows
            if size < chunk:
                continue
            forest = spanning_stars(*(np.concatenate(x) for x in zip(*held)), turn)
            held, size = [forest], len(forest[0])
            if size > chunk // 2:  # a forest this large is passed on, so a task never holds more than `chunk` edges
                yield emit(*forest)
                held, size = [], 0
        if held:
            yield emit(*spanning_stars(*(np.concatenate(x) for x in zip(*held)), turn))

    return run


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node_id", one: str = "a", two: str = "b", chunk: int = 1 << 18) -> DataFrame:
    """(node, group): each different id of `nodes` and the smallest id of `nodes` linked to it over `edges`.

    `nodes` has the LONG column `node`, `edges` the columns `one` and `two`, whose values need not be in `nodes`
    (they link all the same); other columns are not read.
    Every edge partition is reduced by union-find to its spanning forest, edge chunk by edge chunk. Where trees of
    different partitions share a node, they are linked by an edge between their roots; those edges, far fewer,
    are the input of the next round, in as many partitions as hold at most `chunk` edges each, until none is
    left. The roots are drawn anew in each round, so every round takes away a fixed part of the nodes
    whatever the shape. No partition, and never the driver, needs to hold a whole component.

    Edges with a null end or with two equal ends are ignored, so are repeated edges and null nodes; without edges
    every node is its own group; an empty `nodes` gives an empty result.
    """
    scratch = Scratch(nodes.sparkSession)
    links = edges.select(F.col(one).cast("long").alias("a"), F.col(two).cast("long").alias("b")).where("a <> b")
    parents: list[DataFrame] = []
    while True:
        turn = len(parents)
        stars = scratch.keep(links.mapInArrow(_forest(turn, chunk), "node long, root long, rank long"))
        above = scratch.keep(stars.groupBy("node").agg(F.min_by("root", "rank").alias("parent")))
        parents.append(above)
        # trees of several partitions that share a node
        meets = stars.join(above, "node").select("root", "parent").distinct()
        up = above.select(F.col("node").alias("root"), F.col("parent").alias("over"))
        moved = meets.join(up, "root", "left").select(F.coalesce("over", "root").alias("x"), F.col("parent").alias("y"))
        moved = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = scratch.keep(moved)
        count = left.count()
        scratch.drop(stars)
        if not count:
            break
        links = left.repartitionByRange(math.ceil(count / chunk), "a", "b")

    labels = nodes.select(F.col(node).cast("long").alias("node")).where("node is not null").distinct().withColumn("label", F.col("node"))
    labels = scratch.keep(labels)
    for above in parents:
        moved = lookup(labels, above.select(F.col("node").alias("label"), "parent"), "label")
        labels = scratch.keep(moved.select("node", F.coalesce("parent", "label").alias("label")))
    least = labels.groupBy("label").agg(F.min("node").alias("group"))
    return lookup(labels, least, "label").select("node", "group")
