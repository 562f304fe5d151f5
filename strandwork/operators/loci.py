"""Loci: groups of connected contigs, their orientation, extension and shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.dna import REVERSE_STOPS, STOPS, codon_count
from strandwork.operators.clean import both_ways
from strandwork.operators.similarity import merge_map, moved_ends, simple_bubbles
from strandwork.shared import Scratch, heavy_keys, lookup, numbered_within


def least_linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, to): each contig on the few connections (a, b) of a task and the smallest one it is linked to, if not itself."""
    few = pd.concat([*batches, pd.DataFrame({"a": [], "b": []}, dtype=np.int64)])
    ids, ends = np.unique(few[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    least = np.arange(len(ids))
    while (least[a] != least[b]).any():
        lower = np.minimum(least[a], least[b])
        for end in (a, b):
            np.minimum.at(least, least[end], lower)
        while (least != least[least]).any():
            least = least[least]
    moved = np.flatnonzero(least != np.arange(len(ids)))
    yield pd.DataFrame({"a": ids[moved], "to": ids[least[moved]]})


def components(nodes: DataFrame, pairs: DataFrame, few: int = 1 << 17) -> DataFrame:
    """(node_id, locus_id): each contig of `nodes` with the smallest contig it is connected to, signs ignored.

    In every round a contig joins that one of its neighbours and itself which comes first in an order drawn anew,
    and the connections are carried over to what is left; a fixed part of the contigs goes in each round, whatever
    the shape, and a round moves only the connections that are left. Once these are at most `few`, one task finds what
    they link. Then each contig follows its joins.
    """
    scratch = Scratch(nodes.sparkSession)
    ids = scratch.keep(nodes.select("node_id").distinct())
    ends = pairs.select(F.abs("src").alias("a"), F.abs("dst").alias("b")).where("a <> b")
    edges = scratch.keep(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for end in ("a", "b"):
        edges = lookup(edges, ids.withColumnRenamed("node_id", end), end, "left_semi")
    edges = scratch.keep(edges)
    joins: list[DataFrame] = []
    while edges.count() > few:
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(joins)), c), F.col(c).alias("id"))  # noqa: B023, E731
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = near.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a")))["id"].alias("to")).where("a <> to")
        joined = scratch.keep(first)
        moved = lookup(edges, joined.withColumnRenamed("to", "x"), "a")
        moved = lookup(moved, joined.select(F.col("a").alias("b"), F.col("to").alias("y")), "b", heavy=heavy_keys(edges, "b"))
        moved = moved.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).where("x <> y")
        after = scratch.keep(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.drop(edges)
        edges = after
        joins.append(joined)
    # from the last round back: where what each contig joined went in the end
    to = scratch.keep(edges.coalesce(1).mapInPandas(least_linked, "a long, to long"))
    for joined in reversed(joins):
        far = lookup(joined, to.select(F.col("a").alias("to"), F.col("to").alias("end")), "to")
        to = scratch.keep(far.select("a", F.coalesce("end", "to").alias("to")).unionByName(to.join(joined, "a", "left_anti")))
    moved = ids.join(to.withColumnRenamed("a", "node_id"), "node_id", "left")
    labels = scratch.keep(moved.select("node_id", F.coalesce("to", "node_id").alias("label")))
    least = labels.groupBy("label").agg(F.min("node_id").alias("locus_id"))
    return lookup(labels, least, "label").select("node_id", "locus_id")


def extended(loci: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(locus_id, node_id, is_long): the unique contigs of `loci` and their neighbours that are not unique, signs ignored."""
    near = both_ways(pairs).select(F.abs("src").alias("node_id"), F.abs("dst").alias("near"))
    others = nodes.where("not is_unique").select(F.col("node_id").alias("near"))
    added = near.join(loci, "node_id").join(others, "near").select("locus_id", F.col("near").alias("node_id"), F.lit(False).alias("is_long"))
    return loci.select("locus_id", "node_id", F.lit(True).alias("is_long")).unionByName(added).distinct()


def sizes(loci: DataFrame) -> DataFrame:
    """(locus_id, contigs, long_contigs)."""
    return loci.groupBy("locus_id").agg(F.count("*").alias("contigs"), F.count_if("is_long").alias("long_contigs"))


def stop_codons(nodes: DataFrame) -> DataFrame:
    """(node_id, f0, f1, f2, r0, r1, r2): stop codons per frame, forwards and backwards."""
    frames = [codon_count(F.col("seq"), STOPS, i).alias(f"f{i}") for i in range(3)]
    frames += [codon_count(F.col("seq"), REVERSE_STOPS, i).alias(f"r{i}") for i in range(3)]
    return nodes.where("seq is not null").select("node_id", *frames)


def orientations(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(locus_id, votes, inverted): whether more bases of a locus read better backwards.

    A contig reads better in the direction of its frame with the fewest stop codons; it votes with its length,
    and not at all if both directions are equal.
    """
    stops = stop_codons(nodes).select("node_id", F.least("f0", "f1", "f2").alias("f"), F.least("r0", "r1", "r2").alias("r"))
    rows = nodes.select("node_id", "len").join(stops, "node_id").select(F.col("node_id").alias("contig"), "len", F.signum(F.col("f") - F.col("r")).cast("long").alias("back"))
    votes = members.withColumn("contig", F.abs("node_id")).join(rows, "contig")
    sign = F.signum(F.col("node_id").cast("double")).cast("long")
    summed = votes.groupBy("locus_id").agg(F.sum(F.col("len") * F.col("back") * sign).alias("votes"))
    return summed.withColumn("inverted", F.col("votes") > 0)


def reverted(members: DataFrame, inverted: DataFrame) -> DataFrame:
    """`members` with all contigs of inverted loci turned round."""
    turned = members.join(inverted.select("locus_id", "inverted"), "locus_id", "left")
    return turned.withColumn("node_id", F.when(F.col("inverted"), -F.col("node_id")).otherwise(F.col("node_id"))).drop("inverted")


def simplified(members: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, max_branch: int = 100) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) without the contigs that are similar to another one between the same two neighbours.

    Their connections go to the contig that stays, with counts and weights added up. Again and again, since branches
    become neighbours; each round but the last takes contigs away. `members` is (locus_id, node_id, ord, is_long); a
    contig that stays is in every locus of one that went to it.
    """
    scratch = Scratch(members.sparkSession)
    while True:
        moved = merge_map(simple_bubbles(pairs, nodes, k, max_branch), nodes)
        if moved.isEmpty():
            return members, pairs
        ends = moved_ends(moved_ends(pairs, moved, "src"), moved, "dst").where("abs(src) <> abs(dst)")
        both = ends.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        sums = (F.sum(c).alias(c) for c in ("direct_count", "paired_count", "weight"))
        nearest = (F.min_by(c, F.struct("variance", "distance")).alias(c) for c in ("distance", "variance"))
        pairs = scratch.keep(both.agg(*nearest, *sums, F.bool_or("active").alias("active")))
        left = moved_ends(members, moved, "node_id").groupBy("locus_id", F.abs("node_id").alias("contig"))
        members = scratch.keep(left.agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("node_id"), F.min("ord").alias("ord"), F.bool_or("is_long").alias("is_long")).drop("contig"))


def renumbered(members: DataFrame, dropped: DataFrame) -> DataFrame:
    """`members` without the contigs of `dropped` (node_id), on either strand; `ord` counts the others from 0 in their order."""
    gone = dropped.select(F.col("node_id").alias("contig"))
    left = members.withColumn("contig", F.abs("node_id")).join(gone, "contig", "left_anti").select("locus_id", "node_id", F.col("ord").alias("was"), "is_long")
    placed = numbered_within(left, "locus_id", "place", "was", "node_id")
    return placed.select("locus_id", "node_id", (F.col("place") - 1).cast("int").alias("ord"), "is_long")


def locus_edges(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(locus_id, src, dst, distance, weight): active connections between two oriented contigs of one locus; dst follows src."""
    steps = both_ways(pairs.where("active")).select("src", (-F.col("dst")).alias("dst"), "distance", "weight")
    first = steps.join(members.select("locus_id", F.col("node_id").alias("src")), "src")
    return first.join(members.select("locus_id", F.col("node_id").alias("dst")), ["locus_id", "dst"]).select("locus_id", "src", "dst", "distance", "weight")


def degree_histogram(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(locus_id, d0, d1, d2, d3): each contig counts once by its out-degree and once by its in-degree, 3 meaning 3 or more."""
    ends = edges.select("locus_id", F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select("locus_id", F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    ends = ends.unionByName(members.select("locus_id", "node_id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    both = ends.groupBy("locus_id", "node_id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    bins = [F.sum(F.when(F.least("o", F.lit(3)) == d, 1).otherwise(0) + F.when(F.least("i", F.lit(3)) == d, 1).otherwise(0)).alias(f"d{d}") for d in range(4)]
    return both.groupBy("locus_id").agg(*bins)


def shapes(histogram: DataFrame) -> DataFrame:
    """`histogram` with the shape of each locus."""
    shape = (
        F.when(F.expr("d0 = 2 and d2 = 0 and d3 = 0"), "LINEAR")
        .when(F.expr("d0 = 3 and d2 = 1 and d3 = 0"), "FORK")
        .when(F.expr("d0 = 2 and d2 = 2 and d3 = 0"), "BUBBLE")
        .otherwise("UNKNOWN")
    )
    return histogram.withColumn("shape", shape)
