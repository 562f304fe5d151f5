"""Unbranched chains of contigs become one contig each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.operators import graph
from strandwork.shared import Scratch, lookup


def on_strand(signed: Column, seq: Column) -> Column:
    """The bases of a contig in the direction of its sign."""
    return F.when(signed > 0, seq).otherwise(F.reverse(F.translate(seq, "ACGT", "TGCA")))


def overlapping(links: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The links whose source ends with the k-1 bases that their target begins with; others skip something between."""
    ends = nodes.select(F.col("node_id").alias("contig"), F.left("seq", F.lit(k - 1)).alias("head"), F.right("seq", F.lit(k - 1)).alias("tail"))
    turned = {c: F.reverse(F.translate(c, "ACGT", "TGCA")) for c in ("head", "tail")}
    rows = links.withColumn("contig", F.abs("src")).join(ends, "contig")
    rows = rows.select("src", "dst", F.when(F.col("src") > 0, F.col("tail")).otherwise(turned["head"]).alias("ending"))
    rows = rows.withColumn("contig", F.abs("dst")).join(ends, "contig")
    return rows.where(F.col("ending") == F.when(F.col("dst") > 0, F.col("head")).otherwise(turned["tail"])).select("src", "dst")


def chain_members(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(contig, stays, side, before, total): where each contig of a chain of `links` lies in the contig that it becomes.

    Of a chain and its reverse the one stands whose smallest contig is on its given strand; that contig's id, `stays`,
    becomes the id of all. `side` is 1 or -1, the contig's strand there, `before` and `total` count k-mers.
    """
    scratch = Scratch(nodes.sparkSession)
    chains = scratch.keep(graph.chains_of(links))
    chosen = chains.groupBy("chain").agg(F.min_by("node_id", F.abs("node_id")).alias("stays")).where("stays > 0")
    rows = chains.join(chosen, "chain").select(F.abs("node_id").alias("contig"), "stays", F.signum("node_id").cast("long").alias("side"), "step")
    rows = rows.join(nodes.select(F.col("node_id").alias("contig"), "len"), "contig")
    chain = Window.partitionBy("stays")
    before = F.sum("len").over(chain.orderBy("step")) - F.col("len")
    return scratch.keep(rows.select("contig", "stays", "side", "step", before.alias("before"), F.sum("len").over(chain).alias("total")))


def joined_nodes(nodes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(node_id, seq, len, cov): `nodes` with the contigs of each chain as one; k-mers and coverage are added up."""
    rows = nodes.join(members.withColumnRenamed("contig", "node_id"), "node_id", "left")
    whole = on_strand(F.coalesce("side", F.lit(1)), F.col("seq"))
    piece = F.when(F.coalesce("step", F.lit(0)) == 0, whole).otherwise(F.substr(whole, F.lit(k)))
    rows = rows.select(F.coalesce("stays", "node_id").alias("node_id"), F.struct(F.coalesce("step", F.lit(0)).alias("step"), piece.alias("bases")).alias("part"), "len", "cov")
    alone = rows.groupBy("node_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("len").cast("int").alias("len"), F.sum("cov").alias("cov"))
    return alone.select("node_id", F.array_join(F.transform("parts", lambda p: p["bases"]), "").alias("seq"), "len", "cov")


def joined_arcs(arcs: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, multiplicity) of `arcs` between the contigs that chains become; `links` are inside them now.

    The link that closes a ring is one from the new contig to itself and stays.
    """
    at = members.select("contig", "stays", "side", "step")
    rows = arcs.join(links.withColumn("inside", F.lit(True)), ["src", "dst"], "left")
    for end in ("src", "dst"):
        named = at.select(*(F.col(c).alias(f"{end}_{c}") for c in at.columns))
        rows = lookup(rows.withColumn(f"{end}_contig", F.abs(end)), named, f"{end}_contig")
    along = (F.col("dst_step") - F.col("src_step")) * F.signum("src") * F.col("src_side")
    rows = rows.where(F.coalesce(~(F.col("inside") & (along == 1)), F.lit(True)))
    ends = (F.coalesce(F.col(f"{e}_stays") * F.signum(e).cast("long") * F.col(f"{e}_side"), F.col(e)).alias(e) for e in ("src", "dst"))
    return rows.select(*ends, "multiplicity").groupBy("src", "dst").agg(F.sum("multiplicity").alias("multiplicity"))


def joined_occurrences(occ: DataFrame, members: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(read_id, node_id, pos, off): the places of reads on the contigs that chains become, one for each time a read comes there."""
    size = members.join(nodes.select(F.col("node_id").alias("contig"), "len"), "contig").drop("step")
    rows = lookup(occ.withColumn("contig", F.abs("node_id")), size, "contig")
    strand = F.signum("node_id").cast("long") * F.col("side")
    start = F.when(strand > 0, F.col("before")).otherwise(F.col("total") - F.col("before") - F.col("len"))
    placed = rows.select("read_id", F.coalesce(strand * F.col("stays"), "node_id").alias("node_id"), (F.coalesce(start, F.lit(0)) + F.col("pos")).alias("pos"), "off")
    return graph.one_place_a_run(placed, k)


def join_chains(nodes: DataFrame, arcs: DataFrame, occ: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(nodes, arcs, occ, joined): each unbranched chain of contigs as one contig, and how many contigs were taken in.

    `nodes` is (node_id, seq, len, cov), `arcs` holds every arc with its twin, `occ` is (read_id, node_id, pos, off).
    A link counts if it is the only arc out of its source and into its target and the two overlap by k-1 bases.
    Without such links everything stays as it is. Other columns are not carried.
    """
    scratch = Scratch(nodes.sparkSession)
    links = scratch.keep(overlapping(graph.chain_links(arcs), nodes, k))
    if links.isEmpty():
        return nodes, arcs, occ, 0
    members = chain_members(nodes, links)
    out = joined_nodes(nodes, members, k), joined_arcs(arcs, members, links), joined_occurrences(occ, members, nodes, k)
    return *(scratch.keep(t) for t in out), members.where("contig <> stays").count()
