"""The contig graph: arcs, degrees, coverage, weak arcs, tips, unbranched chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.shared import Scratch, lookup, numbered_within


def arcs_of_reads(occ: DataFrame, nodes: DataFrame, heavy: list | None = None) -> DataFrame:
    """(src, dst, multiplicity): contigs that follow each other on a read, and the same of the twins.

    A read's occurrences are few once repeats are gone (no more than its bases), so its window is small. `heavy` are the
    contigs with very many reads; if not given, they are counted in `occ`.
    """
    known = lookup(occ.withColumn("contig", F.abs("node_id")), nodes.select(F.col("node_id").alias("contig")), "contig", "left_semi", heavy)
    next_ = F.lead("node_id").over(Window.partitionBy("read_id").orderBy("off", "pos", "node_id"))
    steps = known.withColumn("dst", next_).where("dst is not null").select(F.col("node_id").alias("src"), "dst")
    twins = steps.where("src <> -dst").select((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"))
    return steps.unionByName(twins).groupBy("src", "dst").agg(F.count("*").alias("multiplicity"))


def stats(nodes: DataFrame) -> DataFrame:
    """(contigs, kmers, longest, n50): one row; half of all k-mers lie in contigs of n50 k-mers or more."""
    sized = nodes.where("len > 0").select("len")
    # by length first: as many rows as there are lengths, however many contigs
    by_len = sized.groupBy("len").agg(F.count("*").alias("n"), F.sum("len").alias("k"))
    longer = Window.orderBy(F.desc("len"))
    total = F.sum("k").over(Window.partitionBy(F.lit(1)))
    rows = by_len.withColumn("upto", F.sum("k").over(longer)).withColumn("total", total)
    half = F.max(F.when(F.col("upto") * 2 >= F.col("total"), F.col("len"))).cast("long")
    return rows.agg(F.sum("n").alias("contigs"), F.sum("k").alias("kmers"), F.max("len").cast("long").alias("longest"), half.alias("n50"))


def one_place_a_run(places: DataFrame, slack: int) -> DataFrame:
    """(read_id, node_id, pos, off): of the places of a read on a contig, the first of each run.

    A run goes along the contig as the read does, but for `slack`; a read that comes back to a contig has a run each time.
    """
    along = Window.partitionBy("read_id", "node_id").orderBy("off", "pos")
    ahead = F.col("pos") - F.col("off")
    new = F.coalesce((F.abs(ahead - F.lag(ahead).over(along)) > slack).cast("int"), F.lit(1))
    runs = places.withColumn("__new", new).withColumn("__run", F.sum("__new").over(along))
    first = F.min(F.struct("off", "pos")).alias("first")
    return runs.groupBy("read_id", "node_id", "__run").agg(first).select("read_id", "node_id", "first.pos", "first.off")


def degrees(arcs: DataFrame) -> DataFrame:
    """(node_id, outdeg, indeg) by signed id."""
    ends = arcs.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        arcs.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("node_id").agg(F.sum("o").alias("outdeg"), F.sum("i").alias("indeg"))


def unique_nodes(nodes: DataFrame, arcs: DataFrame, unique_length: int = 50, cutoff: int = 3) -> DataFrame:
    """Nodes longer than `unique_length` with at most `cutoff` arcs on either side."""
    both = degrees(arcs).where("node_id > 0")
    rows = nodes.join(both, "node_id", "left").select("node_id", "len", F.coalesce("outdeg", F.lit(0)).alias("outdeg"), F.coalesce("indeg", F.lit(0)).alias("indeg"))
    return rows.where((F.col("len") > unique_length) & (F.col("outdeg") <= cutoff) & (F.col("indeg") <= cutoff))


def low_coverage_nodes(nodes: DataFrame, cutoff: float, keep: DataFrame | None = None) -> DataFrame:
    """Nodes whose coverage per k-mer is below `cutoff`; nodes of length 0 and those of `keep` are skipped."""
    low = nodes.where((F.col("len") > 0) & (F.col("cov") / F.col("len") < cutoff)).select("node_id", "len", "cov")
    return low if keep is None else low.join(keep, "node_id", "left_anti")


def nodes_of_reads(occ: DataFrame, reads: DataFrame) -> DataFrame:
    """(node_id): contigs that one of `reads` lies on, on either strand."""
    return occ.join(reads, "read_id", "left_semi").select(F.abs("node_id").alias("node_id")).distinct()


def total_coverage(nodes: DataFrame, occ: DataFrame, long_reads: DataFrame, k: int) -> DataFrame:
    """(node_id, coverage): the coverage of short reads and the k-mers of `long_reads` (read_id, seq) that lie on each contig.

    A long read lies on a contig from its place on, to the end of the one or the other.
    """
    size = long_reads.select("read_id", F.greatest(F.length("seq") - (k - 1), F.lit(0)).alias("kmers"))
    hits = occ.join(size, "read_id").select("pos", "off", "kmers", F.abs("node_id").alias("node_id"))
    # what all places of a contig lack to its length is not known before the contig is, so places are kept apart as they are
    spans = hits.groupBy("node_id", "pos", "off", "kmers").agg(F.count("*").alias("n")).join(nodes.select("node_id", "len"), "node_id")
    covered = F.greatest(F.least(F.col("len") - F.col("pos"), F.col("kmers") - F.col("off")), F.lit(0))
    more = spans.groupBy("node_id").agg(F.sum(covered * F.col("n")).alias("more"))
    return nodes.join(more, "node_id", "left").select("node_id", (F.col("cov") + F.coalesce("more", F.lit(0))).alias("coverage"))


def seed_order(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node_id, indeg, place): all oriented contigs by the arcs that lead to them, fewest first, ties by signed id; from 1."""
    into = arcs.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("indeg"))
    both = nodes.select("node_id").unionByName(nodes.select((-F.col("node_id")).alias("node_id")))
    rows = both.join(into, "node_id", "left").select(F.lit(0).alias("all"), "node_id", F.coalesce("indeg", F.lit(0)).alias("indeg"))
    return numbered_within(rows, "all", "place", "indeg", "node_id").drop("all")


def dubious_reads(occ: DataFrame, dropped: DataFrame, heavy: list | None = None) -> DataFrame:
    """Reads that lie on a dropped node, on either strand."""
    placed = occ.select("read_id", F.abs("node_id").alias("node_id"))
    return lookup(placed, dropped.select("node_id"), "node_id", "left_semi", heavy).select("read_id").distinct()


def low_fraction_arcs(arcs: DataFrame, fraction: float, among: DataFrame | None = None) -> DataFrame:
    """Arcs, of those `among` if given, with less than `fraction` of the multiplicity that leaves their source (sums come from all arcs, before any is dropped)."""
    total = arcs.groupBy("src").agg(F.sum("multiplicity").alias("total"))
    weak = arcs.join(total, "src").where(F.col("multiplicity") < F.col("total") * fraction)
    return weak if among is None else weak.join(among, ["src", "dst"], "left_semi")


def reads_along(occ: DataFrame, arcs: DataFrame) -> DataFrame:
    """(read_id): reads that lie on both contigs of an arc, as it leads."""
    first = lookup(occ.select("read_id", F.col("node_id").alias("src")), arcs.groupBy("src").agg(F.collect_set("dst").alias("dst")), "src", "inner")
    steps = first.select("read_id", F.explode("dst").alias("node_id")).distinct()
    return steps.join(occ.select("read_id", "node_id").distinct(), ["read_id", "node_id"], "left_semi").select("read_id").distinct()


def tips(nodes: DataFrame, arcs: DataFrame, k: int, keep: DataFrame | None = None) -> DataFrame:
    """Nodes shorter than 2k, by their own length, without an arc on one side; those of `keep` are none."""
    nodes = nodes if keep is None else nodes.join(keep, "node_id", "left_anti")
    signed = nodes.select("node_id", "len").unionByName(nodes.select((-F.col("node_id")).alias("node_id"), "len"))
    out = arcs.groupBy("src").agg(F.count("*").alias("out"))
    dead = signed.join(out, signed.node_id == out.src, "left").where("out is null and len < 2 * %d" % k)
    return dead.select(F.abs("node_id").alias("node_id")).distinct()


def minority_tips(nodes: DataFrame, arcs: DataFrame, k: int) -> DataFrame:
    """(node_id): tips that a stronger branch goes past, and those that stand alone.

    The tip's only arc comes from a contig with two arcs or more in that direction, and is not the one of largest
    multiplicity, of equals that to the smaller signed contig. A tip that joins two contigs is none.
    """
    signed = nodes.select("node_id", "len").unionByName(nodes.select((-F.col("node_id")).alias("node_id"), "len"))
    out = arcs.groupBy("src").agg(F.count("*").alias("out"))
    dead = signed.join(out, signed.node_id == out.src, "left_anti").where("len < 2 * %d" % k)
    into = arcs.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n"), F.min("src").alias("src"))
    best = arcs.groupBy("src").agg(F.count("*").alias("branches"), F.max_by("dst", F.struct("multiplicity", (-F.col("dst")).alias("o"))).alias("best"))
    rows = dead.join(into, "node_id", "left").join(best, "src", "left")
    minor = F.col("n").isNull() | ((F.col("n") == 1) & (F.col("branches") > 1) & (F.col("best") != F.col("node_id")))
    return rows.where(minor).select(F.abs("node_id").alias("node_id")).distinct()


def clip_tips(nodes: DataFrame, arcs: DataFrame, k: int) -> DataFrame:
    """The nodes that stay when tips are clipped again and again until none is left."""
    scratch = Scratch(nodes.sparkSession)
    nodes, arcs = scratch.keep(nodes.select("node_id", "len")), scratch.keep(arcs.select("src", "dst"))
    while True:
        short = scratch.keep(tips(nodes, arcs, k))
        if short.isEmpty():
            return nodes
        nodes = scratch.keep(nodes.join(short, "node_id", "left_anti"))
        for end in ("src", "dst"):
            arcs = arcs.join(short, F.abs(end) == short.node_id, "left_anti")
        arcs = scratch.keep(arcs)


def chain_links(arcs: DataFrame) -> DataFrame:
    """Arcs between two different contigs that are the only one out of the source and the only one into the target."""
    alone_out = arcs.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").drop("n")
    alone_in = arcs.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n = 1").drop("n")
    return alone_out.join(alone_in, ["src", "dst"]).where("abs(src) <> abs(dst)")


def steps_back(scratch: Scratch, back: DataFrame) -> DataFrame:
    """(node, to, far, least, done) for `back` (node, to), in which no node has two rows and none is `to` twice.

    By pointer jumping: after as many rounds as the longest chain has binary digits, `to` is the chain's
    beginning, `far` steps back, and `done` is true; on a ring, done stays false and `least` is its least node.
    """
    begins = back.select(F.col("to").alias("node")).distinct().join(back, "node", "left_anti")
    first = back.select("node", "to", F.lit(1).alias("far"), F.least("node", "to").alias("least"), F.lit(False).alias("done"))
    state = scratch.keep(first.unionByName(begins.select("node", F.col("node").alias("to"), F.lit(0).alias("far"), F.col("node").alias("least"), F.lit(True).alias("done"))))
    while True:
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
        both = state.join(ahead, "to")
        after = both.select(
            "node",
            F.when(F.col("done"), F.col("to")).otherwise(F.col("to2")).alias("to"),
            (F.col("far") + F.when(F.col("done"), 0).otherwise(F.col("far2"))).alias("far"),
            F.least("least", "least2").alias("least"),
            F.coalesce(F.col("done") | F.col("done2"), F.lit(False)).alias("done"),
            ((F.col("done") != F.col("done2")) | (F.col("least2") < F.col("least"))).alias("changed"),
        )
        kept = scratch.keep(after)
        scratch.drop(state)
        state = kept
        if state.where("changed").isEmpty():
            return state.drop("changed")


def chains(arcs: DataFrame) -> DataFrame:
    """(node_id, chain, step): the unbranched chains of oriented contigs.

    `chain` is the contig at its beginning, `step` the place from there, 0 first. A ring begins at its least
    contig. Contigs without a chain link are left out. The reverse of each chain is there too.
    """
    return chains_of(chain_links(arcs))


def chains_of(links: DataFrame) -> DataFrame:
    """`chains` of given links (src, dst), of which no contig has two on one side."""
    scratch = Scratch(links.sparkSession)
    back = scratch.keep(links.select(F.col("dst").alias("node"), F.col("src").alias("to")))
    state = steps_back(scratch, back)
    rings = state.where("not done").select("node", "least")
    cut = scratch.keep(back.join(rings, "node").where("node <> least").select("node", "to"))
    opened = state.where("done")
    if not cut.isEmpty():
        opened = opened.unionByName(steps_back(scratch, cut))
    return opened.select(F.col("node").alias("node_id"), F.col("to").alias("chain"), F.col("far").alias("step"))


def shared_reads(occ: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, reads): how many reads lie on both contigs of each pair of `pairs`, signs ignored.

    Starts from the reads: what is paired are a read's few contigs, so a contig with very many reads is
    never matched against another one row by row.
    """
    on = occ.select("read_id", F.abs("node_id").alias("contig")).distinct()
    a, b = on.withColumnRenamed("contig", "src"), on.withColumnRenamed("contig", "dst")
    common = a.join(b, "read_id").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("reads"))
    asked = pairs.select(F.least(F.abs("src"), F.abs("dst")).alias("src"), F.greatest(F.abs("src"), F.abs("dst")).alias("dst")).where("src <> dst").distinct()
    return asked.join(common, ["src", "dst"])
