"""Alternative splicing events of loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.dna import poly_a_signal, reverse_complement


def _oriented(nodes: DataFrame, name: str) -> DataFrame:
    """(name, seq, len) for both orientations of each contig with a sequence."""
    rows = nodes.where("seq is not null")
    turned = rows.select((-F.col("node_id")).alias(name), reverse_complement(F.col("seq")).alias("seq"), "len")
    both = rows.select(F.col("node_id").alias(name), "seq", "len").unionByName(turned)
    return both.select(name, F.struct("seq", "len").alias(f"{name}_is"))


def _junction(before: Column, after: Column, k: int, site: str) -> Column:
    """Whether `site` lies in the last 3 bases before a junction and the first 5 after it, which begin at base k."""
    return F.concat(F.right(before, F.lit(3)), F.substr(after, F.lit(k), F.lit(5))).contains(site)


def splice_events(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(locus_id, event, n0, n1, n2, n3): what happens after each contig n0 with exactly two edges out.

    n1 is the longer of the two next contigs (of equals the smaller id), n2 the other, n3 where both meet again, if they
    do. If n1 is shorter than 2k-1 there is no event. If only n2 is and both meet again: intron_retention with
    a donor and an acceptor site, alternative_5prime_splice with a donor, alternative_3prime_splice with an
    acceptor, else skipped_exon. If neither is: alternative_polyA where n0 and n1 have a poly-A signal, and
    mutually_exclusive_exons where both meet again; both can hold.
    """
    out = edges.groupBy("locus_id", F.col("src").alias("node_id")).agg(F.count("*").alias("n"), F.min("dst").alias("one"), F.max("dst").alias("two"))
    forks = out.where("n = 2").select("locus_id", F.col("node_id").alias("n0"), "one", "two")
    single = out.where("n = 1").select("locus_id", "node_id", F.col("one").alias("next"))
    for name in ("n0", "one", "two"):
        forks = forks.join(_oriented(nodes, name), name)
    swap = F.col("two_is.len") > F.col("one_is.len")
    pick = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    rows = forks.select(
        "locus_id", "n0", "n0_is", pick("two", "one").alias("n1"), pick("two_is", "one_is").alias("n1_is"), pick("one", "two").alias("n2"), pick("one_is", "two_is").alias("n2_is")
    ).where(F.col("n1_is.len") >= 2 * k - 1)
    for name in ("n1", "n2"):
        rows = rows.join(single.select("locus_id", F.col("node_id").alias(name), F.col("next").alias(f"{name}_next")), ["locus_id", name], "left")
    rows = rows.withColumn("n3", F.when(F.col("n1_next") == F.col("n2_next"), F.col("n1_next")))
    rows = rows.join(_oriented(nodes, "n3"), "n3", "left")
    donor = _junction(F.col("n0_is.seq"), F.col("n1_is.seq"), k, "GT")
    acceptor = _junction(reverse_complement(F.col("n3_is.seq")), reverse_complement(F.col("n1_is.seq")), k, "CA")
    spliced = F.when(donor & acceptor, "intron_retention").when(donor, "alternative_5prime_splice").when(acceptor, "alternative_3prime_splice").otherwise("skipped_exon")
    short = F.col("n2_is.len") < 2 * k - 1
    polya = F.when(~short & poly_a_signal(F.col("n0_is.seq")) & poly_a_signal(F.col("n1_is.seq")), "alternative_polyA")
    exclusive = F.when(~short & F.col("n3").isNotNull(), "mutually_exclusive_exons")
    events = F.array_compact(F.array(F.when(short & F.col("n3").isNotNull(), spliced), polya, exclusive))
    told = rows.select("locus_id", F.explode(events).alias("event"), "n0", "n1", "n2", "n3")
    return told.withColumn("n3", F.when(F.col("event") != "alternative_polyA", F.col("n3")))
