"""Queries whose keys are uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators.skew import count_distinct_by_tree, stale_contig_counts
from strandwork.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    stale = stale_contig_counts(table(spark, folder, "loci", "locus_id", "contig_count"), table(spark, folder, "locus_nodes", "locus_id", "node_id"))
    return stale.select("locus_id").distinct()


def p5_contig_counts(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "locus_nodes", "locus_id", "node_id")
    contigs = listed.select("locus_id", F.abs(F.nullif(F.col("node_id"), F.lit(0))).alias("contig"))
    return count_distinct_by_tree(contigs, "locus_id", "contig", "contigs")


QUERIES = {"p5_found": p5_found, "p5_contig_counts": p5_contig_counts}

SQL = {
    "p5_found": """
        with listed as (select locus_id, count(distinct abs(node_id)) as n from locus_nodes where node_id <> 0 group by 1)
        select distinct l.locus_id from loci l left join listed on listed.locus_id = l.locus_id
        where l.locus_id is not null and l.contig_count <> coalesce(n, 0)""",
    "p5_contig_counts": """
        select locus_id, count(distinct abs(node_id)) as contigs from locus_nodes
        where locus_id is not null and node_id <> 0 group by 1""",
}
