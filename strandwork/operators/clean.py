"""Tables of a data folder as the operators need them: one row per thing, no nulls in keys.

All of these treat a repeated delivery as one row and leave out rows whose key is null (ids of contigs also if 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.dna import clean_sequence


def reads(df: DataFrame) -> DataFrame:
    """(read_id, mate_id, category, seq): sequences trimmed and in upper case, null if blank."""
    rows = df.where("read_id is not null").select("read_id", "mate_id", "category", clean_sequence(F.col("seq")).alias("seq"))
    return rows.groupBy("read_id").agg(*(F.min(c).alias(c) for c in ("mate_id", "category", "seq")))


def leading_references(reads: DataFrame, is_reference: Column) -> DataFrame:
    """(references): how many reads there are before the first that is no reference, by read_id."""
    known = reads.select("read_id", F.coalesce(is_reference, F.lit(False)).alias("is_reference"))
    first = known.agg(F.min(F.when(~F.col("is_reference"), F.col("read_id"))).alias("first"))
    return known.join(F.broadcast(first), F.col("first").isNull() | (F.col("read_id") < F.col("first"))).agg(F.count("*").alias("references"))


def detached(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, category): the reads of pairs one of which is shorter than `k`, with the even category that they get instead."""
    paired = reads.where("category % 2 = 1 and mate_id is not null")
    short = paired.where(F.coalesce(F.length("seq"), F.lit(0)) < k)
    hit = short.select("read_id").unionByName(short.select(F.col("mate_id").alias("read_id"))).distinct()
    return paired.join(hit, "read_id", "left_semi").select("read_id", (F.col("category") - 1).cast("short").alias("category"))


def nodes(df: DataFrame) -> DataFrame:
    """(node_id, seq, len, cov, is_unique) by positive id; null coverage counts as 0, null uniqueness as false."""
    rows = df.where("node_id is not null and node_id <> 0")
    grouped = rows.groupBy(F.abs("node_id").alias("node_id"))
    largest = (F.max(c).alias(c) for c in ("seq", "len"))
    return grouped.agg(*largest, F.coalesce(F.max("cov"), F.lit(0)).alias("cov"), F.coalesce(F.bool_or("is_unique"), F.lit(False)).alias("is_unique"))


def occurrences(df: DataFrame) -> DataFrame:
    """(read_id, node_id, pos, off): where reads lie on contigs, without the ambiguous ones."""
    rows = df.where("read_id is not null and node_id <> 0 and node_position is not null and read_offset is not null")
    rows = rows.where("not (node_position = -1 and read_offset = -1)")
    return rows.select("read_id", "node_id", F.col("node_position").alias("pos"), F.col("read_offset").alias("off")).distinct()


def links(df: DataFrame) -> DataFrame:
    """One row per unordered pair of signed ends, least first: (src, dst, distance, variance, weight, direct_count, paired_count, active).

    Pairs of an end with itself or its twin are left out. Of rows that differ, the least distance and variance
    and the largest weight and counts stand; the pair is active if any row says so.
    """
    rows = df.where("src <> 0 and dst <> 0 and abs(src) <> abs(dst)")
    grouped = rows.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return grouped.agg(
        F.min("distance").alias("distance"),
        F.min("variance").alias("variance"),
        F.max("weight").alias("weight"),
        F.max("direct_count").alias("direct_count"),
        F.max("paired_count").alias("paired_count"),
        F.coalesce(F.bool_or("active"), F.lit(False)).alias("active"),
    )


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair of `links` from either end."""
    other = pairs.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return pairs.unionByName(other)


def members(df: DataFrame) -> DataFrame:
    """(locus_id, node_id, ord, is_long): each contig of a locus once, in the orientation and place of its first listing."""
    rows = df.where("locus_id is not null and node_id is not null and node_id <> 0")
    first = F.min(F.struct(F.coalesce("ord", F.lit(2**31 - 1)).alias("ord"), "node_id")).alias("first")
    grouped = rows.groupBy("locus_id", F.abs("node_id").alias("contig")).agg(first, F.coalesce(F.bool_or("is_long"), F.lit(False)).alias("is_long"))
    return grouped.select("locus_id", "first.node_id", "first.ord", "is_long")


def paths(df: DataFrame) -> DataFrame:
    """(locus_id, transcript_id, node_path, gaps, confidence) of transcripts with a locus, an id and a path."""
    rows = df.where("locus_id is not null and transcript_id is not null and size(node_path) > 0")
    return rows.groupBy("transcript_id").agg(*(F.min(c).alias(c) for c in ("locus_id", "node_path", "gaps", "confidence")))


def libraries(df: DataFrame) -> DataFrame:
    """(category, mean, sd) of libraries whose insert length is known; sd is a tenth of it if not given."""
    rows = df.where("category is not null and mean > 0").groupBy("category").agg(F.max("mean").alias("mean"), F.max("sd").alias("sd"))
    return rows.select("category", F.col("mean").cast("double").alias("mean"), F.coalesce(F.col("sd").cast("double"), F.col("mean") / 10).alias("sd"))
