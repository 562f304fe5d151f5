"""k-mer counts of reads that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions.dna import canonical, clean_sequence, kmers


def read_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """Reads from Parquet files as they appear in `folder`, with the columns of `like`."""
    return spark.readStream.schema(like.schema).parquet(folder)


def kmer_counts_stream(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n) over all reads so far, for output modes update and complete; a repeated delivery counts again."""
    runs = reads.select(F.explode(kmers(clean_sequence(F.col("seq")), k)).alias("run")).where(~F.col("run").rlike("[^ACGT]"))
    return runs.groupBy(canonical(F.col("run")).alias("kmer")).agg(F.count("*").alias("n"))


def reads_per_window(reads: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, category, reads): different reads loaded per window; deliveries later than `late` are dropped, repeated ones count once."""
    once = reads.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["read_id"])
    return once.groupBy(F.window("loaded_at", width), "category").agg(F.count("*").alias("reads"))
