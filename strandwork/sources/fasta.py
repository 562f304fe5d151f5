"""FASTA as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwork.shared import Scratch


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, id, category, seq): one row per record of the FASTA files at `path`.

    A header is `>name`, or `>name<tab>id<tab>category`; id and category are null if not given or no numbers. Files
    are split at headers, so large files are read by many tasks; a record lies whole in one. Sequences are joined
    over their lines and put in upper case; an empty file or a record without a name gives no row.
    """
    return _records(spark, path).drop("file", "split", "at").where("name <> ''")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """`read_fasta` with where each record lies: file, beginning of the split, and a number that rises within the split."""
    text = spark.read.option("lineSep", "\n>").text(path)
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    records = text.select(F.regexp_replace("value", "\r", "").alias("record"), *place)
    record = F.regexp_replace("record", "^>", "")
    parts = records.select(F.split(F.substring_index(record, "\n", 1), "\t").alias("head"), F.regexp_extract(record, r"(?s)^[^\n]*\n(.*)$", 1).alias("body"), "file", "split", "at")
    number = lambda i, kind: F.try_element_at("head", F.lit(i)).try_cast(kind)
    return parts.select(
        F.trim(F.col("head")[0]).alias("name"), number(2, "long").alias("id"), number(3, "short").alias("category"), F.upper(F.regexp_replace("body", r"\s", "")).alias("seq"), "file", "split", "at"
    )


def read_numbered_fasta(spark: SparkSession, path: str, category: int = 0) -> DataFrame:
    """(name, id, category, seq) as `read_fasta`, with nothing missing: ids count from 1 in the order of files and records.

    The given ids stand if every record has one. Records without a category get `category`. How many records each split
    has is added up, so only that small table is put in one order.
    """
    rows = Scratch(spark).keep(_records(spark, path))
    if not rows.where("name <> '' and id is null").isEmpty():
        splits = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
        before = splits.withColumn("before", F.sum("n").over(Window.orderBy("file", "split")) - F.col("n")).drop("n")
        rows = rows.join(before, ["file", "split"]).withColumn("id", F.col("before") + F.col("at") - F.col("first") + 1)
    return rows.where("name <> ''").select("name", "id", F.coalesce("category", F.lit(category)).cast("short").alias("category"), "seq")


def pair_up(reads: DataFrame, order: str) -> DataFrame:
    """`reads` with mate_id: of paired reads (odd category) the neighbour, first with second, by the numbers in `order`.

    `order` counts the reads of a file from 1 without gaps, as its ids do; so a mate is found by arithmetic.
    """
    first = F.col(order) % 2 == 1
    mate = F.when(F.col("category") % 2 == 1, F.when(first, F.col(order) + 1).otherwise(F.col(order) - 1))
    return reads.withColumn("mate_id", mate)
