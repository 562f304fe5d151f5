"""The values that most records have, in bounded memory."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.shared import Scratch, lookup


@dataclass(frozen=True)
class Hashes:
    """`count` hashes, each with a coarse counter for about every `rows_each` rows of the input, `least` counters at least.

    The counters are a distributed table. Full buckets, of which there are at most rows / threshold, are broadcast
    if that is no more than `broadcast`, else joined by a shuffle.
    """

    count: int = 3
    rows_each: int = 64
    least: int = 1 << 16
    broadcast: int = 1 << 20

    def buckets(self, rows: int) -> int:
        return max(self.least, 1 << math.ceil(math.log2(max(rows / self.rows_each, 1))))

    def of(self, mark: Column, buckets: int) -> list[Column]:
        """A bucket under each hash; `mark` is a 64-bit hash of the value, so a long value is read once."""
        return [F.pmod(F.xxhash64(F.lit(i), mark), F.lit(buckets)) for i in range(self.count)]


def bucket_counts(values: DataFrame, value: str, hashes: Hashes, buckets: int) -> DataFrame:
    """(hash, bucket, rows): exact row counts per bucket under each hash, combined in every task before the shuffle."""
    pairs = F.array(*(F.struct(F.lit(i).alias("hash"), b.alias("bucket")) for i, b in enumerate(hashes.of(F.col("mark"), buckets))))
    return values.select(F.xxhash64(value).alias("mark")).select(F.inline(pairs)).groupBy("hash", "bucket").agg(F.count("*").alias("rows"))


def reaching(values: DataFrame, value: str, counts: DataFrame, least: int, hashes: Hashes, buckets: int, rows: int) -> DataFrame:
    """Rows of `values` whose value lies in a bucket of `least` rows or more under every hash.

    Every value with `least` rows or more is among them, since its buckets hold at least its own rows. `rows` bounds the
    rows of `values`, so `rows` / `least` the full buckets of a hash.
    """
    few = rows / least <= hashes.broadcast
    values = values.withColumn("__mark", F.xxhash64(value))
    for i, bucket in enumerate(hashes.of(F.col("__mark"), buckets)):
        full = counts.where((F.col("hash") == i) & (F.col("rows") >= least))
        values = values.withColumn("__bucket", bucket)
        if few:
            values = values.join(F.broadcast(full.select(F.col("bucket").alias("__bucket"))), "__bucket", "left_semi")
        else:
            heavy = [row[0] for row in full.where(F.col("rows") > rows / 1000).select("bucket").collect()]  # fewer than 1,000
            values = lookup(values, full.select(F.col("bucket").alias("__bucket")), "__bucket", "left_semi", heavy)
        values = values.drop("__bucket")
    return values.drop("__mark")


def first_threshold(counts: DataFrame, n: int, buckets: int, rows: int) -> int:
    """What the n-th value is likely to reach; 1 if there are fewer counters than `n`.

    From the n-th largest counter, without what other values are likely to add, a quarter is taken, since records may have been
    delivered often, but not less than others reach by chance.
    """
    largest = [row[0] for row in counts.where("hash = 0").orderBy(F.desc("rows")).limit(n).select("rows").collect()]
    if len(largest) < n:
        return 1
    others = math.ceil(rows / buckets + 4 * math.sqrt(rows / buckets))
    own = largest[-1] - others
    return max(1, own // 4, min(own, 2 * others))


def most_frequent(df: DataFrame, value: Column, record: str, n: int, hashes: Hashes = Hashes()) -> DataFrame:
    """(value, records): the `n` values that most different `record`s have; ties go to the smaller value.

    The counts are exact. Coarse counters over all rows, more of them the more rows there are, rule out most values; the
    rest is counted exactly, each record once however often it was delivered. The threshold begins with `first_threshold`
    and is lowered until `n` values reach it: then no value that was ruled out can be one of them.

    Left out: rows whose value or record is null. With fewer than `n` values all are given; an empty table
    gives an empty result.
    """
    rows = df.count()
    buckets = hashes.buckets(rows)
    # as a list of one, so that the value is made once a row and not again for each of its uses
    values = df.select(F.explode(F.array(value)).alias("value"), F.col(record).alias("record")).where("value is not null and record is not null")
    scratch = Scratch(df.sparkSession)
    counts = scratch.keep(bucket_counts(values, "value", hashes, buckets))
    least = first_threshold(counts, n, buckets, rows)
    while True:
        left = values if least == 1 else reaching(values, "value", counts, least, hashes, buckets, rows)
        found = scratch.keep(count_records(left).orderBy(F.desc("records"), F.asc("value")).limit(n))
        best = sorted((row[0] for row in found.select("records").collect()), reverse=True)
        if len(best) == n and best[-1] >= least or least == 1:
            break
        least = max(best[-1] if len(best) == n else 1, least // 2)
    return found


def count_records(rows: DataFrame) -> DataFrame:
    """(value, records): different records per value; repeats go first, by (value, record), so no value is heavy."""
    return rows.groupBy("value", "record").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("*").alias("records"))
