"""Per-key results when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.shared import Scratch

#: How the partial states of an aggregate are merged.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "bit_or": F.bit_or}
FIRST = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "bit_or": F.bit_or}


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: Mapping[str, tuple[str, Column]], fan_in: int = 32, chunk_rows: int = 4096) -> DataFrame:
    """Aggregate by `keys` in rounds, so that no reducer gets more than `fan_in` partial states of a key at once.

    `states` maps each result name to a kind (count, sum, min, max, bit_or) and its column. The rows of every partition,
    sorted by key, are cut into chunks of `chunk_rows`; those of a chunk become one state per key where they lie. Then
    `fan_in` neighbouring chunks are merged, and again, until each partition is one, and then `fan_in` neighbouring
    partitions: rounds are logarithmic in the chunks that there are, and each moves far fewer states than the one before.

    A null key is a key of its own; null values are ignored as by the plain aggregate; an empty `df` gives no
    rows. Columns that are not named are not read.
    """
    *_, last = levels(df, keys, states, fan_in, chunk_rows)
    return last.select(*keys, *states)


def levels(df: DataFrame, keys: Sequence[str], states: Mapping[str, tuple[str, Column]], fan_in: int, chunk_rows: int) -> Iterator[DataFrame]:
    """The states after each round of `tree_aggregate`, with __part and __chunk, where they lie; the last has one state a key."""
    values = {f"__{name}": value for name, (_, value) in states.items()}
    rows = df.select(*keys, *(value.alias(name) for name, value in values.items())).sortWithinPartitions(*keys, *values)
    # rows are in a fixed order, so a task that runs again makes the same chunks
    chunk = F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / chunk_rows).alias("__chunk")
    rows = rows.select("*", F.spark_partition_id().alias("__part"), chunk)
    first = rows.groupBy(*keys, "__part", "__chunk").agg(*(FIRST[kind](f"__{name}").alias(name) for name, (kind, _) in states.items()))
    out = Scratch(df.sparkSession).keep(first)
    yield out
    part, chunks = (n or 0 for n in out.agg(F.max("__part"), F.max("__chunk")).first())
    while part or chunks:
        # within partitions first, then across them
        place = (F.col("__part"), F.floor(F.col("__chunk") / fan_in).alias("__chunk")) if chunks else (F.floor(F.col("__part") / fan_in).alias("__part"), F.lit(0).alias("__chunk"))
        out = out.groupBy(*keys, *place).agg(*(MERGE[kind](name).alias(name) for name, (kind, _) in states.items()))
        part, chunks = (part, chunks // fan_in) if chunks else (part // fan_in, 0)
        yield out


def count_distinct_by_tree(df: DataFrame, key: str, item: str, name: str, fan_in: int = 32, chunk_rows: int = 4096) -> DataFrame:
    """For each non-null `key`, how many different non-null values of `item` it has, as column `name`.

    Repeats are dropped first by (key, item), which spreads the items of a heavy key over all tasks; what is
    left is counted by `tree_aggregate`. Keys all of whose items are null have no row.
    """
    items = df.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(key, item).distinct()
    return tree_aggregate(items, [key], {name: ("count", F.col(item))}, fan_in, chunk_rows)


def stale_contig_counts(loci: DataFrame, locus_nodes: DataFrame, fan_in: int = 32) -> DataFrame:
    """Loci whose recorded contig_count is not the number of different contigs listed for them.

    `loci` has locus_id and contig_count, `locus_nodes` has locus_id and node_id; other columns are ignored.
    Contigs are counted without their sign; null and 0 are no contigs; a locus without a list has 0. Loci with
    a null locus_id or contig_count are left out, a locus delivered twice counts once. Returns locus_id,
    contig_count (recorded) and listed (counted).
    """
    contigs = locus_nodes.select("locus_id", F.abs(F.nullif(F.col("node_id"), F.lit(0))).alias("contig"))
    listed = count_distinct_by_tree(contigs, "locus_id", "contig", "listed", fan_in)
    recorded = loci.where("locus_id is not null and contig_count is not null").select("locus_id", "contig_count").distinct()
    both = recorded.join(listed, "locus_id", "left").withColumn("listed", F.coalesce("listed", F.lit(0).cast("long")))
    return both.where(F.col("contig_count") != F.col("listed"))
