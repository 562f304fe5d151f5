"""The N best items of every group, however large single groups are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.shared import Scratch

#: Ids are spread over this many marks to count different ones from below; a bit each in a LONG.
MARKS = 64


def bin_of(score: str, low: float, high: float, bins: int) -> Column:
    at = F.floor((F.col(score) - F.lit(low)) / F.lit((high - low) / bins))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int")


def score_histogram(df: DataFrame, group: str, item: str, score: str, low: float, high: float, bins: int) -> DataFrame:
    """(group, bin, marks, rows): per score bin the number of rows, and which of 64 hash marks its items set.

    Items delivered again set the same mark, so the number of marks set never exceeds the number of
    different items. Scores outside [low, high] fall into the outer bins, which keeps the order of bins.
    """
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(item), F.lit(MARKS)).cast("int"))
    binned = df.select(group, bin_of(score, low, high, bins).alias("bin"), mark.alias("mark"))
    return binned.groupBy(group, "bin").agg(F.bit_or("mark").alias("marks"), F.count("*").alias("rows"))


def safe_thresholds(histogram: DataFrame, group: str, n: int) -> DataFrame:
    """(group, floor_bin, rows): the highest bin such that it and the bins above surely hold `n` different items.

    floor_bin is 0 where that isn't sure, so nothing of such a group is dropped. A group has as many rows
    here as bins at most, so its window is small even if the group isn't.
    """
    above = Window.partitionBy(group).orderBy(F.desc("bin"))
    sure = histogram.withColumn("sure", F.sum(F.bit_count("marks")).over(above))
    floor = F.max(F.when(F.col("sure") >= n, F.col("bin")))
    return sure.groupBy(group).agg(F.coalesce(floor, F.lit(0)).alias("floor_bin"), F.sum("rows").alias("rows"))


def top_n_per_group(
    df: DataFrame, group: str, item: str, score: str, n: int, low: float, high: float, bins: int = 1024, heavy_groups: int = 5000, salts: int = 4096
) -> DataFrame:
    """The `n` rows of each group with the highest `score`; ties go to the smaller `item`. Adds the column `place`, 1..n.

    `item` is unique over all groups but for repeated deliveries of the same row, which count once. A histogram
    of scores per group gives a floor under which no row can be among the `n` best; rows below it are dropped
    and the rest is ranked exactly. The floors of the largest groups (each with more than one row in
    `heavy_groups`, so there are fewer of them) are broadcast: their rows are dropped where they lie, and
    what is left of them, even if all scores are equal, is spread by item and cut to `n` per partition before
    it meets. The floors of all other groups are joined by group.

    Left out: rows whose group, item or score is null, or whose score is NaN. A group with fewer than `n` rows
    is kept whole; an empty table gives an empty result. Other columns of `df` are not carried.
    """
    names = {"__group": group, "__item": item, "__score": score}
    rows = df.select(*(F.col(name).alias(own) for own, name in names.items())).dropna().where(~F.isnan("__score"))
    scratch = Scratch(df.sparkSession)
    floors = safe_thresholds(score_histogram(rows, "__group", "__item", "__score", low, high, bins), "__group", n)
    floors = scratch.keep(floors.withColumn("salt", F.lit(0)))  # as a stored column, it stays a key of the join below
    total = floors.agg(F.sum("rows")).first()[0] or 0
    is_heavy = F.col("rows") > max(total / heavy_groups, n)
    heavy = floors.where(is_heavy).select("__group", F.col("floor_bin").alias("heavy_floor"))
    light = floors.where(~is_heavy).select("__group", "salt", F.col("floor_bin").alias("light_floor"))

    at = bin_of("__score", low, high, bins)
    kept = rows.join(F.broadcast(heavy), "__group", "left").where(F.col("heavy_floor").isNull() | (at >= F.col("heavy_floor")))
    salt = F.when(F.col("heavy_floor").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("__item"), F.lit(salts)))
    kept = kept.withColumn("salt", salt.cast("int")).drop("heavy_floor")
    kept = kept.join(light.hint("shuffle_hash"), ["__group", "salt"], "left").where(F.col("light_floor").isNull() | (at >= F.col("light_floor")))
    once = kept.groupBy("__group", "salt", "__item").agg(F.max("__score").alias("__score")).drop("salt")
    place = F.row_number().over(Window.partitionBy("__group").orderBy(F.desc("__score"), F.asc("__item")))
    best = once.withColumn("place", place).where(F.col("place") <= n)
    return best.select(*(F.col(own).alias(name) for own, name in names.items()), "place")
