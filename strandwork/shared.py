"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The lists of roots that `tidy` is to delete, innermost last.
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`.

    Where it is unset, a folder of this machine is made and set, which only a local session may use:
    on a cluster that would lose data with the machine, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _at(spark: SparkSession, path: str):
    """The file system of `path` and the path, for the few calls that Spark has no reader or writer for."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables of every `Scratch` made inside; what was made of them must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for root in _open.pop():
            files, path = _at(spark, root)
            files.delete(path, True)


class Scratch:
    """Tables written during one query, each readable after any executor is lost.

    They are deleted by `drop`, at the end of a `tidy` block, or when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        if _open:
            _open[-1].append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write `df` and return the table that was written; its plan starts at the files."""
        first = not self._paths
        path = f"{self.root}/{len(self._paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        if first:
            files, root = _at(self.spark, self.root)
            files.deleteOnExit(root)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of `keep` that no later step reads."""
        for kept in tables:
            _, path = self._paths.pop(id(kept))
            files, at = _at(self.spark, path)
            files.delete(at, True)


def heavy_keys(df: DataFrame, key: str, share: int = 1000) -> list:
    """The keys that hold more than one row in `share` of `df`: fewer than `share` keys, whatever the size of `df`.

    One pass over `key` alone, in which each task keeps a sketch of ten times `share` candidates.
    """
    asked = F.expr(f"approx_top_k(`{key}`, {share}, {10 * share})")
    rows, top = df.select(key).agg(F.count(F.lit(1)), asked).first()
    return [k for k, n in top if k is not None and n > max(rows / share, 1)]


def salted(left: DataFrame, right: DataFrame, key: str, how: str = "inner", heavy: list | None = None, parts: int = 32) -> DataFrame:
    """Join on `key`, though some keys (`heavy`, those of `left` if not given) may hold most of `left`.

    Rows of `left` with a heavy key are spread over `parts` tasks by a hash of the whole row, and the rows of `right`
    that have one are there in each; all others meet as in any join. Rows whose key is null match nothing and,
    if `how` (inner, left, left_semi or left_anti) keeps them, are spread too.
    """
    heavy = heavy_keys(left, key) if heavy is None else heavy
    if heavy:
        hot = F.col(key).isin(heavy)
        right = right.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    else:
        hot = F.lit(False)
        right = right.withColumn("__salt", F.lit(0))
    spread = hot | F.col(key).isNull() if how in ("left", "left_anti") else hot
    left = left.withColumn("__salt", F.when(spread, F.pmod(F.xxhash64(*left.columns), F.lit(parts)).cast("int")).otherwise(0))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def numbered_within(df: DataFrame, group: str, name: str, *order: Column | str) -> DataFrame:
    """`df` with the place of each row in its `group` by `order`, from 1, in the column `name`, though a group may be most of `df`.

    Rows are put in ranges of (group, order); a row's place is that in its range and the sizes of the group's ranges before.
    """
    ranged = Scratch(df.sparkSession).keep(df.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = sizes.select(group, "__part", (F.sum("__n").over(Window.partitionBy(group).orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    rows = ranged.withColumn("__at", inside).join(before, [group, "__part"])
    return rows.select(*df.columns, (F.col("__at") + F.col("__before")).cast("long").alias(name))


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", heavy: list | None = None) -> DataFrame:
    """`salted` for a `right` whose `key` is unique: fewer than 1,000 of its rows are repeated, however large `left` is."""
    return salted(left, right, key, how, heavy)
