import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandwork.llm.frequent import Hashes, bucket_counts, first_threshold, most_frequent, reaching


def exact(rows, n):
    have = defaultdict(set)
    for value, record in rows:
        if value is not None and record is not None:
            have[value].add(record)
    return sorted(((v, len(r)) for v, r in have.items()), key=lambda x: (-x[1], x[0]))[:n]


def got(spark, rows, n, hashes):
    df = spark.createDataFrame([(v, r, 1, "x") for v, r in rows], "v string, r long, value int, records string").repartition(3)
    return [tuple(r) for r in most_frequent(df, F.col("v"), "r", n, hashes).orderBy(F.desc("records"), "value").collect()]


@pytest.mark.parametrize("hashes", [Hashes(rows_each=10**9, least=1), Hashes(least=16), Hashes(least=16, broadcast=0), Hashes()])
def test_matches_brute_force(spark, hashes):
    draw = random.Random(2)
    rows = [(f"v{int(draw.paretovariate(0.7))}", i) for i in range(5000)]
    rows += [(None, 1), ("v1", None), (None, None)] + [("often delivered", 6000)] * 900 + rows[:400]
    assert got(spark, rows, 10, hashes) == exact(rows, 10)


def test_a_flat_column_leaves_few_survivors(spark):
    """20 values of 120 rows among 30,000 of 5: with counters that grow with the rows the filter keeps little else."""
    df = spark.range(152_400).selectExpr("if(id < 2400, id % 20, id % 30000 + 100) as value")
    left = {}
    for hashes in (Hashes(), Hashes(least=1024), Hashes(rows_each=10**9, least=1024)):
        buckets = hashes.buckets(152_400)
        counts = bucket_counts(df, "value", hashes, buckets)
        least = first_threshold(counts, 20, buckets, 152_400)
        left[buckets] = reaching(df, "value", counts, min(least, 120), hashes, buckets, 152_400).distinct().count()
    assert left[65536] == 20 and left[4096] < 200 and left[1024] > 10_000


def test_fewer_values_than_asked_ties_and_empty(spark):
    rows = [("b", 1), ("a", 2), ("c", 3), ("c", 4), ("", 5)]
    assert got(spark, rows, 20, Hashes()) == [("c", 2), ("", 1), ("a", 1), ("b", 1)]
    assert got(spark, rows, 2, Hashes()) == [("c", 2), ("", 1)]
    assert got(spark, [], 5, Hashes()) == []
