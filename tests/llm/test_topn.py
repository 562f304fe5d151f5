import math
import random
from collections import defaultdict

import pytest

from strandwork.llm.topn import top_n_per_group


def exact(rows, n):
    groups = defaultdict(set)
    for g, i, s in rows:
        if None not in (g, i, s) and not math.isnan(s):
            groups[g].add((-s, i))
    return {(g, i, place + 1) for g, items in groups.items() for place, (_, i) in enumerate(sorted(items)[:n])}


@pytest.mark.parametrize("n", [1, 3, 80])
def test_matches_brute_force(spark, n):
    draw = random.Random(n)
    rows = [(draw.choice([1, 1, 1, draw.randrange(60)]), i, draw.choice([0.5, 1.0, round(draw.random(), 3), -2.0, 7.0])) for i in range(4000)]
    rows += [(None, 1, 0.5), (1, None, 0.5), (1, 9999, None), (1, 9998, float("nan"))] + rows[:700] + [rows[5]] * 200
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "rows long, bin long, place double, salt string, mark int").repartition(4)
    got = top_n_per_group(df, "rows", "bin", "place", n, 0.0, 1.0, bins=64, heavy_groups=10).toPandas()
    assert set(zip(got.iloc[:, 0], got.iloc[:, 1], got.iloc[:, 3])) == exact(rows, n)
    assert len(got) == len(exact(rows, n))


def test_all_scores_equal_in_a_group_of_most_rows(spark):
    df = spark.range(20_000).selectExpr("if(id < 15000, 7, id % 50) as g", "id as i", "0.25D as s")
    got = {tuple(r) for r in top_n_per_group(df, "g", "i", "s", 3, 0.0, 1.0).where("g = 7").select("i", "place").collect()}
    assert got == {(0, 1), (1, 2), (2, 3)}


def test_empty(spark):
    df = spark.createDataFrame([], "g long, i long, s double")
    assert top_n_per_group(df, "g", "i", "s", 3, 0.0, 1.0).count() == 0
