import random

import numpy as np
from pyspark.sql import functions as F

from strandwork.llm.seen import BloomChain, ChainSettings, seen_before, with_truth


def exact(rows):
    first = {}
    for order, key in rows:
        if order is not None and key is not None:
            first[key] = min(order, first.get(key, order))
    return {order for order, key in rows if order is not None and key is not None and order > first[key]}


def found(df):
    answers = seen_before(df, "id", F.col("key"), ChainSettings(error=1e-7)).where("seen").select("order")
    assert "Window" not in answers._jdf.queryExecution().executedPlan().toString()  # the chains alone
    return {r[0] for r in answers.collect()}


def test_chain_has_no_misses_and_keeps_its_bound():
    settings = ChainSettings(error=0.01, first_capacity=256)
    chain, draw = BloomChain(settings), np.random.default_rng(3)
    old, new = (draw.integers(0, 2**63, (2, 20_000)).astype(np.uint64) for _ in range(2))
    for at in range(0, 20_000, 777):
        chain.add(*old[:, at : at + 777])
    assert len(chain.layers) > 5 and chain.bound() < settings.error
    assert chain.holds(*old).all()
    assert chain.holds(*new).mean() <= settings.error


def test_matches_brute_force_with_repeats_nulls_and_a_hot_key(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice(["hot", f"k{draw.randrange(800)}", f"u{i}"])) for i in range(6000)]
    rows += [(None, "hot"), (7001, None), (None, None)] + rows[:500] + [rows[17]] * 300
    draw.shuffle(rows)
    df = spark.createDataFrame([(i, k, 1, "x") for i, k in rows], "id long, key string, one int, seen string").repartition(5)
    assert found(df) == exact(rows)


def test_wrong_answers_are_counted(spark):
    rows = [(i, f"k{i}") for i in range(4000)]
    loose = ChainSettings(error=0.3, first_capacity=64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # a batch is compared exactly within itself
    df = spark.createDataFrame(rows, "id long, key string")
    answers = with_truth(seen_before(df, "id", F.col("key"), loose))
    wrong, bound = answers.agg(F.count_if(F.expr("seen and not repeat")), F.max("bound")).first()
    assert 0 < wrong / 4000 <= bound < 0.3
    assert answers.where("repeat").isEmpty() and found(df) == set()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_missing_none(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (1, "a")], "id long, key string")
    assert found(df) == {3}
    assert found(df.where("false")) == set()
