"""Operators whose input has one key with half of all rows, or more."""

import random

import pytest
from pyspark.sql import functions as F

from strandwork.operators import graph, loci, scaffold, transcripts
from strandwork.shared import heavy_keys, numbered_within, salted, tidy, Scratch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def hot(spark):
    """(nodes, occurrences): contig 1 has half of the places."""
    draw = random.Random(9)
    nodes = spark.createDataFrame([(n, 40 + n % 7, n % 3 > 0) for n in range(1, 60)], "node_id long, len int, is_unique boolean")
    places = {(i // 2, draw.choice((1, -1)) if i % 2 else draw.choice((1, -1)) * draw.randrange(2, 70), draw.randrange(20), draw.randrange(30)) for i in range(4000)}
    return nodes, spark.createDataFrame(sorted(places), "read_id long, node_id long, pos long, off long").repartition(5)


def test_connections_and_arcs(hot):
    nodes, occ = hot
    assert heavy_keys(occ.select(F.abs("node_id").alias("contig")), "contig")[0] == 1
    for heavy in (None, [1], [1, 5, 99]):
        assert rows(scaffold.usable(occ, nodes, heavy)) == rows(scaffold.usable(occ, nodes, []))
        assert rows(graph.arcs_of_reads(occ, nodes, heavy)) == rows(graph.arcs_of_reads(occ, nodes, []))
    dropped = nodes.where("node_id in (1, 7)")
    assert rows(graph.dubious_reads(occ, dropped)) == rows(graph.dubious_reads(occ, dropped, []))


def test_mappings_of_many_reads_on_many_transcripts(spark, hot):
    nodes, occ = hot
    paths = spark.createDataFrame([(i % 4, i, [1, 2 + i % 20, -(3 + i % 30)], [0, 0, 0]) for i in range(1, 60)], "locus_id long, transcript_id long, node_path array<long>, gaps array<long>")
    laid = transcripts.layout(paths, nodes, 21)
    few = occ.where("read_id % 20 = 0")
    assert rows(transcripts.read_mappings(laid, few, 21)) == rows(transcripts.read_mappings(laid, few, 21, []))


def test_places_in_a_group_that_is_nearly_all(spark):
    df = spark.range(3000).selectExpr("if(id < 2800, 1, id % 9) as g", "pmod(xxhash64(id), 50) as v", "id")
    got = {(r.g, r.v, r.id): r.at for r in numbered_within(df.repartition(7), "g", "at", F.desc("v"), "id").collect()}
    want = {}
    for g, v, i in sorted(got, key=lambda t: (t[0], -t[1], t[2])):
        want[g, v, i] = 1 + sum(1 for k in want if k[0] == g) if g != 1 else None
    assert {k: n for k, n in got.items() if k[0] != 1} == {k: n for k, n in want.items() if k[0] != 1}
    assert [got[k] for k in sorted((k for k in got if k[0] == 1), key=lambda t: (-t[1], t[2]))] == list(range(1, sum(k[0] == 1 for k in got) + 1))
    assert numbered_within(df.where("false"), "g", "at", "id").count() == 0


def test_a_hub_and_a_chain(spark):
    ends = [(1, n) for n in range(2, 400)] + [(n, n + 1) for n in range(500, 540)]
    nodes = spark.createDataFrame([(n,) for n in [*range(1, 400), *range(500, 541), 900]], "node_id long")
    pairs = spark.createDataFrame(ends, "src long, dst long")
    want = sorted([(n, 1) for n in range(1, 400)] + [(n, 500) for n in range(500, 541)] + [(900, 900)])
    for few in (0, 1 << 17):
        assert rows(loci.components(nodes, pairs, few).select("node_id", "locus_id")) == want


def test_many_to_many_on_a_hot_key(spark):
    left = spark.range(2000).selectExpr("if(id % 2 = 0, 1, id) as k", "id as v")
    right = spark.range(60).selectExpr("if(id < 30, 1, id) as k", "id as w")
    assert rows(salted(left, right, "k").select("k", "v", "w")) == rows(left.join(right, "k").select("k", "v", "w"))


def test_tables_are_gone_after_a_tidy_block(spark):
    with tidy(spark):
        kept = Scratch(spark).keep(spark.range(5))
        files = kept.inputFiles()
        assert kept.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(*files).count()
