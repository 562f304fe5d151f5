"""Steps of an assembly on small fixtures."""

import random

from strandwork.operators import clean, graph, loci, scaffold, similarity
from strandwork.operators.compact import joined_occurrences
from strandwork.plans.pipeline import contigs, place_reads
from strandwork.config import AssemblyOptions

PAIRS = "src long, dst long, distance double, variance double, weight double, direct_count long, paired_count long, active boolean"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_read_that_comes_back_has_a_place_each_time(spark):
    places = [(1, 7, 0, 0), (1, 7, 5, 5), (1, 7, 9, 8), (1, 7, 0, 40), (1, 7, 3, 43), (1, 8, 2, 20), (2, 7, 4, 0)]
    df = spark.createDataFrame(places, "read_id long, node_id long, pos long, off long")
    assert rows(graph.one_place_a_run(df, 3)) == [(1, 7, 0, 0), (1, 7, 0, 40), (1, 8, 2, 20), (2, 7, 4, 0)]
    assert graph.one_place_a_run(df.where("false"), 3).count() == 0


def test_repeats_are_placed_and_marked(spark):
    # R comes twice in one read, with other bases between; other reads hold what is before, between and behind
    draw = random.Random(4)
    a, r, b, c = ("".join(draw.choice("ACGT") for _ in range(n)) for n in (40, 30, 35, 40))
    reads = spark.createDataFrame([(1, a + r + b + r + c)] + [(i, x) for i, x in enumerate((a + r + b, r + b + r, b + r + c), 2)], "read_id long, seq string")
    nodes, places = contigs(reads, AssemblyOptions(k=11, coverage_cutoff=1))
    occ = place_reads(reads, nodes, places, 11)
    twice = rows(occ.where("read_id = 1").groupBy("node_id").count().where("count > 1"))
    assert len(twice) == 1 and twice[0][1] == 2
    marked = scaffold.occurrences_by_read(occ).where("pos = -1 and off = -1")
    assert {(i, n) for i, n, *_ in rows(marked)} == {(1, twice[0][0]), (3, twice[0][0])}


def test_pairs_with_a_short_read_are_taken_apart(spark):
    reads = spark.createDataFrame([(1, 2, 1, "A" * 30), (2, 1, 1, "A" * 9), (3, 4, 1, "A" * 30), (4, 3, 1, "A" * 30), (5, 6, 3, None), (6, 5, 3, "A" * 30), (7, None, 0, "A")], "read_id long, mate_id long, category short, seq string")
    assert rows(clean.detached(reads, 21)) == [(1, 0), (2, 0), (5, 2), (6, 2)]


def test_local_connections_join_what_is_near_one_unique_contig(spark):
    # 1 is unique, 2 and 3 are not; an arc from 2 to 3 connects them
    nodes = spark.createDataFrame([(1, 200, True), (2, 30, False), (3, 21, False)], "node_id long, len int, is_unique boolean")
    pairs = spark.createDataFrame([(1, -2, 120.0, 1.0, 5.0, 5, 0, True), (1, -3, 150.0, 1.0, 5.0, 5, 0, True)], PAIRS).drop("active")
    arcs = spark.createDataFrame([(2, 3, 7), (-3, -2, 7)], "src long, dst long, multiplicity long")
    weighed = pairs.select("src", "dst", "distance", "variance", "direct_count", "paired_count", "weight")
    both = scaffold.with_local(weighed, scaffold.local_connections(weighed, arcs, nodes))
    fresh = [r for r in rows(both.select("src", "dst", "distance", "direct_count", "paired_count", "weight")) if (r[0], r[1]) not in ((1, -2), (1, -3))]
    assert fresh == [(-3, 2, 25.0, 7, 0, 7.0)]


def test_similar_branches_of_a_locus_become_one(spark):
    like = "ACGTTGCAAGCTTAGCCATGCATCGGATTACAGGCATTGCC"
    seqs = {1: like, 2: like, 3: like[:30] + "C" + like[31:], 4: like, 5: "TTGACCATGGATTACAGGCATTGCCAGTACCATGAGGTAAC"}
    cov = {1: 100, 2: 50, 3: 5, 4: 90, 5: 40}
    nodes = spark.createDataFrame([(n, s, 21, cov[n], False) for n, s in seqs.items()], "node_id long, seq string, len int, cov long, is_unique boolean")
    ends = [(1, n) for n in (2, 3, 5)] + [(n, 4) for n in (2, 3, 5)]
    pairs = clean.links(spark.createDataFrame([(a, -b, 10.0, 1.0, 2.0, 1, 1, True) for a, b in ends], PAIRS))
    members = spark.createDataFrame([(9, n, at, n != 3) for at, n in enumerate((1, 2, 3, 5, 4))], "locus_id long, node_id long, ord int, is_long boolean")
    left, kept = loci.simplified(members, pairs, nodes, 21)
    assert {r.node_id for r in left.collect()} == {1, 2, 4, 5}
    steps = {(r.src, r.dst): r for r in loci.locus_edges(left, kept).collect()}
    assert set(steps) == {(1, 2), (2, 4), (1, 5), (5, 4)}
    weights = {s: r.weight for s, r in steps.items()}
    assert weights == {(1, 2): 4.0, (2, 4): 4.0, (1, 5): 2.0, (5, 4): 2.0}


def test_ways_of_several_contigs(spark):
    """1 goes to 4 by 2, 3 and by 5, 6, 7, which are alike; 6 has a fork to 8, which comes back to 7 in a bubble of its own."""
    draw = random.Random(6)
    letters = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    k, way = 11, letters(70)
    changed = way[:33] + ("A" if way[33] != "A" else "C") + way[34:]
    begin = letters(60)
    piece = lambda s, a, b: (begin[-k + 1 :] + s)[a : b + k - 1]
    before_7 = piece(changed, 45, 45)
    seqs = {1: begin, 2: piece(way, 0, 40), 3: piece(way, 40, 70), 4: way[-k + 1 :] + letters(60), 5: piece(changed, 0, 20), 6: piece(changed, 20, 45), 7: piece(changed, 45, 70)}
    seqs[8] = before_7 + letters(12) + before_7
    cov = {n: (10 if n in (2, 3) else 4) * (len(s) - k + 1) for n, s in seqs.items()}
    nodes = spark.createDataFrame([(n, s, len(s) - k + 1, cov[n]) for n, s in seqs.items()], "node_id long, seq string, len int, cov long")
    ends = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 6), (6, 7), (7, 4), (6, 8), (8, 7)]
    steps = spark.createDataFrame([x for a, b in ends for x in ((a, b, 3), (-b, -a, 3))], "src long, dst long, multiplicity long")
    found = similarity.branch_bubbles(steps, nodes, k)
    got = {(r.source, r.sink, tuple(r.kept), tuple(r.dropped)): r.same for r in found.collect()}
    ways = {(s, *sorted((a, b))): same for (_, _, a, b), same in got.items() for s in (1,)}
    turn = lambda w: tuple(-n for n in reversed(w))
    long_ = [same for (_, a, b), same in ways.items() if {a, b} in ({(2, 3), (5, 6, 7)}, {turn((2, 3)), turn((5, 6, 7))})]
    assert long_ == [True]
    moved, inside = similarity.branch_moves(found, nodes)
    assert rows(moved) in ([(5, 2), (6, 2), (7, 3)], [(5, 2), (6, 3), (7, 3)])
    arcs = rows(similarity.merged_arcs(steps.join(inside, ["src", "dst"], "left_anti"), moved).where("src > 0 and src <> dst").select("src", "dst"))
    assert {(1, 2), (2, 3), (3, 4)} <= set(arcs) and {abs(n) for a in arcs for n in a} == {1, 2, 3, 4, 8}
    assert similarity.branch_bubbles(steps.where("false"), nodes, k).count() == 0


def test_joined_places_of_a_read_that_comes_back(spark):
    members = spark.createDataFrame([(3, 3, 1, 0, 0, 90), (4, 3, 1, 1, 50, 90)], "contig long, stays long, side long, step int, before long, total long")
    nodes = spark.createDataFrame([(3, 50), (4, 40)], "node_id long, len int")
    occ = spark.createDataFrame([(1, 3, 10, 0), (1, 4, 0, 40), (1, 3, 5, 200), (1, 6, 1, 150)], "read_id long, node_id long, pos long, off long")
    assert rows(joined_occurrences(occ, members, nodes, 11)) == [(1, 3, 5, 200), (1, 3, 10, 0), (1, 6, 1, 150)]
