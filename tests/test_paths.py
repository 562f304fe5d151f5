import random

from strandwork.operators import transcripts


def tables(spark, loci, order):
    """`loci`: {locus_id: {(src, dst): weight}}."""
    members = spark.createDataFrame([(i, n, at, True) for i in loci for at, n in enumerate(order[i])], "locus_id long, node_id long, ord int, is_long boolean")
    edges = spark.createDataFrame([(i, a, b, 10.0, float(w)) for i, e in loci.items() for (a, b), w in e.items()], "locus_id long, src long, dst long, distance double, weight double")
    return members, edges


def heaviest(edges):
    """Of the uncut graph, which has no cycle."""
    best = lambda n: max([0] + [best(a) + w for (a, b), w in edges.items() if b == n])
    return max(best(b) for _, b in edges)


def test_heaviest_path_of_the_uncut_graph_in_any_order(spark):
    draw = random.Random(5)
    loci, order = {}, {}
    for i in range(1, 5):
        ids = draw.sample(range(1, 100), 12)
        loci[i] = {(ids[a], ids[b]): draw.randrange(1, 50) for a, b in (sorted(draw.sample(range(12), 2)) for _ in range(20))}
        order[i] = draw.sample(ids, 12)
    members, edges = tables(spark, loci, order)
    found = {r.locus_id: r for r in transcripts.heaviest_paths(transcripts.in_path_order(members, edges), edges).collect()}
    for i, e in loci.items():
        assert found[i].score == heaviest(e) == sum(e[s] for s in zip(found[i].node_path, found[i].node_path[1:]))


def test_only_edges_on_cycles_are_cut(spark):
    # two rings with a way from one to the other, and ways in and out that run against the order
    cycle = {(5, 6): 1, (6, 7): 1, (7, 5): 1, (2, 3): 1, (3, 2): 1}
    line = {(9, 8): 4, (8, 5): 4, (7, 4): 4, (4, 2): 4, (3, 1): 4}
    members, edges = tables(spark, {1: cycle | line}, {1: list(range(1, 10))})
    assert {(r.src, r.dst) for r in transcripts.on_cycles(edges).collect()} == set(cycle)
    found = transcripts.heaviest_paths(transcripts.in_path_order(members, edges), edges).first()
    assert found.node_path == [9, 8, 5, 6, 7, 4, 2, 3, 1]


def test_paths_until_every_contig_is_on_one(spark):
    # three ways from 1 to 9, one contig (7) without an edge, and a locus of such contigs only
    ways = {(1, 2): 9, (2, 9): 9, (1, 3): 5, (3, 9): 5, (1, 4): 2, (4, 5): 2, (5, 9): 2}
    members, edges = tables(spark, {1: ways, 2: {}}, {1: [9, 3, 1, 2, 4, 5, 7], 2: [11, 12]})
    nodes = spark.createDataFrame([(n, c) for n, c in zip((1, 2, 3, 4, 5, 7, 9, 11, 12), (90, 50, 30, 10, 20, 5, 90, 2, 1))], "node_id long, cov long")
    for small in (1000, 0):
        cover = lambda most: {tuple(r.node_path) for r in transcripts.path_cover(members, edges, nodes, most, small).collect()}  # noqa: B023, E731
        assert cover(10) == {(1, 2, 9), (1, 3, 9), (1, 4, 5, 9), (7,), (11,), (12,)}
        assert cover(2) == {(1, 2, 9), (1, 3, 9), (11,), (12,)}


def test_a_cover_does_not_depend_on_the_size_of_the_locus(spark):
    draw = random.Random(8)
    loci, order = {5: {}}, {5: [501, 502]}
    for i in range(1, 5):
        ids = [draw.choice((-1, 1)) * n for n in draw.sample(range(100 * i, 100 * i + 99), 10)]
        loci[i] = {(ids[a], ids[b]): draw.randrange(0, 6) for a, b in (sorted(draw.sample(range(10), 2)) for _ in range(14))}
        order[i] = ids
    loci[4][(order[4][9], order[4][0])] = 3  # perhaps a cycle
    members, edges = tables(spark, loci, order)
    nodes = spark.createDataFrame([(abs(n), draw.randrange(0, 20)) for o in order.values() for n in o], "node_id long, cov long")
    one, other = ({(r.locus_id, r.turn, r.score, *r.node_path) for r in transcripts.path_cover(members, edges, nodes, 2, small).collect()} for small in (1000, 0))
    assert one == other and {r[0] for r in one} == {1, 2, 3, 4, 5}


def test_gaps_of_a_path_and_what_they_spell(spark):
    # k is 5; 3 begins two bases before 2 ends
    text = "ACGTTGCAAC" + "GTCAGGTACCATTGACCTGA"
    seqs = {1: "AACCGGTTAACC", 2: text[:10], 3: text[8:16], 4: "AAAAAAAA"}
    lens = {n: len(s) - 4 for n, s in seqs.items()}  # 8, 6, 4, 4
    nodes = spark.createDataFrame([(n, lens[n], s) for n, s in seqs.items()], "node_id long, len int, seq string")
    edges = spark.createDataFrame([(1, 1, 2, 20.0), (1, 2, 3, 7.0), (1, 3, 4, 3.5)], "locus_id long, src long, dst long, distance double")
    paths = spark.createDataFrame([(1, 1, [1, 2, 3, 4]), (1, 2, [4])], "locus_id long, transcript_id long, node_path array<long>")
    found = transcripts.with_gaps(paths, edges, nodes)
    assert {r.transcript_id: r.gaps for r in found.collect()} == {1: [13, 2, 0, 0], 2: [0]}
    laid = transcripts.layout(found, nodes, 5)
    seq = {r.transcript_id: r.seq for r in transcripts.sequences(laid, nodes, 5, gaps_in_kmers=True).collect()}
    assert seq == {1: seqs[1] + "N" * 9 + text[:16] + "AAAA", 2: "AAAAAAAA"}
    assert {r.transcript_id: r.length for r in transcripts.lengths(laid).collect()} == {t: len(s) for t, s in seq.items()}
