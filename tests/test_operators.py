import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandwork.operators import clean, graph, kmers, loci, scaffold, similarity, splicing, transcripts
from strandwork.operators.skew import count_distinct_by_tree, levels, stale_contig_counts, tree_aggregate
from strandwork.shared import Scratch, heavy_keys, lookup


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("fan_in", [2, 32])
def test_tree_aggregate_is_the_plain_aggregate(spark, fan_in):
    draw = random.Random(1)
    data = [(draw.choice(["hot", "hot", None, f"k{draw.randrange(30)}"]), draw.choice([None, draw.randrange(1000)])) for _ in range(3000)]
    df = spark.createDataFrame([(k, v, 1) for k, v in data], "k string, v long, __other int").repartition(9)
    states = {"n": ("count", F.col("v")), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    plain = df.groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(map(tuple, tree_aggregate(df, ["k"], states, fan_in).collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    assert tree_aggregate(df.where("false"), ["k"], states, fan_in).count() == 0


def test_stale_counts(spark):
    loci_ = spark.createDataFrame([(1, 2, "a"), (1, 2, "a"), (2, 1, "a"), (3, 1, "a"), (4, 0, "a"), (5, None, "a"), (None, 3, "a")], "locus_id long, contig_count long, listed string")
    listed = spark.createDataFrame([(1, 5, 0), (1, -5, 0), (1, 6, 0), (2, 7, 0), (2, 8, 0), (3, None, 0), (3, 0, 0), (None, 9, 0), (9, 1, 0)], "locus_id long, node_id long, contig_count int")
    assert rows(stale_contig_counts(loci_, listed)) == [(2, 1, 2), (3, 1, 0)]
    assert stale_contig_counts(loci_.where("false"), listed).count() == 0
    assert rows(stale_contig_counts(loci_, listed.where("false")).select("locus_id")) == [(1,), (2,), (3,)]


def test_distinct_by_tree_with_a_hot_key(spark):
    df = spark.range(5000).selectExpr("if(id < 4000, 1, id % 40) as k", "id % 997 as v")
    want = df.groupBy("k").agg(F.count_distinct("v").alias("n"))
    assert rows(count_distinct_by_tree(df, "k", "v", "n", fan_in=2)) == rows(want)


def test_no_merge_takes_more_states_than_the_fan_in(spark):
    df = spark.range(20000, numPartitions=9).selectExpr("if(id < 12000, 1, id % 40) as k", "id as v")
    *before, last = levels(df, ["k"], {"n": ("count", F.col("v"))}, 3, 100)
    assert len(before) == 5  # 23 chunks a partition in three rounds, 9 partitions in two
    for a, b in zip(before, [*before[1:], last]):
        merged = a.groupBy("k").count().join(b.groupBy("k").count().withColumnRenamed("count", "to"), "k")
        assert merged.where("count > 3 * to").isEmpty() and a.count() > b.count()
    assert last.groupBy("k").count().where("count > 1").isEmpty()
    assert rows(last.select("k", "n")) == rows(df.groupBy("k").agg(F.count("*").alias("n")))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_is_the_plain_join(spark, how):
    left = spark.range(3000).selectExpr("case when id < 2000 then 1L when id % 7 = 0 then null else id % 90 end as k", "id as v")
    right = spark.range(0, 60, 2).selectExpr("id + 1 as k", "id * 10 as w")
    heavy = heavy_keys(left, "k", 10)
    assert heavy == [1] and heavy_keys(left.where("false"), "k") == []
    key = lambda r: tuple((x is None, x) for x in r)
    got, want = lookup(left, right, "k", how, heavy), left.join(right, "k", how)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_scratch_tables_can_be_read_and_dropped(spark):
    scratch = Scratch(spark)
    kept = scratch.keep(spark.range(5))
    assert kept.count() == 5
    scratch.drop(kept)
    with pytest.raises(Exception):
        spark.read.parquet(*kept.inputFiles()).count()


def test_kmers_by_brute_force(spark):
    turn = str.maketrans("ACGT", "TGCA")
    draw = random.Random(2)
    seqs = ["".join(draw.choice("ACGTN" if draw.random() < 0.1 else "ACGT") for _ in range(draw.randrange(0, 50))) for _ in range(200)] + [None]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    want = Counter(min(r, r[::-1].translate(turn)) for s in seqs if s for r in (s[i : i + 5] for i in range(len(s) - 4)) if "N" not in r)
    assert rows(kmers.kmer_counts(df, 5)) == sorted(want.items())
    arcs = rows(kmers.kmer_arcs(df, 5, 2))
    assert all(a[1:] == b[:-1] for a, b, _ in arcs)
    assert {(b[::-1].translate(turn), a[::-1].translate(turn), n) for a, b, n in arcs} == set(arcs)


@pytest.mark.parametrize("k", [4, 5, 21, 30, 31, 32])
def test_packed_kmers_are_those_of_the_letters(spark, k, monkeypatch):
    draw = random.Random(k)
    monkeypatch.setattr(kmers, "PIECE", 100)
    base = "".join(draw.choice("ACGT") for _ in range(90))
    seqs = [base[a : a + draw.randrange(80)] + draw.choice(["", "N", "é", base]) for a in range(60)] + [None, "", "T" * k, "A" * k, "AT" * k]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    assert rows(kmers.kmer_counts(df, k)) == rows(kmers.strand_counts(df, k).select("kmer", "n"))
    if k % 2:
        assert rows(kmers.kmer_arcs(df, k, 2)) == rows(kmers._long_kmer_arcs(df, k, 2))


def arcs_of(spark, edges):
    both = {(a, b) for a, b in edges} | {(-b, -a) for a, b in edges}
    return spark.createDataFrame([(a, b, 3) for a, b in sorted(both)], "src long, dst long, multiplicity long")


def nodes_of(spark, lengths, unique=(), seqs=None, cov=None):
    data = [(i, (seqs or {}).get(i), n, (cov or {}).get(i, 10), i in unique) for i, n in lengths.items()]
    return spark.createDataFrame(data, "node_id long, seq string, len int, cov long, is_unique boolean")


def test_tips_at_the_limit_and_in_chains(spark):
    # 1 - 2 - 3 with a tip at 2: 41 k-mers go, 42 stay (k = 21)
    for length, gone in ((41, True), (42, False)):
        nodes = nodes_of(spark, {1: 100, 2: 100, 3: 100, 4: length})
        stay = {r[0] for r in graph.clip_tips(nodes, arcs_of(spark, [(1, 2), (2, 3), (2, 4)]), 21).select("node_id").collect()}
        assert (4 not in stay) == gone and {1, 2, 3} <= stay
    nodes = nodes_of(spark, {1: 100, 2: 20, 3: 20})
    assert rows(graph.clip_tips(nodes, arcs_of(spark, [(1, 2), (2, 3)]), 21).select("node_id")) == [(1,)]


def test_chains_and_rings(spark):
    arcs = arcs_of(spark, [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 21), (20, 22)])
    got = {(n, c): s for n, c, s in rows(graph.chains(arcs))}
    assert [got[n, 1] for n in (1, 2, 3, 4)] == [0, 1, 2, 3] and [got[n, -4] for n in (-4, -3, -2, -1)] == [0, 1, 2, 3]
    assert [got[n, 10] for n in (10, 11, 12)] == [0, 1, 2]
    assert [got[n, -12] for n in (-12, -11, -10)] == [0, 1, 2]
    assert not any(abs(n) >= 20 for n, _ in got)


def test_long_chain_takes_few_rounds(spark):
    got = graph.chains(arcs_of(spark, [(i, i + 1) for i in range(1, 200)])).where("chain = 1")
    assert rows(got.select("node_id", "step")) == [(i, i - 1) for i in range(1, 201)]


def test_low_fraction_arcs(spark):
    arcs = spark.createDataFrame([(1, 2, 99), (1, 3, 1), (2, 4, 5)], "src long, dst long, multiplicity long")
    assert rows(graph.low_fraction_arcs(arcs, 0.05).select("src", "dst")) == [(1, 3)]


PAIRS = "src long, dst long, distance double, variance double, weight double, direct_count long, paired_count long, active boolean"


def pairs_of(spark, edges):
    """Edges a -> b (b follows a) with distance and weight."""
    return clean.links(spark.createDataFrame([(a, -b, float(d), 1.0, float(w), 1, 5, True) for a, b, d, w in edges], PAIRS))


def test_links_of_both_ends_and_dirt(spark):
    data = [(1, -2, 5.0, 1.0, 2.0, 1, 1, True), (-2, 1, 5.0, 1.0, 3.0, 1, 1, None), (1, 1, 1.0, 1.0, 1.0, 1, 1, True), (1, None, 1.0, 1.0, 1.0, 1, 1, True), (0, 3, 1.0, 1.0, 1.0, 1, 1, True)]
    got = clean.links(spark.createDataFrame(data, PAIRS))
    assert [(r.src, r.dst, r.weight, r.active) for r in got.collect()] == [(-2, 1, 3.0, True)]


def test_transitive_edges(spark):
    pairs = pairs_of(spark, [(1, 2, 100, 1), (2, 3, 100, 1), (1, 3, 200, 1)])
    got = rows(scaffold.transitive_edges(pairs))
    assert (1, -3) in got and (1, -2) not in got and (2, -3) not in got
    assert scaffold.transitive_edges(pairs_of(spark, [(1, 2, 100, 1), (2, 3, 100, 1), (1, 3, 20, 1)])).where("src = 1 and dst = -3").count() == 0


def members_of(spark, locus):
    return spark.createDataFrame([(l, n, i, True) for l, ns in locus.items() for i, n in enumerate(ns)], "locus_id long, node_id long, ord int, is_long boolean")


def paths_through(spark, edges, contigs):
    members = members_of(spark, {1: contigs})
    scratch = Scratch(spark)
    e = scratch.keep(loci.locus_edges(members, pairs_of(spark, edges)))
    shaped = scratch.keep(loci.shapes(loci.degree_histogram(members, e)))
    found = transcripts.simple_transcripts(members, e, shaped)
    return shaped.first().shape, {tuple(r.node_path) for r in found.collect()}


def test_shapes_and_their_paths(spark):
    assert paths_through(spark, [(1, 2, 10, 1), (2, 3, 10, 1)], [1, 2, 3]) == ("LINEAR", {(1, 2, 3)})
    assert paths_through(spark, [(1, 2, 10, 1), (1, 3, 20, 1), (2, 4, 10, 1), (3, 4, 20, 1)], [1, 2, 3, 4]) == ("BUBBLE", {(1, 2, 4), (1, 3, 4)})
    assert paths_through(spark, [(1, 2, 10, 1), (1, 3, 20, 1)], [1, 2, 3]) == ("FORK", {(1, 2), (1, 3)})
    assert paths_through(spark, [(1, 3, 10, 1), (2, 3, 20, 1)], [1, 2, 3]) == ("FORK", {(1, 3), (2, 3)})
    assert paths_through(spark, [], [5]) == ("LINEAR", {(5,)})
    assert paths_through(spark, [(1, 2, 1, 1), (2, 3, 1, 1), (3, 1, 1, 1)], [1, 2, 3])[0] == "UNKNOWN"


def heaviest(edges, order):
    place = {n: i for i, n in enumerate(order)}
    best = {n: (0.0, (n,)) for e in edges for n in e[:2]}
    for n in sorted(best, key=place.get):
        for a, b, _, w in edges:
            if b == n and place[a] < place[b] and best[a][0] + w > best[n][0]:
                best[n] = (best[a][0] + w, best[a][1] + (n,))
    return max(best.values())[0]


def test_heaviest_path_by_brute_force_with_cycles(spark):
    draw = random.Random(7)
    order = list(range(1, 15))
    edges = list({(a, b): (a, b, 10, draw.randrange(1, 50)) for a, b in ((draw.choice(order), draw.choice(order)) for _ in range(40)) if a != b}.values())
    members = members_of(spark, {1: order})
    found = transcripts.heaviest_paths(members, loci.locus_edges(members, pairs_of(spark, edges))).first()
    weight = {(a, b): w for a, b, _, w in edges}
    assert found.score == heaviest(edges, order) == sum(weight[s] for s in zip(found.node_path, found.node_path[1:]))


@pytest.mark.parametrize("few", [0, 20, 1 << 17])
def test_components_by_brute_force(spark, few):
    draw = random.Random(3)
    edges = [(200, i) for i in range(210, 260, 3)] + [(draw.choice([-1, 1]) * draw.randrange(1, 80), draw.randrange(1, 120)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)]
    nodes = nodes_of(spark, {i: 10 for i in list(range(1, 80)) + list(range(200, 261))})
    up = {i: i for i in list(range(1, 80)) + list(range(200, 261))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in ((abs(a), abs(b)) for a, b in edges):
        if a in up and b in up:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = loci.components(nodes, spark.createDataFrame(edges, "src long, dst long"), few)
    assert rows(got) == sorted((x, root(x)) for x in up)
    assert loci.components(nodes.where("false"), spark.createDataFrame(edges, "src long, dst long"), few).count() == 0


def test_layout_lengths_and_sequences(spark):
    seqs = {1: "ACGTACG", 2: "CGTTTTA"}
    nodes = nodes_of(spark, {1: 3, 2: 3}, seqs=seqs)
    paths = spark.createDataFrame([(1, 1, [1, 2], [0, 0]), (1, 2, [1, 2], [4, 9]), (1, 3, [1, 99], [0, 0]), (2, 4, [-2], None)], "locus_id long, transcript_id long, node_path array<long>, gaps array<long>")
    laid = transcripts.layout(paths, nodes, 5)
    assert rows(transcripts.lengths(laid).select("transcript_id", "length")) == [(1, 10), (2, 14), (4, 7)]
    got = dict(rows(transcripts.sequences(laid, nodes, 5).select("transcript_id", "seq")))
    assert got == {1: "ACGTACGTTA", 2: "ACGTACGNNNNCGTTTTA", 4: "TAAAACG"}
    assert rows(transcripts.gap_runs(laid, 5).where("transcript_id = 2").select("run", "contigs", "length")) == [(0, 1, 7), (1, 1, 7)]


def test_contained_paths_by_brute_force(spark):
    draw = random.Random(4)
    paths = {i: [draw.choice([-1, 1]) * draw.randrange(1, 6) for _ in range(draw.randrange(1, 7))] for i in range(60)}
    gone = set()
    for i, p in paths.items():
        for j, q in paths.items():
            for r in (q, [-n for n in reversed(q)]):
                if i != j and any(r[s : s + len(p)] == p for s in range(len(r))) and (len(p) < len(r) or i > j):
                    gone.add(i)
    df = spark.createDataFrame(list(paths.items()), "transcript_id long, node_path array<long>")
    assert {r[0] for r in transcripts.contained_paths(df).collect()} == gone


def test_bubbles_of_similar_and_unlike_branches(spark):
    like, unlike = "ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTA", "TTGACCATGGATTACAGGCATTGCCAGTACCATGAGGTAAC"
    changed = like[:30] + "C" + like[31:]
    nodes = nodes_of(spark, {1: 100, 2: 21, 3: 21, 4: 100, 5: 21}, seqs={1: like, 2: like, 3: changed, 4: like, 5: unlike}, cov={2: 50, 3: 5, 5: 7})
    edges = [(1, n, 10, 1) for n in (2, 3, 5)] + [(n, 4, 10, 1) for n in (2, 3, 5)]
    got = rows(similarity.simple_bubbles(pairs_of(spark, edges), nodes, 21).select("kept", "dropped", "same"))
    assert [(abs(a), abs(b), s) for a, b, s in got] == [(2, 3, True), (2, 5, False)] or sorted((abs(a), abs(b), s) for a, b, s in got) == [(2, 3, True), (2, 5, False)]


def test_similar_branches_become_one(spark):
    like = "ACGTTGCAAGCTTAGCCATGCATCGGATTACAGGCATTGCC"
    seqs = {n: like for n in (1, 2, 4, 6)} | {3: like[:30] + "C" + like[31:], 5: like[:35] + "G" + like[36:]}
    nodes = spark.createDataFrame(
        [(n, seqs[n], 100 if n in (1, 4, 6) else 21, c, False) for n, c in ((1, 100), (2, 50), (3, 5), (4, 90), (5, 7), (6, 80))],
        "node_id long, seq string, len int, cov long, is_unique boolean",
    )
    # 2, 3 and 5 lie between 1 and 4; 3 and 5 also between 6 and 4: 3 goes to 2 at once, 5 too
    edges = [(1, n, 10, 1) for n in (2, 3, 5)] + [(n, 4, 10, 1) for n in (2, 3, 5)] + [(6, n, 10, 1) for n in (3, 5)]
    found = similarity.simple_bubbles(pairs_of(spark, edges), nodes, 21)
    moved = similarity.merge_map(found, nodes)
    assert rows(moved) == [(3, 2), (5, 2)]
    assert rows(similarity.merged_nodes(nodes, moved).select("node_id", "cov")) == [(1, 100), (2, 62), (4, 90), (6, 80)]
    occ = spark.createDataFrame([(7, 1, 0, 0), (7, -3, 20, 9), (8, 5, 40, 1), (9, 2, 5, 0)], "read_id long, node_id long, pos long, off long")
    assert rows(similarity.merged_occurrences(occ, nodes, moved)) == [(7, -2, 20, 9), (7, 1, 0, 0), (8, 2, 20, 1), (9, 2, 5, 0)]
    arcs = arcs_of(spark, [(1, 2), (1, 3), (5, 4)])
    assert rows(similarity.merged_arcs(arcs, moved)) == [(-4, -2, 3), (-2, -1, 6), (1, 2, 6), (2, 4, 3)]
    none = similarity.merge_map(found.where("false"), nodes)
    assert none.count() == 0 and similarity.merged_nodes(nodes, none).count() == 6
    assert rows(similarity.merged_occurrences(occ, nodes, none)) == rows(occ)


def test_merges_follow_what_was_merged_and_ties_go_to_the_smaller_id(spark):
    nodes = nodes_of(spark, {n: 21 for n in range(1, 6)}, cov={1: 5, 2: 9, 3: 9, 4: 20, 5: 1})
    data = [(8, 9, 2, 1, True), (8, 9, -4, 2, True), (7, 9, 2, 3, True), (7, 9, 4, 5, False), (7, 9, 1, -1, True)]
    found = spark.createDataFrame(data, "source long, sink long, kept long, dropped long, same boolean")
    assert rows(similarity.merge_map(found, nodes)) == [(1, -4), (2, -4), (3, -4)]


def test_tips_that_a_stronger_branch_goes_past(spark):
    nodes = nodes_of(spark, {1: 100, 2: 100, 3: 20, 4: 20, 5: 20, 6: 20, 7: 41, 8: 100, 9: 41})
    edges = [(1, 2, 9), (1, 3, 2), (4, 5, 2), (8, 7, 4), (8, 9, 4)]
    arcs = spark.createDataFrame(edges + [(-b, -a, n) for a, b, n in edges], "src long, dst long, multiplicity long")
    # 3 is weaker than 2, 6 stands alone, 9 ties with 7; 4 and 5 are joined tips
    assert rows(graph.minority_tips(nodes, arcs, 21)) == [(3,), (6,), (9,)]


def test_splice_events(spark):
    k = 5
    pad = "A" * 30
    # after contig 1 come 2 (long) and 3 (short), which meet at 4
    def events(first, long_, last):
        seqs = {1: pad + first, 2: long_, 3: "AAAAAA", 4: last + pad}
        nodes = nodes_of(spark, {1: 40, 2: 20, 3: 2, 4: 40}, seqs=seqs)
        members = members_of(spark, {1: [1, 2, 3, 4]})
        e = loci.locus_edges(members, pairs_of(spark, [(1, 2, 1, 1), (1, 3, 1, 1), (2, 4, 1, 1), (3, 4, 1, 1)]))
        return [r.event for r in splicing.splice_events(e, nodes, k).collect()]

    assert events("AAA", "A" * 24, "AAAAA") == ["skipped_exon"]
    assert events("AGT", "A" * 24, "AAAAA") == ["alternative_5prime_splice"]
    assert events("AAA", "A" * 16 + "TG" + "A" * 2 + "AAAA", "AAAAA") in (["alternative_3prime_splice"], ["skipped_exon"])


def test_read_mappings_split_where_a_contig_is_missing(spark):
    nodes = nodes_of(spark, {1: 10, 2: 10, 3: 10, 4: 10})
    paths = spark.createDataFrame([(1, 1, [1, 2, 3, 4], [0, 0, 0, 0])], "locus_id long, transcript_id long, node_path array<long>, gaps array<long>")
    occ = spark.createDataFrame([(7, 1, 0, 0), (7, 2, 0, 9), (7, 4, 0, 20), (8, -3, 0, 0)], "read_id long, node_id long, pos long, off long")
    got = rows(transcripts.read_mappings(transcripts.layout(paths, nodes, 5), occ, 5).select("read_id", "same", "start", "finish", "contigs"))
    assert got == [(7, True, 1, 24, 2), (7, True, 31, 44, 1), (8, False, 21, 34, 1)]
