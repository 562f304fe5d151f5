import random

import pytest

from strandwork.config import AssemblyOptions
from strandwork.operators import compact, graph
from strandwork.plans.pipeline import assemble, contigs, corrected, place_reads

K = 21
TURN = str.maketrans("ACGT", "TGCA")


def turned(s):
    return s[::-1].translate(TURN)


def letters(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choice("ACGT") for _ in range(n))


def tables(spark, pieces, edges, places=()):
    """Contigs (id: bases), arcs with their twins, and occurrences (read, signed contig, pos, off)."""
    nodes = spark.createDataFrame([(n, s, len(s) - K + 1, 2 * (len(s) - K + 1)) for n, s in pieces.items()], "node_id long, seq string, len int, cov long")
    both = {(a, b) for a, b in edges} | {(-b, -a) for a, b in edges}
    arcs = spark.createDataFrame([(a, b, 3) for a, b in sorted(both)], "src long, dst long, multiplicity long")
    return nodes, arcs, spark.createDataFrame(list(places), "read_id long, node_id long, pos long, off long")


def cut(seq, *at):
    """Pieces of `seq` that overlap by k-1 bases; `at` are the k-mers at which a new piece begins."""
    ends = [*at, len(seq) - K + 1]
    return [seq[a : b + K - 1] for a, b in zip((0, *at), ends)]


def test_a_chain_becomes_one_contig_on_the_strand_of_its_smallest_id(spark):
    seq = letters(1, 200)
    one, two, three = cut(seq, 50, 90)
    pieces = {7: one, 3: turned(two), 9: three}
    places = [(1, 7, 45, 0), (1, -3, 0, 5), (2, 3, 10, 0), (3, -9, 4, 1), (4, -3, 12, 0), (4, 9, 0, 28)]
    nodes, arcs, occ, joined = compact.join_chains(*tables(spark, pieces, [(7, -3), (-3, 9)], places), K)
    # contig 3 is given on the other strand, so all of the chain is
    assert [tuple(r) for r in nodes.collect()] == [(3, turned(seq), 180, 360)] and joined == 2
    assert arcs.count() == 0
    whole = {1: turned(seq), -1: seq}
    got = {(r.read_id, r.node_id): (r.pos, r.off) for r in occ.collect()}
    assert set(got) == {(1, -3), (2, 3), (3, 3), (4, -3)}
    for read, contig, pos, off in places:
        bases = pieces[abs(contig)] if contig > 0 else turned(pieces[abs(contig)])
        side = [s for s in (1, -1) if (read, 3 * s) in got][0]
        at, first = got[read, 3 * side]
        shift = off - first
        assert whole[side][at + shift : at + shift + K] == bases[pos : pos + K]


def test_rings_gaps_and_branches(spark):
    ring = letters(2, 120)
    one, two = cut(ring + ring[: K - 1], 60)
    apart, branch, left, right = letters(3, 60), letters(4, 60), letters(5, 60), letters(6, 60)
    pieces = {1: one, 2: two, 3: apart, 4: letters(8, 60), 5: branch, 6: branch[-K + 1 :] + left, 7: branch[-K + 1 :] + right}
    edges = [(1, 2), (2, 1), (3, 4), (5, 6), (5, 7)]
    nodes, arcs, occ, joined = compact.join_chains(*tables(spark, pieces, edges), K)
    assert joined == 1 and occ.count() == 0
    found = {r.node_id: r.seq for r in nodes.collect()}
    # the ring is cut at its smallest contig; 3 and 4 don't overlap; 5 has two ways on
    assert found == {1: ring + ring[: K - 1]} | {n: pieces[n] for n in (3, 4, 5, 6, 7)}
    assert sorted(map(tuple, arcs.collect())) == sorted(
        [(1, 1, 3), (-1, -1, 3), (3, 4, 3), (-4, -3, 3), (5, 6, 3), (-6, -5, 3), (5, 7, 3), (-7, -5, 3)]
    )


def test_nothing_to_join(spark):
    nodes, arcs, occ = tables(spark, {1: letters(1, 40)}, [], [(1, 1, 0, 0)])
    assert compact.join_chains(nodes, arcs, occ, K) == (nodes, arcs, occ, 0)
    empty = [t.where("false") for t in (nodes, arcs, occ)]
    assert [t.count() for t in compact.join_chains(*empty, K)[:3]] == [0, 0, 0]


@pytest.fixture(scope="module")
def noisy(spark):
    """Reads of one transcript; a seventh of them have another base at one place, a few a wrong one near their end."""
    true = letters(21, 600)
    other = true[:300] + {"A": "C", "C": "G", "G": "T", "T": "A"}[true[300]] + true[301:]
    rows = []
    for at in range(0, 600 - 75 + 1):
        rows += [(len(rows) + 1, true[at : at + 75])]
        rows += [(len(rows) + 1, other[at : at + 75])]
        rows += [(len(rows) + i + 1, true[at : at + 75]) for i in range(5)]
    wrong = true[100:170] + {"A": "C", "C": "G", "G": "T", "T": "A"}[true[170]] + true[171:175]
    rows += [(len(rows) + i + 1, wrong) for i in range(4)]
    reads = [(i, None, 2, s) for i, s in rows]
    return true, spark.createDataFrame(reads, "read_id long, mate_id long, category short, seq string")


def test_bubbles_and_tips_leave_one_contig(spark, noisy):
    true, reads = noisy
    options = AssemblyOptions(k=K, coverage_cutoff=3)
    nodes, places = contigs(reads, options)
    assert nodes.count() > 4  # both branches of the bubble, the tip, and what lies between
    occ = place_reads(reads, nodes, places, K)
    after, arcs, placed = corrected(nodes, graph.arcs_of_reads(occ, nodes), occ, options)
    seqs = [r.seq for r in after.collect()]
    assert seqs in ([true], [turned(true)])
    assert arcs.count() == 0
    # every read lies on it, once
    assert placed.count() == placed.select("read_id").distinct().count() == reads.count()
    at = {r.read_id: (r.node_id, r.pos, r.off) for r in placed.collect()}
    for r in reads.collect():
        contig, pos, off = at[r.read_id]
        whole = seqs[0] if contig > 0 else turned(seqs[0])
        assert sum(a != b for a, b in zip(whole[pos - off : pos - off + 75], r.seq)) <= 1


def test_assembly_of_noisy_reads_is_the_transcript(spark, noisy):
    true, reads = noisy
    libraries = spark.createDataFrame([], "category short, mean double, sd double")
    found = assemble(reads, libraries, AssemblyOptions(k=K))
    assert [r.seq for r in found.sequences.collect()] in ([true], [turned(true)])
