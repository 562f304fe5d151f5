import random

import pytest

from strandwork.__main__ import arguments, libraries_of, main, options_of
from strandwork.config import AssemblyOptions
from strandwork.plans.pipeline import assemble, contigs, merge, place_reads
from strandwork.sources.fasta import pair_up, read_fasta, read_numbered_fasta
from strandwork.sources.sinks import reads_fasta, write_text

TURN = str.maketrans("ACGT", "TGCA")


def turned(s):
    return s[::-1].translate(TURN)


def isoforms():
    draw = random.Random(11)
    a, exon, b = ("".join(draw.choice("ACGT") for _ in range(n)) for n in (300, 45, 350))
    return a + exon + b, a + b


@pytest.fixture(scope="module")
def reads(spark):
    rows, i = [], 0
    for t, seq in enumerate(isoforms()):
        for at in range(0, len(seq) - 200 + 1, 2):
            for s in (seq[at : at + 75], turned(seq[at + 125 : at + 200])):
                i += 1
                rows.append((i, f"T{t}-{at}", i + 1 if i % 2 else i - 1, 1, s))
    return spark.createDataFrame(rows, "read_id long, name string, mate_id long, category short, seq string")


def test_contigs_hold_every_solid_kmer_once(spark, reads):
    nodes, places = contigs(reads, AssemblyOptions(k=21, coverage_cutoff=1))
    seqs = [r.seq for r in nodes.collect()]
    kmers = [min(k, turned(k)) for s in seqs for k in (s[i : i + 21] for i in range(len(s) - 20))]
    want = {min(k, turned(k)) for (s,) in reads.select("seq").collect() for k in (s[i : i + 21] for i in range(55))}
    assert len(kmers) == len(set(kmers)) and set(kmers) == want
    assert len(seqs) == 4  # before the exon, the exon, the join without it, after it
    assert places.count() == len(want)


def test_reads_lie_where_they_match(spark, reads):
    nodes, places = contigs(reads, AssemblyOptions(k=21, coverage_cutoff=1))
    seq = {r.node_id: r.seq for r in nodes.collect()}
    text = {r.read_id: r.seq for r in reads.collect()}
    for r in place_reads(reads, nodes, places, 21).collect():
        contig = seq[r.node_id] if r.node_id > 0 else turned(seq[-r.node_id])
        assert contig[r.pos : r.pos + 21] == text[r.read_id][r.off : r.off + 21]


def test_assembly_finds_both_isoforms(spark, reads):
    libraries = spark.createDataFrame([(1, 200.0, 10.0)], "category short, mean double, sd double")
    found = assemble(reads, libraries, AssemblyOptions(k=21, coverage_cutoff=2, scaffolding=True))
    seqs = {r.seq for r in found.sequences.collect()}
    assert found.members.select("locus_id").distinct().count() == 1
    one, other = isoforms()
    hit = [any(s in w or turned(s) in w for w in (one, other)) for s in seqs]
    assert all(hit) and max(map(len, seqs)) >= 600


def test_merge_drops_what_is_contained(spark):
    one, other = isoforms()
    seqs = spark.createDataFrame([(1, one), (2, one[50:400]), (3, turned(one)), (4, other)], "seq_id long, seq string")
    found, out = merge(seqs, AssemblyOptions(k=27))
    assert {r.transcript_id for r in found.collect()} == {1, 4} and out.count() == 2
    assert found.select("locus_id").distinct().count() == 1


def test_fasta_round_trip(spark, tmp_path, reads):
    path = str(tmp_path / "out")
    write_text(reads_fasta(reads), path, "read_id")
    back = read_fasta(spark, path)
    assert back.count() == reads.count()
    assert back.selectExpr("id as read_id", "name", "category", "seq").exceptAll(reads.select("read_id", "name", "category", "seq")).count() == 0
    mates = pair_up(back, "id").selectExpr("id as read_id", "mate_id")
    assert mates.exceptAll(reads.select("read_id", "mate_id")).count() == 0


def test_fasta_dirt(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">one\t7\t1\r\nacg\r\nt\r\n>two\nAC GT\n\n>\nAAAA\n>three\n")
    assert sorted(map(tuple, read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("one", 7, 1, "ACGT"), ("three", None, None, ""), ("two", None, None, "ACGT")]


def test_command_line(spark, tmp_path, reads):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_text(reads_fasta(reads), source, "read_id")
    main([source, out, "--coverage-cutoff", "2", "--insert", "1:200:10", "--scaffolding", "--unused-reads"])
    found = read_fasta(spark, f"{out}/transcripts.fa").collect()
    assert found and all(any(r.seq in w or turned(r.seq) in w for w in isoforms()) for r in found)
    assert all(r.name.endswith(f"_Length_{len(r.seq)}") for r in found)
    heads = spark.read.text(f"{out}/contig-ordering.txt").where("value like '>%'")
    assert heads.where("value like '>Locus_%_Transcript_%'").count() == len(found)
    assert heads.where("value like '>Locus_%_Node_%'").count() == 4  # before the exon, the exon, the join without it, after it
    assert read_fasta(spark, f"{out}/unused-reads.fa").count() < reads.count()


def test_ids_in_the_order_of_the_file_and_its_splits(spark, tmp_path):
    (tmp_path / "b.fa").write_text("".join(f">r{i}\n{'ACGT' * (i % 9 + 1)}\n" for i in range(1, 400)))
    (tmp_path / "c.fa").write_text(">r400\nAC\n>r401\t7\t3\nGT\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    found = read_numbered_fasta(spark, str(tmp_path), 1).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.id, r.name, r.category) for r in found) == [(i, f"r{i}", 3 if i == 401 else 1) for i in range(1, 402)]
    (tmp_path / "c.fa").write_text(">x\t7\t3\nGT\n>y\t9\t2\nGT\n")
    assert sorted((r.id, r.name) for r in read_numbered_fasta(spark, str(tmp_path / "c.fa")).collect()) == [(7, "x"), (9, "y")]


def test_command_line_on_plain_headers(spark, tmp_path, reads):
    """Names only: pairs follow each other, and both isoforms and where a reference lies on them come out."""
    (tmp_path / "in").mkdir()
    rows = reads.orderBy("read_id").collect()
    (tmp_path / "in" / "a.fa").write_text("".join(f">{r.name}\n{r.seq}\n" for r in rows))
    one, other = isoforms()
    (tmp_path / "in" / "b.fa").write_text(f">gene:100-{99 + len(one)}\t{len(rows) + 1}\t6\n{one}\n")
    main([str(tmp_path / "in"), str(tmp_path / "out"), "--category", "1", "--coverage-cutoff", "2", "--insert", "1:200:10", "--alignments"])
    found = read_fasta(spark, str(tmp_path / "out" / "transcripts.fa")).collect()
    assert {min(r.seq, turned(r.seq)) for r in found if len(r.seq) >= 600} == {min(s, turned(s)) for s in (one, other)}
    lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "out" / "transcript-alignments.psa")).where("value not like '>%'").collect()]
    assert {("gene", "100", str(99 + len(one)))} <= {(name, *sorted((first, last), key=int)) for _, _, name, first, last in lines}
    report = [r.value for r in spark.read.text(str(tmp_path / "out" / "report.txt")).collect()]
    assert report[0].startswith("4 contigs, n50") and report[1].endswith(f"of {len(rows) + 1} reads used")


def test_a_file_that_is_not_there(spark, tmp_path):
    with pytest.raises(SystemExit, match="PATH_NOT_FOUND"):
        main([str(tmp_path / "none.fa"), str(tmp_path / "out")])


def test_command_line_merges_only(spark, tmp_path):
    one, other = isoforms()
    (tmp_path / "t.fa").write_text(f">a\n{one}\n>b\n{turned(one[40:500])}\n>c\n{other}\n")
    main([str(tmp_path / "t.fa"), str(tmp_path / "out"), "--merge-only", "--merge-k", "27"])
    assert {r.seq for r in read_fasta(spark, str(tmp_path / "out" / "transcripts.fa")).collect()} == {one, other}


def test_arguments(spark):
    args = arguments(["in", "out", "--k", "19", "21", "--insert", "1:200", "3:500:40", "--min-pair-count", "2"])
    options = options_of(args)
    assert (options.k, options.min_pair_count, options.coverage_cutoff, args.merge_k) == (19, 2, 3.0, 27)
    assert sorted(map(tuple, libraries_of(spark, args.insert).collect())) == [(1, 200.0, 20.0), (3, 500.0, 40.0)]
    assert libraries_of(spark, []).count() == 0
