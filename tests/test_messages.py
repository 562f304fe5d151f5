from strandwork.operators import transcripts
from strandwork.sources.sinks import messages

TURN = str.maketrans("ACGT", "TGCA")


def test_reads_on_both_strands_are_placed(spark):
    k, contig = 5, {1: "ACGTTGCAACGT", 2: "ACGTCCATGGTC"}  # 2 follows 1 with an overlap of 4
    whole = contig[1] + contig[2][4:]
    turned = lambda s: s[::-1].translate(TURN)
    nodes = spark.createDataFrame([(n, len(s) - 4, s) for n, s in contig.items()], "node_id long, len int, seq string")
    laid = transcripts.layout(spark.createDataFrame([(1, 7, [1, 2], [0, 0])], "locus_id long, transcript_id long, node_path array<long>, gaps array<long>"), nodes, k)
    reads, occ, want = [], [], {}
    for i, (at, back) in enumerate([(2, False), (2, True), (9, True), (10, False)], 1):
        seq = turned(whole[at : at + 7]) if back else whole[at : at + 7]
        reads.append((i, None, 1, seq))
        node = 1 if at < 8 else 2
        text = turned(contig[node]) if back else contig[node]
        off = next(j for j in range(3) if seq[j : j + k] in text)
        occ.append((i, -node if back else node, text.index(seq[off : off + k]), off))
        want[i] = (at, "7,0" if back else "0,7")
    libraries = spark.createDataFrame([], "category short, mean double, sd double")
    rows = messages(
        libraries,
        spark.createDataFrame(reads, "read_id long, mate_id long, category short, seq string"),
        laid,
        spark.createDataFrame(occ, "read_id long, node_id long, pos long, off long"),
        nodes,
        k,
    )
    contig_ = [r.value for r in rows.where("kind = '4CTG'").collect()]
    assert contig_ == [f"{{CTG\niid:1\neid:1-7-0\nseq:\n{whole}\n.\nqlt:\n{'I' * len(whole)}\n.\n}}"]
    assert [r.value for r in rows.where("kind = '5SCF'").collect()] == [f"{{SCF\neid:1-7\n{{TLE\noff:0\nclr:0,{len(whole)}\nsrc:1\n}}\n}}"]
    rows = rows.where("kind = '6TLE'")
    fields = [dict(line.split(":") for line in r.value.split("\n") if ":" in line) for r in rows.collect()]
    assert {int(f["src"]): (int(f["off"]), f["clr"]) for f in fields} == want and len(fields) == 4
