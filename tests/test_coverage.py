import random

from strandwork.config import AssemblyOptions
from strandwork.plans.pipeline import covered


def test_the_cutoff_is_of_whole_contigs(spark):
    draw = random.Random(3)
    deep, rare = ("".join(draw.choice("ACGT") for _ in range(n)) for n in (300, 120))
    # every base of `deep` is covered well, but for its end; `rare` is covered once or twice
    seqs = [deep[at : at + 60] for at in range(0, 226, 3)] + [deep[240:300]] + [rare[:60], rare[30:90], rare[60:120]]
    reads = spark.createDataFrame(list(enumerate(seqs, 1)), "read_id long, seq string")
    nodes, _, occ, dubious = covered(reads, AssemblyOptions(k=21))
    turned = deep[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert [r.seq in (deep, turned) for r in nodes.collect()] == [True]
    assert {r.read_id for r in dubious.collect()} == set(range(len(seqs) - 2, len(seqs) + 1))
    assert {r.read_id for r in occ.collect()} == set(range(1, len(seqs) - 2))
