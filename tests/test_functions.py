import math
import random

import pytest
from pyspark.sql import functions as F

from strandwork.config import AssemblyOptions
from strandwork.functions import dna, stats
from strandwork.operators.similarity import common_length, similar

TURN = str.maketrans("ACGT", "TGCA")


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()[0]


def test_sequences(spark):
    s = F.col("s")
    assert one(spark, dna.clean_sequence(s), s=" acgn\r\n") == "ACGN" and one(spark, dna.clean_sequence(s), s=" \t") is None
    assert one(spark, dna.reverse_complement(s), s="ACGTX") == "NACGT"
    assert one(spark, dna.kmers(s, 3), s="ACGTA") == ["ACG", "CGT", "GTA"] and one(spark, dna.kmers(s, 3), s="AC") == []
    assert one(spark, dna.canonical(s), s="TTT") == "AAA"
    assert one(spark, dna.wrap(s, 4), s="ACGTACGT") == "ACGT\nACGT" and one(spark, dna.wrap(s, 4), s="ACGTA") == "ACGT\nA"
    assert one(spark, dna.trim_unknown(s), s="NNACN") == "ACN"
    assert [one(spark, dna.codon_count(s, dna.STOPS, f), s="TAATGATAG") for f in range(3)] == [3, 0, 0]
    assert one(spark, dna.codon_count(s, dna.STOPS, 0), s="TA") == 0
    assert one(spark, dna.poly_a_signal(s), s="CCATTAAAC") and not one(spark, dna.poly_a_signal(s), s="CCATTTAAC")


@pytest.mark.parametrize(
    "header, want",
    [(">chr:5-9", ("chr", 5, 9, True)), (">chr:9-5", ("chr", 5, 9, False)), (">plain", ("plain", 1, -1, True)), ("", ("", 1, -1, True)), (">a:x-3", ("a:x-3", 1, -1, True))],
)
def test_reference_headers(spark, header, want):
    df = spark.createDataFrame([(header,)], "h string")
    assert tuple(df.select(*(c.alias(n) for n, c in dna.reference_coordinates(F.col("h")).items())).first()) == want


def test_erf_and_expected_pairs(spark):
    for x in (-3.0, -0.4, 0.0, 0.2, 1.7):
        assert abs(one(spark, stats.erf(F.col("x")), x=x) - math.erf(x)) < 2e-7
    args = [F.col(c) for c in ("d", "a", "b", "m", "n", "mean", "sd")]
    value = {"d": 210.0, "a": 300, "b": 200, "m": 100, "n": 90, "mean": 200.0, "sd": 20.0}
    assert one(spark, stats.expected_pairs(*args), **value) > 0
    assert one(spark, stats.expected_pairs(*args), **(value | {"mean": 0.0})) == 0
    assert one(spark, stats.expected_pairs(*args), **(value | {"d": 5000.0})) == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_common_length_and_similarity(spark):
    draw = random.Random(1)
    rows = [("".join(draw.choice("ACGT") for _ in range(draw.randrange(1, 40))), "".join(draw.choice("ACGT") for _ in range(draw.randrange(1, 40)))) for _ in range(40)] + [("", "AC"), ("ACGT", "ACGT")]
    df = spark.createDataFrame(rows, "a string, b string")
    for a, b, n in df.select("a", "b", common_length(F.col("a"), F.col("b"))).collect():
        assert n == (lcs(a, b) if a and b else 0)
    alike = lambda a, b, k: one(spark, similar(F.col("a"), F.col("b"), k), a=a, b=b)
    assert alike("ACGTACGTAC", "ACGTTCGTAC", 5) and not alike("ACGTACGTAC", "TTTTTTTTTT", 5)
    assert not alike("ACGTACGTACGTACGTACGT", "ACGTACGTACGTACGT", 21) and not alike("", "A", 5)


def test_even_k_is_refused():
    with pytest.raises(ValueError):
        AssemblyOptions(k=22)
