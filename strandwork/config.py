"""Options of an assembly and their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AssemblyOptions:
    """`categories` is the number of short-read libraries: categories above 2 * `categories` + 1 hold reference sequences."""

    k: int = 21
    coverage_cutoff: float = 3.0
    min_transcript_length: int = 100
    degree_cutoff: int = 3
    unique_length: int = 50
    paired_cutoff: float = 0.1
    min_pair_count: int = 4
    edge_fraction_cutoff: float = 0.01
    scaffolding: bool = False
    weight_cap: float = 1000.0
    max_divergence: float = 0.2
    max_gaps: int = 3
    max_branch: int = 100
    max_transcripts: int = 10
    double_stranded: bool = True
    categories: int = 2

    def __post_init__(self) -> None:
        if self.k % 2 == 0:
            raise ValueError("k must be odd, so that no k-mer is its own reverse complement")
