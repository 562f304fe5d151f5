"""Relational and iterative operators over reads, contigs, connections, loci and transcripts."""
