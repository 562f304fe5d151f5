"""Readers and writers: Parquet tables, FASTA, path lists, tabular and message exports."""
