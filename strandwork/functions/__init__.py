"""Column functions for sequences, coordinates and the statistics of read pairs."""
