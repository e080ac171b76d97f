"""Inputs: BAM, BED, FASTA and the view over star-schema tables."""
