"""Column functions: sequences, log space, text, CIGAR and modification tags."""
