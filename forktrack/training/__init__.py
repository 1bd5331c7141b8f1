"""Training of per-k-mer level models."""
