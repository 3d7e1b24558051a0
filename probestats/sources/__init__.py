"""Readers and writers: delimited matrices, manifests, binary matrices, gene sets, result tables."""
