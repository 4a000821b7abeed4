"""Spark jobs over tables of cosmological parameter sweeps, and over training corpora (subpackage llm)."""
