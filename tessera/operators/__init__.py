"""Reductions and matrix-vector products."""
