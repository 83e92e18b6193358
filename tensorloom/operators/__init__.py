"""Operators on tensors of coordinate rows, and dense kernels on packed ones."""
