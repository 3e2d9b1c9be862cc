"""Numpy kernels of single windows and RR series, Column expressions, and the Arrow functions that apply the kernels."""
