"""Whole runs: factorisation, solve, sweeps, bordered blocks, reports."""
