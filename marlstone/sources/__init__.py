"""Readers and writers of matrices and vectors."""
