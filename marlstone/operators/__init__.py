"""Relational operators on matrices: DataFrame to DataFrame, no collects."""
