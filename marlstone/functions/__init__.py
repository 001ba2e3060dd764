"""Test matrices made from tables."""
