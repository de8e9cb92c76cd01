"""Readers and writers of grids, and intermediate tables."""
