"""Operators on grids held as rows of cells."""
