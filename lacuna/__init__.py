"""Lacuna: multiple-point statistics and gap filling on gridded data, expressed as Spark plans."""

__version__ = "0.1.0"
