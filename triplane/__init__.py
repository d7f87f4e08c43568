"""Triplane: a knowledge-graph and corpus analytics library on PySpark DataFrames."""

__version__ = "0.1.0"
