"""Strongly connected components and the queries around them, over DataFrames.

Edges are rows (src, dst), vertices rows (v), labels rows (v, scc); scc is the least vertex id
of the component, so every plan gives the same labels."""

from .graph import Graph

__all__ = ["Graph"]
