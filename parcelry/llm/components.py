"""Connected components of a graph given by its edges: node, component."""

from parcelry.operators.graph import stars as components

__all__ = ["components"]
