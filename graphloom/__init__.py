"""A knowledge-graph mapping and query engine on PySpark."""

from .api import Mapping, Node, Triple, to_graph

__all__ = ["Mapping", "Node", "Triple", "to_graph"]
