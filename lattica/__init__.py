"""lattica: a PySpark-native engine for vertex-centric analytics on large directed multigraphs."""

from .graph import Graph
from .operators.pregel import PregelSpec, Send, pregel

__all__ = ["Graph", "PregelSpec", "Send", "pregel"]
