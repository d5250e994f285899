from .cost import partition_report
from .pregel import DIRECTIONS, PregelSpec, Send, active_edges, pregel

__all__ = ["DIRECTIONS", "PregelSpec", "Send", "active_edges", "partition_report", "pregel"]
