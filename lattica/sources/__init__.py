from .edge_list import parse_edges, read_edge_list
from .fixtures import FIXTURES, fixture
from .generate import log_normal_graph

__all__ = ["FIXTURES", "fixture", "log_normal_graph", "parse_edges", "read_edge_list"]
