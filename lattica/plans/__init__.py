from .components import connected, connected_capped, connected_components
from .khop import k_hop
from .labels import label_history, label_propagation, label_resume
from .pagerank import normalise, pagerank
from .skipping import Monotone, connected_skipping, shortest_paths_skipping, skipping
from .sssp import pack, shortest_paths

__all__ = ["Monotone", "connected_skipping", "shortest_paths_skipping", "skipping", "connected", "connected_capped", "connected_components", "k_hop", "label_history", "label_propagation", "label_resume", "normalise", "pack", "pagerank", "shortest_paths"]
