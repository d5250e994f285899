from .pids import block_pid, random_cut_pid, reverse_1d_pid

__all__ = ["block_pid", "random_cut_pid", "reverse_1d_pid"]
