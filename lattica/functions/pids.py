"""Partition-id expressions: ``(src, dst, n) -> int`` column. Any such callable is a partitioner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the mixing prime of the hash partitioners.
MIXING_PRIME = 1125899906842597


def _wrapped_abs_mod(x: Column, n: int) -> Column:
    """``abs(x * prime) % n`` with 64-bit wrap-around, in decimals as ANSI mode rejects the overflow."""
    two64 = F.lit(str(1 << 64)).cast("decimal(38,0)")
    product = F.pmod(x.cast("decimal(19,0)") * F.lit(MIXING_PRIME).cast("decimal(16,0)"), two64)
    signed = F.when(product >= F.lit(str(1 << 63)).cast("decimal(38,0)"), product - two64).otherwise(product)
    return (F.abs(signed) % F.lit(n).cast("decimal(38,0)")).cast("int")


def reverse_1d_pid(src: Column, dst: Column, n: int) -> Column:
    """All in-edges of a vertex together."""
    return _wrapped_abs_mod(dst, n)


def block_pid(block: int):
    """Contiguous blocks of source ids; whole blocks are dealt by hash."""
    if block < 1:
        raise ValueError("block must be positive")
    return lambda src, dst, n: _wrapped_abs_mod(F.call_function("div", src, F.lit(block)), n)


def random_cut_pid(src: Column, dst: Column, n: int) -> Column:
    """Vertex cut: parallel edges together, the edges of a vertex spread."""
    low = F.lit(1 << 31)  # residues first: the product of a large id would overflow
    mixed = F.pmod(F.pmod(src, low) * F.lit(31) + F.pmod(dst, low), low)
    return F.pmod(mixed * F.lit(1000003), F.lit(n)).cast("int")
