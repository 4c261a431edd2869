"""Bit fields of keys, and row positions that are permuted without a shuffle."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers of the permutations that the workloads are stated with.
PK_MULTIPLIER, PK_OFFSET = 2654435761, 42
FK_MULTIPLIER, FK_OFFSET = 40503, 7


def radix(key: Column, bits: int, first_bit: int = 0) -> Column:
    """`bits` bits of the key from first_bit on, as a long. Negative keys count by their two's
    complement, so that every key has one partition from 0 to 2**bits - 1."""
    return F.shiftrightunsigned(key.cast("long"), first_bit).bitwiseAND((1 << bits) - 1)


def permuted(position: Column, n: int, multiplier: int = PK_MULTIPLIER, offset: int = PK_OFFSET) -> Column:
    """A permutation of 0 .. n - 1, as (position * multiplier + offset) % n. A multiplier that has a
    factor in common with n, or would overflow a long, is replaced by the next smaller one that
    doesn't."""
    step = multiplier % n or 1
    step = min(step, (2**63 - 1 - offset) // n)
    while step > 1 and gcd(step, n) > 1:
        step -= 1
    return (position * F.lit(step).cast("long") + F.lit(offset % n).cast("long")) % n
