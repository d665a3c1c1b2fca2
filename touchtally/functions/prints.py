"""Fingerprints of sequences that can be put together from their parts.

A sequence v1, v2, ... has the hash sum of v_i * base**i modulo a prime. Of two parts one after the other, the whole has
hash(first) + base**length(first) * hash(second). Modulo a prime no family of texts collides whatever
the base is, as it would modulo a power of two. All of it is arithmetic on longs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**31 - 1: a product of two residues fits a long.
PRIME = 2_147_483_647
HASHES = 2
_BASES = (1_082_514_731, 478_163_327)
# Powers come from tables of 2**_BITS entries, one per digit of the exponent, up to 2**42.
_BITS, _DIGITS = 6, 7


def power(exponent: Column, k: int) -> Column:
    """base**exponent of hash ``k``, for exponents from 0."""
    out = None
    for digit in range(_DIGITS):
        base = pow(_BASES[k], 1 << (_BITS * digit), PRIME)
        table = F.expr("array(" + ", ".join(f"{pow(base, i, PRIME)}L" for i in range(1 << _BITS)) + ")")
        entry = F.get(table, F.shiftright(exponent, _BITS * digit).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int"))
        out = entry if out is None else (out * entry) % PRIME
    return out


def term(value: str, place: str, k: int) -> Column:
    """What the value at ``place`` adds to hash ``k``; NULL without a value."""
    residue = F.pmod(F.xxhash64(F.col(value), F.lit(k)), F.lit(PRIME - 1)) + 1
    return F.when(F.col(value).isNotNull(), (residue * power(F.col(place).cast("long"), k)) % PRIME)


def residue_sum(terms: Column) -> Column:
    """Sum of up to 2**32 residues, as a residue."""
    return F.coalesce(F.sum(terms), F.lit(0)) % PRIME


def joined(parts: str, k: int) -> Column:
    """Hash ``k`` of parts in order, given as structs with ``length`` and ``h<k>``."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(
        parts, start,
        lambda done, x: F.struct(
            (done["n"] + x["length"]).alias("n"), ((done["h"] + power(done["n"], k) * x[f"h{k}"]) % PRIME).alias("h")
        ),
        lambda done: done["h"],
    )
