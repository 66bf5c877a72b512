"""Repeatable randomness: values depend on (seed, key) only, never on partitioning.

The first 13 hex digits of an md5 give 52 bits, which a DOUBLE holds exactly;
the next 13 give a second, independent draw from the same digest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U52 = float(2**52)


def digest(seed: str | int, *keys: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.md5(text.cast("binary"))


def _bits(hex_text: Column, start: int) -> Column:
    return F.conv(F.substring(hex_text, start, 13), 16, 10).cast("bigint")


def hash_order(seed: str | int, *keys: Column) -> Column:
    """52-bit LONG that orders rows at random."""
    return _bits(digest(seed, *keys), 1)


def hash_uniform(seed: str | int, *keys: Column) -> Column:
    """DOUBLE in [0, 1)."""
    return hash_order(seed, *keys).cast("double") / F.lit(U52)


def hash_normal(seed: str | int, *keys: Column) -> Column:
    """Standard normal by Box-Muller; both uniforms come from one digest."""
    d = digest(seed, *keys)
    u1 = (_bits(d, 1).cast("double") + F.lit(0.5)) / F.lit(U52)
    u2 = _bits(d, 14).cast("double") / F.lit(U52)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def short_hash(text: Column) -> Column:
    """First 8 hex digits of the sha-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, 8)
