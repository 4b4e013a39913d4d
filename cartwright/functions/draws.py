"""Pseudo-random draws that depend only on a key.

``rand()`` gives other values when a task is retried or the data is partitioned differently. Here
a draw is 32 bits mixed from a whole-number key, a salt and a slot: the same row always draws the
same value, on any cluster and in any engine with 64-bit integers. The products stay below 2**63, so
nothing overflows.
"""

from __future__ import annotations

from collections.abc import Sequence
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**32
LOW, LOW_31 = SPAN - 1, 2**31 - 1
#: Odd multipliers: of the low and high part of the key, and of the mixed value.
SPREAD, SPREAD_HIGH, FACTOR = 0x2545F491, 0x1B873593, 0x45D9F3B


def seed(salt: str, slot: int) -> int:
    """32 bits that tell the draws of one salt and slot from those of another."""
    return crc32(f"{salt}/{slot}".encode())


def draw(salt: str, key: Column, slot: int = 0) -> Column:
    """Uniform integer in ``[0, 2**32)`` from a whole-number key."""
    key = key.cast("bigint")
    low, high = key.bitwiseAND(F.lit(LOW_31)), F.shiftright(key, 31).bitwiseAND(F.lit(LOW_31))
    value = (low * F.lit(SPREAD) + high * F.lit(SPREAD_HIGH) + F.lit(seed(salt, slot))).bitwiseAND(F.lit(LOW))
    value = (F.shiftright(value, 16).bitwiseXOR(value) * F.lit(FACTOR)).bitwiseAND(F.lit(LOW))
    return F.shiftright(value, 15).bitwiseXOR(value)


def text_key(text: Column) -> Column:
    """A whole-number key from a text: the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def below(value: Column, probability: float) -> Column:
    return value < F.lit(int(probability * SPAN))


def uniform_int(value: Column, low: int, high: int) -> Column:
    """Uniform integer in ``[low, high)``."""
    return F.lit(low) + F.shiftright(value * F.lit(high - low), 32)


def uniform_decimal(value: Column, low: float, high: float, digits: int) -> Column:
    """Uniform double in ``[low, high]`` with that many decimals."""
    scale = 10**digits
    steps = uniform_int(value, round(low * scale), round(high * scale) + 1)
    return steps / F.lit(float(scale))


def choice(value: Column, options: Sequence[str]) -> Column:
    position = uniform_int(value, 1, len(options) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), position)


def weighted_choice(value: Column, weights: dict[str, float]) -> Column:
    """One of the keys of ``weights``, each with its probability (they add up to one)."""
    *first, last = weights
    bound, picked = 0.0, None
    for option in first:
        bound += weights[option]
        test = value < F.lit(round(bound * SPAN))
        picked = F.when(test, option) if picked is None else picked.when(test, option)
    return F.lit(last) if picked is None else picked.otherwise(F.lit(last))
