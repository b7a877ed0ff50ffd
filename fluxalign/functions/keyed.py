"""Keyed pseudo-randomness: values follow from a key, never from partitioning or order."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_hash(*key) -> Column:
    """The first 32 bits of the MD5 of the key's parts joined by |."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def uniform(*key) -> Column:
    return (keyed_hash(*key).cast("double") + F.lit(0.5).cast("double")) / F.lit(4294967296.0)


def normal(*key) -> Column:
    """Box-Muller on two uniforms of the key."""
    return F.sqrt(-2.0 * F.log(uniform("a", *key))) * F.cos(2.0 * math.pi * uniform("b", *key))


#: Prime modulus of the draws, and odd multipliers; fixed values that the SQL of the tests repeats.
PRIME, BY_REPLICATE, BY_PLACE, STEP_A, STEP_B = 2147483647, 104729, 15485863, 48271, 40692


def draws(g: int, replicate: int, place: np.ndarray, n: int) -> np.ndarray:
    """The draws at these places of a replicate: 0 to n - 1, by squaring modulo a prime (no product
    exceeds 63 bits for places below 2^39). The plain form of what ``draw_counts`` computes."""
    x1 = (g + replicate * BY_REPLICATE + place * BY_PLACE) % PRIME
    x2 = (x1 * x1 + g) % PRIME
    x3 = (x2 * x2 + x1 * STEP_A) % PRIME
    x4 = (x3 * x3 + x2 * STEP_B + replicate) % PRIME
    return (x3 * 2147483648 + x4) % n


#: Draws that are computed together: what a step reads and writes stays in a core's cache.
BLOCK = 1 << 14


def draw_counts(g: int, replicates: range, start: int, stop: int, n: int, owner: Callable[[np.ndarray], np.ndarray], owners: int) -> np.ndarray:
    """One row a replicate: how often each owner's places are drawn by the draws ``start`` to ``stop``.

    ``owner`` gives the owners, 0 to ``owners`` - 1, of places. The draws are those of ``draws``.
    """
    u = np.uint64
    found = np.zeros((len(replicates), owners), dtype=np.int64)
    wide = min(BLOCK, stop - start)
    tall = max(1, BLOCK // wide)
    room = [np.empty((tall, wide), dtype=u) for _ in range(5)]
    numbers = np.array(replicates, dtype=u)[:, None]
    begin = (u(g) + numbers * u(BY_REPLICATE)) % u(PRIME)
    for at in range(start, stop, wide):
        place = np.arange(at, min(at + wide, stop), dtype=u) * u(BY_PLACE) % u(PRIME)
        for first in range(0, len(replicates), tall):
            r = numbers[first : first + tall]
            x1, x2, x3, x4, spare = (b[: len(r), : len(place)] for b in room)
            _rest(np.add(place, begin[first : first + tall], out=x1), spare, 0)
            np.add(np.multiply(x1, x1, out=x2), u(g), out=x2)
            _rest(x2, spare, 1)
            np.add(np.multiply(x2, x2, out=x3), np.multiply(x1, u(STEP_A), out=x1), out=x3)
            _rest(x3, spare, 2)
            np.add(np.multiply(x3, x3, out=x4), np.multiply(x2, u(STEP_B), out=x2), out=x4)
            _rest(np.add(x4, r, out=x4), spare, 2)
            np.add(np.left_shift(x3, u(31), out=x3), x4, out=x3)
            # Division by one number is done by multiplication; the remainder's own function divides.
            np.subtract(x3, np.multiply(np.floor_divide(x3, u(n), out=spare), u(n), out=spare), out=x3)
            which = owner(x3.view(np.int64))
            for i, row in enumerate(which, first):
                found[i] += np.bincount(row, minlength=owners)
    return found


def _rest(x: np.ndarray, spare: np.ndarray, folds: int) -> None:
    """x modulo PRIME, which is 2^31 - 1, in place: without folds of numbers below 2 PRIME, with one of
    those whose high bits are PRIME at most, with two of any below 2^63."""
    for _ in range(folds):
        np.bitwise_and(x, np.uint64(PRIME), out=spare)
        np.add(np.right_shift(x, np.uint64(31), out=x), spare, out=x)
    # What is below PRIME wraps around to a large number and loses.
    np.minimum(x, np.subtract(x, np.uint64(PRIME), out=spare), out=x)
