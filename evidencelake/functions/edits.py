"""Edit distances of whole texts: Myers's bit-parallel columns, with one long integer for all blocks of a column."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

#: Places of a symbol from which its bits are packed at once.
MANY = 64


def places(pattern: Sequence[Hashable]) -> dict[Hashable, int]:
    """For each symbol of the pattern an integer with a bit at each of its places."""
    at: dict[Hashable, list[int]] = {}
    for i, symbol in enumerate(pattern):
        at.setdefault(symbol, []).append(i)
    out = {}
    for symbol, where in at.items():
        if len(where) < MANY:
            out[symbol] = sum(1 << i for i in where)
        else:
            bits = np.zeros(len(pattern), np.uint8)
            bits[where] = 1
            out[symbol] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def within(short: Sequence[Hashable], long: Sequence[Hashable]) -> bool:
    """Whether the long one, with some of its symbols dropped, is the short one."""
    rest = iter(long)
    return all(symbol in rest for symbol in short)


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Insertions, deletions and replacements that lead from a to b, at least.

    The difference of the lengths bounds it from below, and is reached just where the longer one holds the shorter one in
    order: that is looked for first, in one pass.
    """
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)
    while low < high and a[low] == b[low]:
        low += 1
    while high > low and a[high - 1] == b[high - 1 + len(b) - len(a)]:
        high -= 1
    a, b = a[low:high], b[low : high + len(b) - len(a)]
    n = len(a)
    if within(a, b):
        return len(b) - n
    equal, every, last = places(a), (1 << n) - 1, 1 << (n - 1)
    up, down, score = every, 0, n  # places at which a column rises and falls
    for symbol in b:
        same = equal.get(symbol, 0)
        across = (((same & up) + up) ^ up) | same
        rises, falls = down | (every & ~(across | up)), up & across
        if rises & last:
            score += 1
        elif falls & last:
            score -= 1
        same |= down
        rises, falls = ((rises << 1) | 1) & every, (falls << 1) & every
        up, down = falls | (every & ~(same | rises)), rises & same
    return score
