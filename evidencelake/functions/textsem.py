"""String semantics shared by all operators: white space, word boundaries, 32-bit arithmetic, log-factorials."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white-space characters of ECMAScript's \s, as a class that Java and RE2 both read.
WS = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WS_BODY = WS[1:-1]
#: The same characters as one text.
WS_CHARS = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: WS for Java alone, which asks first for what most characters are not.
WS_RARE = rf"[[\x00-\x20\x{{7F}}-\x{{10FFFF}}]&&{WS}]"
#: ASCII word boundary, which Java's \b is not.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS_RARE}+|{WS_RARE}+$", "")


def norm_ws(c: Column, lower: bool = False) -> Column:
    """White-space runs to one space, ends trimmed."""
    out = F.trim(F.regexp_replace(c, f"{WS_RARE}+", " "))
    return F.lower(out) if lower else out


def quoted(literal: str) -> str:
    """A pattern that matches exactly this text in Java and RE2."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", literal)


def mul32(a: Column, b: Column) -> Column:
    """Low 32 bits of the product of two unsigned 32-bit numbers held in longs."""
    low, mask = F.lit(65535), F.lit(0xFFFFFFFF)
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(low), 16)
    return (high + a * b.bitwiseAND(low)).bitwiseAND(mask)


def log_factorials(most: int) -> Column:
    """Array literal of ln(0!) to ln(most!)."""
    return F.array(*(F.lit(math.lgamma(i + 1)) for i in range(most + 1)))
