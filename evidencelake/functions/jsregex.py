"""ECMAScript patterns in the three forms this library runs: one pass over the pattern, refused where ECMAScript refuses it.

- NATIVE, a Java pattern for Spark's own functions: for patterns that cannot backtrack far, whatever the text;
- LINEAR, an RE2 pattern for Arrow's functions: time linear in the text, no look-around, no back references;
- TIMED, a pattern for a backtracking matcher with a limit of time: for what is left.

Without the `u` flag the lenient reading of browsers holds: an escaped letter without a meaning is itself, a number
beyond the groups is an octal code. Lookbehinds without a bound are bounded at LOOKBEHIND repeats in Java, which needs one.
A reference to a group that took no part matches the empty text; groups keep what they last held from one turn of a
repetition to the next, where ECMAScript forgets it.
"""

from __future__ import annotations

import re

from .textsem import EDGE, WS, WS_BODY

LOOKBEHIND = 255
NATIVE, LINEAR, TIMED = "native", "linear", "timed"
#: A native pattern's bounded repeats may be tried in so many ways at a place; RE2 repeats so often at most.
MOST_WAYS, MOST_REPEATS = 1000, 1000
_WORD, _NOT_WORD = "A-Za-z0-9_", r"\x00-/:-@\[-\^`{-\x{10FFFF}"
_NOT_WS = r"\x00-\x08\x0E-\x1F!-\x{9F}\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{FEFE}\x{FF00}-\x{10FFFF}"
_ENDS = r"\n\r\x{2028}\x{2029}"
#: What \d, \D, \w, \W, \s and \S stand for inside a class.
INSIDE = {"d": "0-9", "D": r"\x00-/:-\x{10FFFF}", "w": _WORD, "W": _NOT_WORD, "s": WS_BODY, "S": _NOT_WS}
#: Long names of general categories.
CATEGORIES = {
    "Letter": "L", "Cased_Letter": "LC", "Uppercase_Letter": "Lu", "Lowercase_Letter": "Ll", "Titlecase_Letter": "Lt", "Modifier_Letter": "Lm", "Other_Letter": "Lo",
    "Mark": "M", "Nonspacing_Mark": "Mn", "Spacing_Mark": "Mc", "Enclosing_Mark": "Me", "Number": "N", "Decimal_Number": "Nd", "Letter_Number": "Nl", "Other_Number": "No",
    "Punctuation": "P", "Symbol": "S", "Math_Symbol": "Sm", "Currency_Symbol": "Sc", "Modifier_Symbol": "Sk", "Other_Symbol": "So", "Separator": "Z", "Space_Separator": "Zs", "Other": "C", "Control": "Cc", "Format": "Cf",
}
SHORT = {*CATEGORIES.values(), "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Zl", "Zp", "Cs", "Co", "Cn"}
BINARY = {"Alphabetic", "Uppercase", "Lowercase", "White_Space", "Emoji", "Ideographic", "Hex_Digit"}


def _code(point: int) -> str:
    return f"\\x{{{point:X}}}"


class Unsupported(ValueError):
    """The pattern is right, but this form has no counterpart of something in it."""


#: An opening parenthesis that captures; escapes and classes are passed over.
_CAPTURES = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|(\((?!\?)|\(\?<[A-Za-z_$])", re.S)


class _Reader:
    def __init__(self, pattern: str, flags: str, form: str = NATIVE):
        self.form, self.groups = form, sum(1 for m in _CAPTURES.finditer(pattern) if m[1])
        #: Whether Java can be trusted with it; ways in which bounded repeats can be tried; an open end seen at the top.
        self.tame, self.ways, self.open_end = True, 1, False
        self.p, self.i, self.unicode, self.dot_all, self.lines = pattern, 0, "u" in flags, "s" in flags, "m" in flags
        self.names: list[str] = re.findall(r"\(\?<([A-Za-z_$][\w$]*)>", pattern)
        self.out: list[str] = []
        self.open: list[str] = []

    def at(self, text: str) -> bool:
        return self.p.startswith(text, self.i)

    def fail(self, why: str):
        raise ValueError(f"Invalid regular expression: {why}.")

    def take(self, pattern: str) -> re.Match | None:
        m = re.compile(pattern).match(self.p, self.i)
        if m:
            self.i = m.end()
        return m

    def escape(self, in_class: bool) -> str:
        """The escape after a backslash."""
        if self.i >= len(self.p):
            self.fail("\\ at end of pattern")
        c = self.p[self.i]
        self.i += 1
        if c in INSIDE:
            return INSIDE[c] if in_class else f"[{INSIDE[c]}]"
        if c == "b":
            return "\\x08" if in_class else "\\b" if self.form == LINEAR else EDGE
        if c == "B" and not in_class:
            return "\\B" if self.form == LINEAR else f"(?!{EDGE})"
        if c in "fnrtv":
            return {"f": "\\f", "n": "\\n", "r": "\\r", "t": "\\t", "v": "\\x0B"}[c]
        if c == "c" and (m := self.take("[A-Za-z]")):
            return _code(ord(m[0]) % 32)
        if c == "0" and not self.take("(?=[0-9])"):
            return "\\x00"
        if c == "x" and (m := self.take("[0-9A-Fa-f]{2}")):
            return _code(int(m[0], 16))
        if c == "u":
            if self.unicode and (m := self.take(r"\{([0-9A-Fa-f]+)\}")):
                if int(m[1], 16) > 0x10FFFF:
                    self.fail("code point out of range")
                return _code(int(m[1], 16))
            if m := self.take(r"([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})"):
                return _code(0x10000 + (int(m[1], 16) - 0xD800) * 0x400 + int(m[2], 16) - 0xDC00)
            if m := self.take("[0-9A-Fa-f]{4}"):
                return _code(int(m[0], 16))
        if c in "pP" and self.unicode:
            return self.property(c)
        if c in "123456789" and not in_class:
            m = re.compile("[0-9]*").match(self.p, self.i)
            if int(c + m[0]) <= self.groups:
                self.i = m.end()
                return self.reference(c + m[0])
            if self.unicode:
                self.fail("invalid escape")
        if c in "01234567":
            if self.unicode:
                self.fail("invalid escape")
            more = self.take("[0-7]{0,2}" if c in "0123" else "[0-7]?")[0]
            return _code(int(c + more, 8))
        if c == "k" and not in_class and (self.names or self.unicode):
            m = self.take(r"<([A-Za-z_$][\w$]*)>")
            if not m or m[1] not in self.names:
                self.fail("invalid named reference")
            return self.reference(f"g{self.names.index(m[1])}")
        if self.unicode and c not in r"^$\.*+?()[]{}|/" and not (in_class and c == "-"):
            self.fail("invalid escape")
        return f"\\{c}" if c in r"^$\.*+?()[]{}|-&" else _code(ord(c)) if ord(c) < 128 else c

    def reference(self, group: str) -> str:
        """What a group holds, or the empty text. Only the timed form can ask whether a group took part."""
        if self.form != TIMED:
            raise Unsupported("back reference")
        return f"(?({group})(?P={group}))" if group[0] == "g" else f"(?({group})\\{group})"

    def property(self, kind: str) -> str:
        m = self.take(r"\{(?:(\w+)=)?(\w+)\}")
        if not m:
            self.fail("invalid property name")
        key, value = m.groups()
        if key in ("Script", "sc", "Script_Extensions", "scx"):
            if self.form == LINEAR:
                return f"\\{kind}{{{value}}}"
            return f"\\{kind}{{IsScript={value}}}".replace("IsScript=", "script=")
        if key not in (None, "General_Category", "gc"):
            self.fail("invalid property name")
        if value == "Any" and key is None:
            return "\\x00-\\x{10FFFF}" if kind == "p" else "[^\\x00-\\x{10FFFF}]"
        if self.form == LINEAR and (value == "ASCII" or value in BINARY or CATEGORIES.get(value, value) == "LC"):
            raise Unsupported(f"property {value}")
        if value == "ASCII" and key is None:
            return f"\\{kind}{{ASCII}}"
        if value in CATEGORIES or value in SHORT:
            return f"\\{kind}{{{CATEGORIES.get(value, value)}}}"
        if key is None and value in BINARY:
            return f"\\{kind}{{Is{value}}}"
        return self.fail("invalid property name")

    def char_class(self) -> str:
        negated = bool(self.take(r"\^"))
        if self.take(r"\]"):
            return "[\\x00-\\x{10FFFF}]" if negated else "[^\\x00-\\x{10FFFF}]" if self.form == LINEAR else "(?!)"
        body = []
        while True:
            if self.i >= len(self.p):
                self.fail("missing ]")
            c = self.p[self.i]
            self.i += 1
            if c == "]":
                return f"[{'^' if negated else ''}{''.join(body)}]"
            # characters that mean more to Java inside a class than to ECMAScript
            body.append(self.escape(True) if c == "\\" else f"\\{c}" if c in "[&^" else c)

    def quantifier(self, after: str) -> None:
        m = self.take(r"([*+?]|\{\d+(?:,\d*)?\})(\??)")
        if not m:
            if self.at("{") and self.unicode:
                self.fail("nothing to repeat")
            return
        if after == "none" or (after == "look" and self.unicode) or after == "behind":
            self.fail("nothing to repeat")
        bounds = re.fullmatch(r"\{(\d+),(\d+)\}", m[1])
        if bounds and int(bounds[1]) > int(bounds[2]):
            self.fail("numbers out of order")
        repeat = m[1]
        counts = [int(x) for x in re.findall(r"\d+", repeat)] or [1 if repeat == "+" else 0]
        high = 1 if repeat == "?" else counts[-1] if repeat[0] == "{" and not repeat.endswith(",}") else None
        if self.form == LINEAR and max(counts) > MOST_REPEATS:
            raise Unsupported("many repeats")
        self.ways *= 1 if high is None else high - counts[0] + 1
        self.tame &= after == "atom" and self.ways <= MOST_WAYS and max(counts) <= MOST_WAYS and not (high is None and self.open)
        self.open_end = high is None
        if self.form == NATIVE and "behind" in self.open:
            low = {"*": 0, "+": 1}.get(repeat)
            low = int(repeat[1:-2]) if repeat.endswith(",}") else low
            repeat = repeat if low is None else f"{{{low},{max(LOOKBEHIND, low)}}}"
        self.out.append(repeat + m[2])
        if self.take(r"(?=[*+?]|\{\d+(?:,\d*)?\})"):
            self.fail("nothing to repeat")

    def run(self) -> str:
        if len(set(self.names)) < len(self.names):
            self.fail("duplicate group name")
        if self.lines and self.form == LINEAR and re.search(r"[\^$]", self.p):
            raise Unsupported("anchors of lines")
        any_char, end = ("(?s:.)" if self.dot_all else f"[^{_ENDS}]"), (f"(?=[{_ENDS}]|\\z)" if self.lines else "\\z")
        start = f"(?:\\A|(?<=[{_ENDS}]))" if self.lines else "\\A"
        self.quantifier("none")
        while self.i < len(self.p):
            c, kind = self.p[self.i], "atom"
            self.i += 1
            self.tame &= not self.open_end or (c == "|" and not self.open)  # nothing is tried again after an open end
            self.open_end = False
            if c == "(":
                m = self.take(r"\?(?:(:)|(=|!)|(<=|<!)|<([A-Za-z_$][\w$]*)>)")
                if not m and self.at("?"):
                    self.fail("invalid group")
                if m and (m[2] or m[3]) and self.form == LINEAR:
                    raise Unsupported("look-around")
                self.open.append("behind" if m and m[3] else "look" if m and m[2] else "group")
                self.out.append("(" if not m else f"(?{'P' if self.form == LINEAR else ''}<g{self.names.index(m[4])}>" if m[4] else f"(?{m[1] or m[2] or m[3]}")
                self.quantifier("none")
                continue
            if c == ")":
                if not self.open:
                    self.fail("unmatched )")
                kind = self.open.pop()
                self.out.append(")")
            elif c == "|":
                self.out.append("|")
                kind = "none"
            elif c == "\\":
                boundary = self.p[self.i : self.i + 1] in ("b", "B")
                self.out.append(self.escape(False))
                kind = "none" if boundary else "atom"
            elif c == "[":
                self.out.append(self.char_class())
            elif c in "^$":
                self.out.append(start if c == "^" else end)
                kind = "none"
            elif c == ".":
                self.out.append(any_char)
            elif c in "{}]":
                if self.unicode:
                    self.fail("lone quantifier bracket")
                self.out.append(f"\\{c}")
            else:
                self.out.append(c)
            self.quantifier(kind)
        if self.open:
            self.fail("unterminated group")
        return "".join(self.out)


def java_pattern(pattern: str, flags: str = "") -> str:
    """The Java pattern that means what this ECMAScript pattern does; ValueError where ECMAScript takes none."""
    out = _Reader(pattern, flags).run()
    return f"(?iu){out}" if "i" in flags else out


def linear_pattern(pattern: str, flags: str = "") -> str:
    """The same for RE2; Unsupported where it has no counterpart."""
    out = _Reader(pattern, flags, LINEAR).run()
    return f"(?i){out}" if "i" in flags else out


def timed_pattern(pattern: str, flags: str = "") -> str:
    """The same for the matcher with a limit of time, which writes code points otherwise."""
    out = _Reader(pattern, flags, TIMED).run()
    out = re.sub(r"\\(?:x\{([0-9A-Fa-f]+)\}|.)", lambda m: f"\\U{int(m[1], 16):08X}" if m[1] else "\\Z" if m[0] == "\\z" else m[0], out, flags=re.S)
    return f"(?i){out}" if "i" in flags else out


def is_tame(pattern: str, flags: str = "") -> bool:
    """Java matches it in time linear in the text: repeats are of single characters, those without a bound come last
    in an alternative of the whole, and those with one can be tried in MOST_WAYS ways at most."""
    reader = _Reader(pattern, flags)
    try:
        reader.run()
    except Unsupported:
        return False
    return reader.tame
