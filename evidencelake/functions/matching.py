"""Matches of user patterns over Arrow batches of texts, within a bound of time whatever the pattern.

LINEAR patterns are run by Arrow's RE2 functions, in time linear in the text; all matches are marked in one pass and
their places read off. RE2 gives no empty match right after another match, where ECMAScript does: whether the pattern
matches the empty text between two characters depends only on which of them are word characters or missing, so the
nine cases are tried once a pattern and the matches put in. TIMED patterns are run by a backtracking matcher that
gives a text up after MATCH_SECONDS; the text then has an error instead of a match, and the job goes on.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .jsregex import LINEAR, TIMED

#: Seconds that one pattern may take on one text, and the error of a text that took longer.
MATCH_SECONDS, TIMED_OUT = 0.2, "Pattern timed out"
#: Characters that stand around a match; Unicode reserves both for no character. Those in a text count as a third.
BEGIN, END, OTHER = "﷐", "﷑", "﷒"
#: Bytes of text that are marked at once.
SLICE_BYTES = 4 << 20

FOUND = "array<struct<matched: boolean, positions: array<int>, error: string>>"
FOUND_TYPE = pa.struct([("matched", pa.bool_()), ("positions", pa.list_(pa.int32())), ("error", pa.string())])


@dataclass(frozen=True)
class Compiled:
    form: str
    pattern: str


def compiles(form: str, pattern: str) -> str | None:
    """Why the pattern of this form does not compile, None if it does."""
    try:
        if form == LINEAR:
            pc.match_substring_regex(pa.array([""]), pattern)
        elif form == TIMED:
            regex.compile(pattern)
    except (pa.ArrowInvalid, regex.error) as e:
        return str(e)
    return None


_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _side(c: str) -> str:
    return "" if not c else "a" if c in _WORD else "-"


def empty_matches(pattern: str) -> set[tuple[str, str]]:
    """The pairs of neighbours (word character "a", other "-", none "") between which the pattern matches the empty text."""
    out = set()
    for before in ("", "a", "-"):
        for after in ("", "a", "-"):
            around = rf"\A{'(?s:.)' if before else ''}(?:{pattern}){'(?s:.)' if after else ''}\z"
            if pc.match_substring_regex(pa.array([before + after]), around)[0].as_py():
                out.add((before, after))
    return out


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of at most SLICE_BYTES of text, or one text."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def marked_positions(marked: str, empty: set[tuple[str, str]]) -> list[int]:
    """Where the matches begin that stand between BEGIN and END; empty ones after another match are put in."""
    first, *parts = marked.split(BEGIN)
    at, out = len(first), []
    for k, part in enumerate(parts):
        match, _, rest = part.partition(END)
        out.append(at)
        at += len(match)
        if match and empty and (rest or k == len(parts) - 1) and (_side(match[-1]), _side(rest[:1])) in empty:
            out.append(at)
        at += len(rest)
    return out


def linear_positions(texts: pa.Array, pattern: str) -> list[list[int]]:
    """All matches in each text, as code-point offsets."""
    empty, out = empty_matches(pattern), []
    for part in slices(texts):
        for mark in (BEGIN, END):
            part = pc.replace_substring(part, mark, OTHER)
        for s in pc.replace_substring_regex(part, f"({pattern})", f"{BEGIN}\\1{END}").to_pylist():
            out.append(marked_positions(s, empty) if s and BEGIN in s else [])
    return out


def timed_positions(compiled: regex.Pattern, text: str, seconds: float) -> list[int]:
    """All matches, as code-point offsets; after an empty match the search goes on one character later."""
    out, at, until = [], 0, time.monotonic() + seconds
    while at <= len(text):
        left = until - time.monotonic()
        if left <= 0:
            raise TimeoutError
        m = compiled.search(text, at, timeout=left)
        if not m:
            break
        out.append(m.start())
        at = m.end() + (m.end() == m.start())
    return out


def found(texts: pa.Array, patterns: list[Compiled], places: bool, seconds: float = MATCH_SECONDS) -> pa.Array:
    """Per text a FOUND list, an entry a pattern; places: with all positions."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    columns = []
    for p in patterns:
        error = [None] * len(texts)
        if p.form == LINEAR:
            where = linear_positions(texts, p.pattern) if places else None
            hit = [bool(x) for x in where] if places else pc.match_substring_regex(texts, p.pattern).to_pylist()
        else:
            compiled, where, hit = regex.compile(p.pattern), [], []
            for i, text in enumerate(texts.to_pylist()):
                try:
                    at = timed_positions(compiled, text, seconds) if places else [0] * bool(compiled.search(text, timeout=seconds))
                except (TimeoutError, MemoryError):
                    at, error[i] = [], TIMED_OUT
                where.append(at)
                hit.append(bool(at))
        where = where if places else [[]] * len(texts)
        columns.append(pa.StructArray.from_arrays([pa.array(hit, pa.bool_()), pa.array(where, pa.list_(pa.int32())), pa.array(error, pa.string())], fields=list(FOUND_TYPE)))
    n = len(patterns)
    # entries come pattern by pattern; a text's entries are gathered side by side
    every = pa.concat_arrays(columns).take(pa.array(np.arange(n * len(texts)).reshape(n, -1).T.reshape(-1)))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(texts) + 1, n, dtype=np.int32)), every)
