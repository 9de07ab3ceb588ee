"""Periodic run detection (operator 11): string synchronising sets over words.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Periods up to 2 are
read off directly. For longer ones, at each scale t = 2, 4, 8, ... positions are selected by hash: j counts by the hash of
its t words, unless these have a period of t / 3 or less, and i is selected if the least hash among i, ..., i + t stands
at i or at i + t. Whether i is selected depends on its 2t words alone, so a run's selected positions repeat with
its period; and every stretch of 3t - 1 words without so small a period holds one. Selected positions with equal
contexts of 2t words at a distance from (3t - 1) / 2 to 3t - 1 propose that distance as a period; these ranges join up
without a gap. The regions that were left out as highly periodic at a scale are just the runs of length 3q or more of smaller
scales, found before it, whose periods need no proposal. Each proposal is extended to both sides by comparing words, so a
false one costs time only; what is found twice, or again with a multiple of its period, is one region and counts once
with the least period.

A document is one row of work; its arrays are a few 64-bit numbers a word. Nothing is shuffled.

Edge cases: null, empty and blank texts have no words and no run; repeated rows give equal rows; a null doc_id is
carried through; an empty table gives an empty result. The result keeps the doc_id and, if asked, the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import JoinedWords, chunks, mix

#: What a run must reach: this many words, and this many times its period. CERTAIN: what detection itself needs.
LEAST_WORDS, LEAST_TIMES, CERTAIN = 6, 4, 3
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of `width` values: two sweeps over blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, _MOST)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Regions:
    """Stretches [start, end) with a period, of length CERTAIN times the period or more, each once."""

    def __init__(self) -> None:
        self.start, self.end, self.period = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        keep = end - start >= CERTAIN * period
        both = [np.concatenate(x) for x in ((self.start, start[keep]), (self.end, end[keep]), (self.period, period[keep]))]
        order = np.lexsort((both[2], both[1], both[0]))
        s, e, p = (x[order] for x in both)
        first = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])][: len(s)]  # of equal stretches the least period
        self.start, self.end, self.period = s[first], e[first], p[first]


def extended(codes: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The longest [start, end) within [low, high) around at and at + period in which words `period` apart are equal."""
    end, step = at, 64
    while end + period < high:
        stop = min(end + step, high - period)
        off = codes[end:stop] != codes[end + period : stop + period]
        if off.any():
            end += int(off.argmax())
            break
        end, step = stop, min(4 * step, 1 << 16)
    start, step = at, 64
    while start > low:
        begin = max(start - step, low)
        off = codes[begin:start] != codes[begin + period : start + period]
        if off.any():
            start -= int(off[::-1].argmax())
            break
        start, step = begin, min(4 * step, 1 << 16)
    return start, end + period


def short_periods(codes: np.ndarray, row: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches in which words `period` apart are equal."""
    same = (codes[period:] == codes[:-period]) & (row[period:] == row[:-period])
    edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2] + period
    return start, end, np.full(len(start), period)


def selected(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, scale: int) -> np.ndarray:
    """The synchronising positions: hashes of `scale` words are those of each position, starts and ends the highly periodic regions."""
    ids = hashes.copy()
    if len(starts):
        inside = np.zeros(len(ids) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, np.minimum(np.maximum(ends - scale + 1, starts), len(ids)), -1)
        ids[np.cumsum(inside)[:-1] > 0] = _MOST
    least = window_minima(ids, scale + 1)
    n = len(least)
    return np.flatnonzero((least != _MOST) & ((least == ids[:n]) | (least == ids[scale : scale + n])))


def regions(codes: np.ndarray, rows: np.ndarray) -> Regions:
    """Every maximal stretch of length CERTAIN times its smallest period or more; rows: where each text's words begin."""
    found, n = Regions(), np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    for period in (1, 2):
        if len(codes) > period:
            found.add(*short_periods(codes, row, period))
    hashes, size, scale = mix(codes.astype(np.uint64), 30), 1, 2
    while len(n) and int(n.max()) >= CERTAIN * ((3 * scale - 1) // 2):
        while size < scale:
            hashes = mix(mix(hashes[: len(hashes) - size], 31) ^ hashes[size:], 32)
            size *= 2
        contexts = mix(mix(hashes[: len(hashes) - scale], 31) ^ hashes[scale:], 32)
        highly = (3 * found.period <= scale) & (found.end - found.start >= scale)
        at = selected(hashes, found.start[highly], found.end[highly], scale)
        at = at[rows[1:][row[at]] - at >= 2 * scale]
        at = at[n[row[at]] >= CERTAIN * ((3 * scale - 1) // 2)]
        found.add(*proposed(codes, rows, row, contexts, at, scale))
        scale *= 2
    return found


def proposed(codes: np.ndarray, rows: np.ndarray, row: np.ndarray, contexts: np.ndarray, at: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches that pairs of selected positions with equal contexts propose."""
    order = np.lexsort((at, contexts[at]))
    at = at[order]
    context = contexts[at]
    low, high, pairs, k = (3 * scale) // 2, 3 * scale - 1, [], 1
    live = np.arange(len(at))
    while True:  # the next, the one after, ... while that is near enough; at most nine, as closer ones are highly periodic
        live = live[live + k < len(at)]
        live = live[(context[live] == context[live + k]) & (at[live + k] - at[live] <= high)]
        if not len(live):
            break
        distance = at[live + k] - at[live]
        good = (distance >= low) & (row[at[live]] == row[at[live + k]])
        pairs.append((at[live][good], distance[good]))
        k += 1
    out: list[tuple[int, int, int]] = []
    if pairs:
        where, period = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        order, last = np.lexsort((where, period)), (0, -1, -1)
        for i, p in zip(where[order].tolist(), period[order].tolist(), strict=True):
            if last[2] == p and last[0] <= i and i + p < last[1]:
                continue  # within the stretch that was just extended
            r = row[i]
            last = (*extended(codes, i, p, int(rows[r]), int(rows[r + 1])), p)
            out.append(last)
    start, end, period = np.array(out, np.int64).reshape(-1, 3).T
    return start, end, period


RESULT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string"


def listed(chunk: pa.RecordBatch, least_words: int, least_times: int) -> pa.RecordBatch:
    """RESULT of a chunk(doc_id, text)."""
    words = JoinedWords(chunk.column("text"))
    codes = words.codes()[0]
    rows = words.rows
    found = regions(codes, rows)
    length = found.end - found.start
    good = (length >= least_words) & (length >= least_times * found.period)
    start, period, length = found.start[good], found.period[good], length[good]
    of = np.searchsorted(rows, start, "right") - 1
    gone = np.zeros(len(codes) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    kept = np.cumsum(gone)[:-1] == 0
    data = words.data if kept.all() else words.data[np.repeat(kept, words.size)]
    ends = np.r_[0, np.cumsum(np.where(kept, words.size, 0))][rows]
    view, out = memoryview(np.ascontiguousarray(data)), []
    cuts = np.searchsorted(of, np.arange(len(rows)))
    best = [None] * 4
    for i in range(len(chunk)):
        a, b = int(cuts[i]), int(cuts[i + 1])
        runs = [(s - int(rows[i]), n, p) for s, n, p in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)]
        runs.sort(key=lambda x: (x[0], x[2]))
        top = best
        for s, n, p in runs:  # first of the greatest length / period, compared exactly
            if top[0] is None or n * top[2] > top[1] * p:
                top = [s, n, p, 1000 * n // p]
        collapsed = bytes(view[int(ends[i]) : max(int(ends[i + 1]) - 1, int(ends[i]))]).decode()
        out.append((int(rows[i + 1] - rows[i]), len(runs), *top, "".join(f"{s},{n},{p}\n" for s, n, p in runs), collapsed))
    columns = list(zip(*out, strict=True))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([chunk.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in RESULT.split(", ")])


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row RESULT: the run of greatest length / period (null without one), all runs as lines `start,length,period`,
    and the text without the words that a run repeats, joined by single spaces. least_times: CERTAIN or more."""
    if least_times < CERTAIN:
        raise ValueError(f"runs of fewer than {CERTAIN} periods are not all found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                yield listed(chunk, least_words, least_times)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, RESULT)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): texts whose crc32(doc_id) is divisible by ten repeat a stretch of words to their end."""
    white = r"[\x20\x09-\x0D]+"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.crc32(F.col(id_col).cast("long").cast("string")).alias("h"))
    ws = F.filter(F.split("text", white), lambda w: w != "")

    def repeated(x: Column) -> Column:
        n, g = F.size(x), F.floor(F.col("h") / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(x, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(x, F.lit(1), a), tail), " ")).otherwise("")

    bound = F.transform(F.array(ws), repeated)[0]
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), bound).otherwise(F.col("text")).alias("text"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
