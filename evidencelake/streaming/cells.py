"""Running totals of cells that follow revisions: arbitrary state with timeouts.

State is kept for each cell and bucket of response ids, so that a cell that holds a third of all responses is not one
task's work; totals_of() adds the buckets up. A response counts once, with its latest version. A row is late if it is
older than the newest that its cell and bucket had seen in earlier batches, less the delay; late rows change no total
and are counted apart. Versions older than that can no longer be replaced, so they are dropped with the next rows or, where
none come, by a timeout, and state stays within what the delay spans.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a cell and bucket adds up; newest: microseconds of its latest row.
TOTALS = ["responses", "incomplete", "tokens", "received", "late", "newest"]
STATE = ", ".join([f"{c} long" for c in TOTALS] + ["labels binary", "versions binary"])


def _packed(x: dict) -> bytes:
    return zlib.compress(json.dumps(x).encode(), 1)


def _unpacked(x: bytes) -> dict:
    return json.loads(zlib.decompress(x))


class CellState:
    """Totals, counts by label, and the latest version [at, incomplete, tokens, label] of each response that may still change."""

    def __init__(self, state: tuple | None = None):
        self.totals = dict(zip(TOTALS, map(int, state[: len(TOTALS)]), strict=True)) if state else dict.fromkeys(TOTALS, 0)
        self.labels, self.versions = (_unpacked(bytes(x)) for x in state[len(TOTALS) :]) if state else ({}, {})

    def stored(self) -> tuple:
        return (*(self.totals[c] for c in TOTALS), _packed(self.labels), _packed(self.versions))

    def bound(self, delay: int) -> int | None:
        """Rows before this are late."""
        return self.totals["newest"] - delay if self.totals["newest"] else None

    def take(self, rows: pd.DataFrame, bound: int | None) -> None:
        """Rows (response_id, at in microseconds, incomplete, new_tokens, label), in any order."""
        t = self.totals
        t["received"] += len(rows)
        late = rows["at"] < bound if bound is not None else pd.Series(False, rows.index)
        t["late"] += int(late.sum())
        rows = rows[~late]
        if len(rows):
            t["newest"] = max(t["newest"], int(rows["at"].max()))
        for response, *new in zip(rows["response_id"], rows["at"].tolist(), rows["incomplete"].fillna(False).astype(bool).tolist(), rows["new_tokens"].fillna(0).astype("int64").tolist(), rows["label"].fillna("").tolist(), strict=True):
            old = self.versions.get(response)
            if old is not None and old >= new:
                continue
            self.versions[response] = new
            for version, sign in ((old, -1), (new, 1)):
                if version is not None:
                    t["responses"] += sign
                    t["incomplete"] += sign * version[1]
                    t["tokens"] += sign * version[2]
                    self.labels[version[3]] = self.labels.get(version[3], 0) + sign

    def settle(self, delay: int) -> None:
        """Drops versions that nothing can replace any more."""
        bound = self.bound(delay)
        if bound is not None:
            self.versions = {k: v for k, v in self.versions.items() if v[0] >= bound}

    def row(self, key: tuple, names: list[str]) -> pd.DataFrame:
        out = dict(zip(names, key, strict=True)) | {c: self.totals[c] for c in TOTALS[:-1]}
        return pd.DataFrame([out | {"labels": json.dumps({k: n for k, n in self.labels.items() if n})}])


def cell_updates(results: DataFrame, cell: list[str], response_id: str = "response_id", at: str = "at", label: str | None = None, delay: float = 3600, keep: float | None = None, buckets: int = 16) -> DataFrame:
    """cell, bucket, responses, incomplete, tokens, received, late, labels (JSON): the totals of what a batch touched (update mode).

    results: a stream with these columns, incomplete and new_tokens; rows without response_id or time are left out.
    delay: seconds of event time; keep: seconds of processing time after which a timeout looks a quiet cell's versions
    through (None: its next rows do). A stream with timeouts never runs out of batches, so runs over what is there now
    take none.
    """
    names, slack = [*cell, "bucket"], round(delay * 1_000_000)
    bucket = F.pmod(F.xxhash64(response_id), F.lit(buckets)).cast("int").alias("bucket")
    rows = results.where(F.col(response_id).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(*cell, bucket, F.col(response_id).cast("string").alias("response_id"), F.unix_micros(at).alias("at"), "incomplete", F.col("new_tokens").cast("long").alias("new_tokens"), (F.col(label).cast("string") if label else F.lit("")).alias("label"))
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = CellState(state.get if state.exists else None)
        if not state.hasTimedOut:
            bound = held.bound(slack)  # as it was before this batch, so that the order within a batch is nothing
            for part in batches:
                held.take(part, bound)
            if keep is not None:
                state.setTimeoutDuration(max(1, round(keep * 1000)))
        held.settle(slack)
        state.update(held.stored())
        yield held.row(key, names)

    out = ", ".join([*kinds, *(f"{c} long" for c in TOTALS[:-1]), "labels string"])
    return rows.groupBy(*names).applyInPandasWithState(run, out, STATE, "update", GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.ProcessingTimeTimeout)


def totals_of(updates: DataFrame, cell: list[str]) -> DataFrame:
    """cell, responses, incomplete, tokens, received, late, labels from the last row of each cell and bucket.

    updates: cell_updates() rows with the batch that wrote them.
    """
    last = updates.groupBy(*cell, "bucket").agg(F.max_by(F.struct(*TOTALS[:-1], "labels"), "batch").alias("t"))
    sums = last.groupBy(*cell).agg(*(F.sum(f"t.{c}").alias(c) for c in TOTALS[:-1]))
    each = last.select(*cell, F.explode(F.from_json("t.labels", "map<string, bigint>")).alias("label", "n")).groupBy(*cell, "label").agg(F.sum("n").alias("n"))
    each = each.groupBy(*cell).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("labels"))  # a cell's labels, of which there are few
    same: list[Column] = [sums[c].eqNullSafe(each[c]) for c in cell]
    return sums.join(each.hint("merge"), same, "left").select(*(sums[c] for c in cell), *TOTALS[:-1], F.coalesce("labels", F.create_map().cast("map<string,bigint>")).alias("labels"))
