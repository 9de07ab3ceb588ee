"""Quality classifier (operator 5): a weak-label model and a hashed linear scorer.

One pass over the texts writes, per document, the votes of the heuristic labellers (good, bad or nothing)
and the counts of its hashed features (words and their last two characters). The votes of all documents are
counted by pattern (at most 3 to the power of the labellers), and expectation-maximisation over these counts
estimates the share of good documents and, per labeller, how often it votes right on good and on bad
documents. The posterior of a document's pattern is its weak label. A logistic regression over the features
learns from the posteriors of a sample of about `train_rows` documents, each as a good and a bad example
weighted by the posterior, and scores every document from the written counts.

Edge cases: null text is empty and votes bad on length; repeated rows have one posterior and one score; ties
at 0.5 are kept; a text without words scores by the intercept alone; an empty table gives an empty result, and
one whose posteriors agree on one class scores every document by its posterior.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Rolling, Scratch, chunks, mix
from .quality_rules import SYMBOLS

FEATURES = 1 << 16
LABELLERS = ("symbols", "upper", "stutter", "ends", "marks", "letterless", "variety", "length")
SPACE, UPPER, LETTER, SYMBOL, MARK, END = (1 << i for i in range(6))
_CODE = Rolling(0x9E3779B97F4A7C15)


@functools.cache
def traits() -> np.ndarray:
    """Flags of every code point: white space, capital letter, letter, symbol, mark, end of a sentence."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = LETTER | (UPPER if kind == "Lu" else 0)
    for flag, chars in ((SPACE, WHITE), (SYMBOL, SYMBOLS), (MARK, "!?#*$%&"), (END, ".!?")):
        out[[ord(c) for c in chars]] |= flag
    return out


class Measured:
    """The words of a chunk of texts, their hashes, and the counts that labellers look at."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) + 1 for t in texts])
        codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)  # a space ends each text
        flags = traits()[codes]
        solid = (flags & SPACE) == 0
        edges = np.flatnonzero(np.diff(np.r_[False, solid].view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        begins = np.r_[0, np.cumsum(sizes)]
        self.rows = np.searchsorted(starts, begins)  # first word of every text
        self.n = np.diff(self.rows)
        self.row = np.repeat(np.arange(len(texts)), self.n)
        whole = mix(_CODE.spans(_CODE.prefix(mix(codes.astype(np.uint64))), starts, ends))
        two = np.maximum(ends - 2, starts)
        ending = mix(codes[ends - 1].astype(np.uint64) << np.uint64(32) | np.where(two < ends - 1, codes[two], 0).astype(np.uint64), 5)
        self.words, self.features = whole, np.r_[whole, ending] >> np.uint64(48)
        per_text = lambda flag: self.total((flags & flag) > 0, begins)
        self.symbols, self.upper = per_text(SYMBOL), per_text(UPPER)
        self.chars = sizes - per_text(SPACE)
        last = flags[ends - 1]
        letters = np.r_[0, np.cumsum((flags & LETTER) > 0)]
        again = np.r_[False, (whole[1:] == whole[:-1]) & (self.row[1:] == self.row[:-1])] if len(whole) else np.zeros(0, bool)
        self.stutter = self.total(again, self.rows)
        self.ended = self.total((last & END) > 0, self.rows)
        self.marks = self.total((ends - starts > 1) & ((last & flags[two] & MARK) > 0), self.rows)
        self.letterless = self.total(letters[ends] == letters[starts], self.rows)
        order = np.lexsort((whole, self.row))
        new = np.r_[True, (whole[order][1:] != whole[order][:-1]) | (self.row[order][1:] != self.row[order][:-1])] if len(whole) else np.zeros(0, bool)
        self.distinct = self.total(new, self.rows)

    @staticmethod
    def total(each: np.ndarray, edges: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(each)]
        return sums[edges[1:]] - sums[edges[:-1]]

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first entry of every text, one more at the end; feature; how often it occurs)."""
        key, count = np.unique(np.r_[self.row, self.row].astype(np.uint64) << np.uint64(16) | self.features, return_counts=True)
        return np.searchsorted(key, np.arange(len(self.n) + 1).astype(np.uint64) << np.uint64(16)), (key & np.uint64(FEATURES - 1)).astype(np.int32), count.astype(np.int32)


def votes(m: Measured) -> np.ndarray:
    """-1 (bad), 1 (good) or 0 of every text and labeller; each looks at a trait of its own, and bad wins."""
    n = np.maximum(m.n, 1)
    upper = m.upper / np.maximum(m.chars, 1)
    symbols, stutter, ended, marks, odd, distinct = (x / n for x in (m.symbols, m.stutter, m.ended, m.marks, m.letterless, m.distinct))
    tests = {
        "symbols": (symbols > 0.3, symbols < 0.05),
        "upper": (upper > 0.4, upper < 0.15),
        "stutter": (stutter > 0.15, stutter < 0.03),
        "ends": ((m.n > 20) & (ended < 0.01), (ended > 0.02) & (ended < 0.4)),
        "marks": (marks > 0.2, marks < 0.02),
        "letterless": (odd > 0.25, odd < 0.1),
        "variety": ((m.n > 30) & (distinct < 0.2), distinct > 0.3),
        "length": (m.n < 5, m.n >= 30),
    }
    return np.stack([np.where(tests[k][0], -1, np.where(tests[k][1], 1, 0)) for k in LABELLERS], axis=1)


PLACES = 3 ** np.arange(len(LABELLERS))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pattern, features, counts): the votes as the digits of a number to base 3, and the hashed features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                m = Measured(chunk.column("text").to_pylist())
                edges, feature, count = m.counts()
                pattern = ((votes(m) + 1) @ PLACES).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x)) for x in (feature, count)]
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(pattern), *lists], names=["doc_id", "pattern", "features", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, pattern int, features array<int>, counts array<int>")


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior of good, P(vote good | good), P(vote bad | bad)) by EM over vote patterns and their counts.

    A missing vote says nothing. The first posteriors are the share of good votes.
    """
    good, bad, weight = votes > 0, votes < 0, counts.astype(float)
    p = (good.sum(1) + 1) / (good.sum(1) + bad.sum(1) + 2)
    prior, right_good, right_bad = 0.5, None, None
    for _ in range(rounds):
        a, b = weight * p, weight * (1 - p)
        prior = (a.sum() + 1) / (weight.sum() + 2)
        right_good = (a @ good + 2) / (a @ (good | bad) + 3)
        right_bad = (b @ bad + 2) / (b @ (good | bad) + 3)
        before, p = p, posterior(votes, prior, right_good, right_bad)
        if np.abs(p - before).max() < 1e-9:
            break
    return prior, right_good, right_bad


def posterior(votes: np.ndarray, prior: float, right_good: np.ndarray, right_bad: np.ndarray) -> np.ndarray:
    good, bad = votes > 0, votes < 0
    a = np.log(prior) + good @ np.log(right_good) + bad @ np.log(1 - right_good)
    b = np.log(1 - prior) + good @ np.log(1 - right_bad) + bad @ np.log(right_bad)
    return 1 / (1 + np.exp(np.clip(b - a, -50, 50)))


def examples(sample: DataFrame, known: np.ndarray) -> DataFrame:
    """(x, label, weight): each document of the bounded sample as a good and a bad example; x has length one."""

    def vector(features: list[int], counts: list[int]) -> SparseVector:
        values = np.array(counts, float)
        return SparseVector(FEATURES, features, values / max(np.sqrt((values**2).sum()), 1e-300))

    weak = F.udf(lambda i: float(known[i]), "double")("pattern")
    rows = sample.select(F.udf(vector, VectorUDT())("features", "counts").alias("x"), weak.alias("p"))
    return rows.select("x", F.lit(1.0).alias("label"), F.col("p").alias("weight")).union(rows.select("x", F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))


def scored(rows: DataFrame, known: np.ndarray, weights: np.ndarray | None, intercept: float) -> DataFrame:
    """(doc_id, posterior, score, kept) of described(); without weights the score is the posterior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score = known[batch.column("pattern").to_numpy()]
            if weights is not None:
                features, counts = batch.column("features"), batch.column("counts").flatten().to_numpy().astype(float)
                edges = np.r_[0, np.cumsum(features.value_lengths().to_numpy(zero_copy_only=False))]
                dot = Measured.total(weights[features.flatten().to_numpy()] * counts, edges)
                norm = np.sqrt(Measured.total(counts**2, edges))
                score = 1 / (1 + np.exp(-np.clip(dot / np.maximum(norm, 1e-300) + intercept, -50, 50)))
            score = np.round(score, 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(p, 6)), pa.array(score), pa.array(score >= 0.5)], names=["doc_id", "posterior", "score", "kept"])

    return rows.mapInArrow(run, "doc_id long, posterior double, score double, kept boolean")


def quality_classifier(docs: DataFrame, train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, posterior (of the weak labels), score and kept (score 0.5 or more).

    train_rows bounds the expected size of the sample that the scorer is fitted on.
    """
    scratch = Scratch(docs.sparkSession, "classifier")
    rows = scratch.table(described(docs, id_col, text_col), "described")
    patterns = rows.groupBy("pattern").count().collect()  # at most 3 ** len(LABELLERS) rows
    known = np.full(3 ** len(LABELLERS), 0.5)
    if not patterns:
        return scored(rows, known, None, 0.0)
    code, count = (np.array([r[k] for r in patterns]) for k in ("pattern", "count"))
    table = code[:, None] // PLACES % 3 - 1
    known[code] = posterior(table, *fit_label_model(table, count))
    total = int(count.sum())
    if not 0.001 < float(known[code] @ count) / total < 0.999:
        return scored(rows, known, None, 0.0)
    sample = scratch.table(rows.select("pattern", "features", "counts").sample(min(1.0, train_rows / total), seed=11), "sample")
    if not sample.limit(1).count():
        return scored(rows, known, None, 0.0)
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=40, regParam=1e-4, standardization=False).fit(scratch.table(examples(sample, known), "examples"))
    return scored(rows, known, model.coefficients.toArray(), model.intercept)
