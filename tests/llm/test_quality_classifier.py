"""The quality classifier against a plain version: votes word by word, EM by loops, the scorer by gradient descent."""

import math
from collections import Counter

import numpy as np
import regex

from evidencelake.llm import quality_classifier as qc

from . import brute
from .test_operators import DOCS, docs, empty  # noqa: F401


def plain_votes(text):
    ws, text = brute.words(text), text or ""
    n, chars = max(len(ws), 1), max(sum(map(len, brute.words(text))), 1)
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    share = lambda test: sum(map(bool, map(test, ws))) / n
    upper, symbols = len(regex.findall(r"\p{Lu}", text)) / chars, sum(c in "#*$%&|<>" for c in text) / n
    stutter, distinct = sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n, len(set(ws)) / n
    ended, marks, odd = share(lambda w: w[-1] in ".!?"), share(lambda w: len(w) > 1 and set(w[-2:]) <= set("!?#*$%&")), share(lambda w: not regex.search(r"\p{L}", w))
    return (
        vote(symbols > 0.3, symbols < 0.05), vote(upper > 0.4, upper < 0.15), vote(stutter > 0.15, stutter < 0.03), vote(len(ws) > 20 and ended < 0.01, 0.02 < ended < 0.4),
        vote(marks > 0.2, marks < 0.02), vote(odd > 0.25, odd < 0.1), vote(len(ws) > 30 and distinct < 0.2, distinct > 0.3), vote(len(ws) < 5, len(ws) >= 30),
    )


def plain_posteriors(votes):
    k = range(len(votes[0]))
    weak = [(v.count(1) + 1) / (v.count(1) + v.count(-1) + 2) for v in votes]
    for _ in range(100):
        prior = (sum(weak) + 1) / (len(votes) + 2)
        good = [(sum(p for p, v in zip(weak, votes, strict=True) if v[i] == 1) + 2) / (sum(p for p, v in zip(weak, votes, strict=True) if v[i]) + 3) for i in k]
        bad = [(sum(1 - p for p, v in zip(weak, votes, strict=True) if v[i] == -1) + 2) / (sum(1 - p for p, v in zip(weak, votes, strict=True) if v[i]) + 3) for i in k]
        now = []
        for v in votes:
            a = prior * math.prod(good[i] if v[i] == 1 else 1 - good[i] for i in k if v[i])
            b = (1 - prior) * math.prod(bad[i] if v[i] == -1 else 1 - bad[i] for i in k if v[i])
            now.append(a / (a + b))
        weak, before = now, weak
        if max(abs(x - y) for x, y in zip(weak, before, strict=True)) < 1e-9:
            break
    return weak


def plain_scores(texts, weak):
    """Logistic regression on word and ending counts of length one, by accelerated gradient descent."""
    bags = [Counter((kind, w if kind else w[-2:]) for w in brute.words(t) for kind in (0, 1)) for t in texts]
    place = {f: i for i, f in enumerate(sorted({f for b in bags for f in b}))}
    x, p = np.zeros((len(texts), len(place) + 1)), np.array(weak)
    for row, bag in zip(x, bags, strict=True):
        for f, c in bag.items():
            row[place[f]] = c
        row /= max(np.linalg.norm(row), 1e-300)
    x[:, -1] = 1
    reg = np.full(len(place) + 1, 1e-4)
    reg[-1] = 0
    w = v = np.zeros(len(place) + 1)
    for t in range(20_000):
        grad = x.T @ (1 / (1 + np.exp(-x @ v)) - p) / len(p) + reg * v
        w, before = v - 2 * grad, w
        v = w + t / (t + 3) * (w - before)
    return 1 / (1 + np.exp(-x @ w))


def test_against_plain(docs):  # noqa: F811
    votes = [plain_votes(t) for _, t in DOCS]
    measured = qc.votes(qc.Measured([t or "" for _, t in DOCS]))
    assert [tuple(v) for v in measured.tolist()] == votes
    weak = plain_posteriors(votes)
    score = plain_scores([t for _, t in DOCS], weak)
    key = lambda i: (i is not None, i or 0)
    want = sorted(((key(i), p, s) for (i, _), p, s in zip(DOCS, weak, score, strict=True)), key=lambda x: (x[0], round(x[1], 6), x[2]))
    got = sorted(((key(r.doc_id), r.posterior, r.score, r.kept) for r in qc.quality_classifier(docs).collect()), key=lambda x: (x[0], round(x[1], 6), x[2]))
    assert [x[0] for x in got] == [x[0] for x in want]
    assert max(abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)) < 2e-6
    assert max(abs(a[2] - b[2]) for a, b in zip(got, want, strict=True)) < 0.03
    assert all(k == (s >= 0.5) for _, _, s, k in got)


def test_repeated_rows_and_one_class(spark):
    rows = spark.createDataFrame([(i, "clean words in a plain sentence of some length. " * 8) for i in (1, 1, 2)] + [(3, None)], "doc_id long, text string")
    got = qc.quality_classifier(rows).collect()
    assert len({(r.posterior, r.score) for r in got if r.doc_id != 3}) == 1 and len(got) == 4
    same = qc.quality_classifier(rows.where("doc_id < 3")).collect()
    assert all(0 <= r.score <= 1 for r in same)
