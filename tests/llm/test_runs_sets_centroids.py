"""Operators 11 to 13 against plain versions: periodic runs, MinHash groups, centroid clustering."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import minhash_dedup as minhash
from evidencelake.llm.centroid_clustering import assigned, centroid_clustering, farthest, integer_vectors, nearest, pivot_table, to_pivots
from evidencelake.llm.minhash_dedup import minhash_dedup, shingle_sets, signatures
from evidencelake.llm.periodic_runs import digest, periodic_runs, regions, with_planted_runs
from evidencelake.llm.queries import QUERIES
from evidencelake.llm.sql import SQL

from . import brute
from .test_operators import CLASHING, DOCS, docs, empty, same  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_minhash_dedup", "op13_centroid_clustering"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = QUERIES[name](spark, FOLDER).toArrow(), con.sql(SQL[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    plain = lambda t: Counter(tuple(r[c] for c in cols) for r in t.to_pylist())
    assert plain(got) == plain(want)


# periodic runs


def plain_runs(words, times):
    """{(start, end): least period} of every stretch of `times` periods or more."""
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= times * q:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return out


def random_word(r, n):
    """Words with much repetition: random letters, powers of blocks, powers of powers."""
    k, out = r.choice([1, 2, 2, 3, 5]), []
    while len(out) < n:
        block = [r.randrange(k) for _ in range(r.randint(1, r.choice([3, 8, 40])))]
        kind = r.random()
        if kind < 0.4:
            out += block * r.randint(1, 7) + block[: r.randint(0, len(block))]
        elif kind < 0.8:
            out += (block[:5] * r.randint(1, 6) + block[:2]) * r.randint(1, 6)
        else:
            out += [r.randrange(k) for _ in range(n)]
    return out[:n]


@pytest.mark.parametrize("seed", range(3))
def test_regions_are_all_runs_of_three_periods(seed):
    r = random.Random(seed)
    for _ in range(300):
        texts = [random_word(r, r.choice([0, 1, 2, 5, 12, 30, 80, 200])) for _ in range(r.randint(1, 4))]
        rows = np.cumsum([0, *map(len, texts)])
        found = regions(np.array([x for t in texts for x in t], np.int32), rows)
        got = {(int(s), int(e)): int(p) for s, e, p in zip(found.start, found.end, found.period, strict=True)}
        assert got == {(s + int(at), e + int(at)): q for t, at in zip(texts, rows, strict=False) for (s, e), q in plain_runs(t, 3).items()}


def test_long_periods_and_words_made_to_collide():
    r = random.Random(9)
    block = [r.randrange(1000) for _ in range(1300)]
    thue = [i.bit_count() % 2 for i in range(4096)]
    for text in (block * 3 + block[:7], [1, 2] + block * 5, thue * 3, thue + [2] + thue + [2] + thue + [2] + thue, [0] * 3000 + [1] + [0] * 3000):
        found = regions(np.array(text, np.int32), np.array([0, len(text)]))
        got = {(int(s), int(e)): int(p) for s, e, p in zip(found.start, found.end, found.period, strict=True)}
        for (s, e), p in got.items():
            assert text[s : e - p] == text[s + p : e] and e - s >= 3 * p
            assert (s == 0 or text[s - 1] != text[s - 1 + p]) and (e == len(text) or text[e] != text[e - p])
        if text[:2] == [1, 2]:
            assert got[2, 2 + 5 * 1300] == 1300
        if text == thue * 3:
            assert got[0, 3 * 4096] == 4096


def plain_result(i, text, planted):
    ws = brute.words(text)
    n, h = len(ws), zlib.crc32(str(i).encode())
    if planted and i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[k if k < a else a + (k - a) % p] for k in range(n)]
    runs = sorted((s, e - s, q) for (s, e), q in plain_runs(ws, 4).items() if e - s >= 6)
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, brute.sha(lines), brute.sha(" ".join(w for k, w in enumerate(ws) if k not in gone)))


def test_periodic_runs(docs, empty):  # noqa: F811
    short = [(i, t) for i, t in DOCS if len(t or "") < 20_000]
    kept = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 20_000)
    same(digest(periodic_runs(kept)), [plain_result(i, t, False) for i, t in short])
    same(digest(periodic_runs(with_planted_runs(kept))), [plain_result(i, t, True) for i, t in short])
    assert periodic_runs(empty).count() == 0
    assert periodic_runs(with_planted_runs(empty)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, least_times=2)


# MinHash groups


def shingles(text, n):
    ws = brute.words(brute.fold(text))
    return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set())


def plain_groups(rows, n, percent=80):
    sets = [shingles(t, n) for _, t in rows]

    def linked(a):
        return [b for b in range(len(rows)) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]

    roots, least = brute.join(len(rows), linked), {}
    for (i, _), root in zip(rows, roots, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return [(i, len(s), least.get(root), i == least.get(root)) for (i, _), s, root in zip(rows, sets, roots, strict=True)]


def edited(r, words, share):
    return " ".join("x%d" % r.randrange(10**6) if r.random() < share else w for w in words)


def group_rows():
    """Chains of near copies about the threshold, dense groups, copies in other case, and texts alike in part."""
    r = random.Random(3)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice([1, 2, 3, 9, 12, 40, 120, 400]))] for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        chain = list(b)
        for k in range(6):
            chain = edited(r, chain, 0.04).split()
            rows.append((1000 + 10 * i + k, " ".join(chain)))
    dense = [f"d{r.randrange(300)}" for _ in range(100)]
    rows += [(2000 + k, edited(r, dense, 0.02 if k % 3 else 0.07)) for k in range(150)]
    rows += [(3000 + k, rows[5][1].upper()) for k in range(30)] + [(None, rows[7][1]), (None, "  "), (4000, None), (4001, "a"), (4002, "A"), (None, "q r s t u v"), (None, "q r s t u v")]
    return rows


@pytest.mark.parametrize("cell_rows", [2048, 16])
def test_minhash(spark, docs, empty, cell_rows):  # noqa: F811
    rows = group_rows()
    frame = spark.createDataFrame([(*r, *("clash",) * len(CLASHING)) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(6)
    same(minhash_dedup(frame, shingle=2, cell_rows=cell_rows), plain_groups(rows, 2))
    if cell_rows == 2048:
        same(minhash_dedup(docs, shingle=2), plain_groups(DOCS, 2))
        same(minhash_dedup(docs), plain_groups(DOCS, 5))
        assert minhash_dedup(empty).count() == 0
        with pytest.raises(ValueError):
            minhash_dedup(docs, percent=70)


def test_circulant_signatures_estimate_similarity():
    import pyarrow as pa

    r, errors = random.Random(4), []
    for _ in range(40):
        words = [f"w{r.randrange(10**6)}" for _ in range(400)]
        a, b = shingle_sets(pa.array([" ".join(words), edited(r, words, 0.05)]), 2)
        x, y = signatures([a, b])
        errors.append((x == y).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_gate_is_far_below_the_threshold():
    agree = 0.8 + 0.2 / 4
    assert (minhash.COORDINATES * agree - minhash.GATE) / (minhash.COORDINATES * agree * (1 - agree)) ** 0.5 > 6


# centroid clustering


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1]))
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        for n, vs in of.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    final = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, n, d in final:
        inertia[n] += d
    sha = [brute.sha(",".join(map(str, c))) for c in centroids]
    return [(i, n, d, inertia[n], inertia.total(), sha[n]) for i, n, d in final]


def vector_rows():
    r = random.Random(8)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, 0.5]) * (1 + i % 3) for _ in range(64)]) for i in range(160)]  # ties
    rows += [(200 + i, rows[i % 7][1]) for i in range(60)] + [(3, rows[3][1]), (3, rows[9][1]), (None, rows[4][1]), (None, [0.1] * 64)]
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 63 + [None]), (304, [float("nan")] * 64), (305, [float("inf")] + [0.0] * 63), (306, [900.0] * 64), (307, [-0.001] * 64), (308, [0.5] * 65)]
    return rows


def test_centroid_clustering(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, cluster string").repartition(5)
    same(centroid_clustering(frame), plain_clusters(rows))
    same(centroid_clustering(frame, k=7, rounds=2, n_pivots=3), plain_clusters(rows, 7, 2))
    few = [x for x in rows if x[0] in (1, 2, 302)]
    same(centroid_clustering(frame.where("vec_id in (1, 2, 302)")), plain_clusters(few))
    assert centroid_clustering(frame.where("false")).count() == 0
    huge = spark.createDataFrame([(1, [3e38] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in centroid_clustering(huge).collect()] == [2]


def test_bounds_prune_and_never_change_a_result(spark):
    r = np.random.default_rng(2)
    centers = r.integers(-300, 300, (30, 64))
    points = np.repeat(centers, 40, axis=0) + r.integers(-9, 9, (1200, 64))
    pivots = farthest(centers, 12)
    number, distance, n_exact = nearest(points, to_pivots(points, pivots), centers, to_pivots(centers, pivots))
    every = ((points[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert n_exact < every.size / 4
    frame = spark.createDataFrame([(i, [x / 256 for x in p]) for i, p in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    table = pivot_table(integer_vectors(frame, 64, 256), pivots)
    assert [x.cluster for x in assigned(table, centers, pivots).orderBy("vec_id").collect()] == number.tolist()
