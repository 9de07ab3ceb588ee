"""The pipeline stage by stage against plain versions."""

import hashlib
from collections import defaultdict

import corpus_pipeline
import pytest

from . import brute
from .test_operators import CLASHING, DOCS, SCHEMA, encoder


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows = [(i, t, "s", "en", len(t or "")) + ("clash",) * len(CLASHING) for i, t in DOCS]
    docs, out = spark.createDataFrame(rows, SCHEMA), {}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{folder}/{name}-in")
        source = spark.read.parquet(f"{folder}/{name}-in")
        docs = stage(spark, source, str(folder))
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = (source, docs)
    return out


def pairs(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_stages(stages):
    kept = [x for x in DOCS if brute.kept_by_rules(x[1])]
    assert pairs(stages["quality_rules"][1]) == sorted(kept, key=str)
    assert {i for i, _ in kept} >= {None, 8} and len([x for x in kept if x[0] == 8]) == 2

    groups = defaultdict(list)
    for i, t in kept:
        groups[brute.fold(t)].append(i)
    best = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    folded = lambda rows: sorted(((i, brute.fold(t)) for i, t in rows), key=str)
    assert folded(pairs(stages["exact_dedup"][1])) == sorted(((i, t) for t, i in best.items()), key=str)

    kept = pairs(stages["exact_dedup"][1])
    rank = lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).digest())
    components = defaultdict(list)
    for x, root in zip(kept, brute.near_roots([t for _, t in kept]), strict=True):
        components[root].append(x)
    kept = [x for c in components.values() for x in c if rank(x) == min(map(rank, c))]
    assert len(kept) == len(components) and pairs(stages["simhash_dedup"][1]) == sorted(kept, key=str)
    cut = brute.cut_windows(kept, 50)
    kept = [(i, cut[i, t][2] if cut[i, t][1] else t) for i, t in kept]
    assert pairs(stages["substring_dedup"][1]) == sorted(kept, key=str)
    packed = defaultdict(int)
    for r in stages["packing"][1].collect():
        packed[r.doc_id] += r.length
    encode = encoder("byte_bpe_50k").encode_ordinary
    want = defaultdict(int)
    for i, t in kept:
        want[i] += len(encode(t)) + 1
    assert packed == want


def test_rows_without_a_doc_id_of_their_own(spark):
    text = "one text that two rows share under different ids and that is long enough to be told from others"
    rows = [(7, text), (7, "only here, under an id that a copy has too, and nowhere else in all of these rows"), (9, text), (None, text), (None, "a row without any id"), (None, "a row without any id"), (7, "only here, under an id that a copy has too, and nowhere else in all of these rows")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.exact(spark, docs, "")
    assert pairs(kept) == sorted([(9, text), rows[1], (None, "a row without any id")], key=str)
    assert pairs(corpus_pipeline.near(spark, kept, "")) == pairs(kept)
    assert pairs(corpus_pipeline.near(spark, docs.where("doc_id IS NULL OR doc_id = 9"), "")) == sorted([(9, text), rows[4], rows[5]], key=str)


def test_columns_stay(stages):
    for name in ("quality_rules", "exact_dedup", "simhash_dedup", "substring_dedup"):
        assert stages[name][1].columns == stages[name][0].columns


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs.write.mode("overwrite").parquet(f"{tmp_path}/{_}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{_}"), str(tmp_path))
    assert docs.count() == 0
