"""The numbered operators against plain versions, on a table that holds every edge case."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidencelake.llm import bpe, line_dedup, packing, quality_rules, simhash_dedup, suffix_dedup, substring_dedup
from evidencelake.llm.common import Scratch
from evidencelake.llm.components import components
from evidencelake.llm.exact_dedup import exact_dedup
from evidencelake.llm.quality_classifier import fit_label_model, posterior, quality_classifier
from evidencelake.llm.token_counts import TokenRollup, corpus_history, rolled_up

from . import brute

#: Columns whose names operators use inside; they must not get in the way.
CLASHING = ["row", "rest", "ws", "fp", "key", "kept", "anchor", "at", "bucket", "digest", "run", "n_words", "row_hash", "norm", "cut_from", "ids", "length", "rank", "score", "root"]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def sample():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = prose(70), prose(18)
    docs = [(i, prose(r.randint(30, 160))) for i in range(40)]
    docs += [(100 + i, f"{prose(r.randint(5, 40))} {passage} {prose(r.randint(5, 40))}") for i in range(12)]
    docs += [(200 + i, f"{line}\n{prose(25)}\n{line} x{i}\n{prose(30)}") for i in range(6)]
    base = docs[0][1].split(" ")
    for i in range(6):  # near copies
        copy = base[:]
        copy[r.randrange(len(copy))] = "changed"
        docs.append((300 + i, " ".join(copy)))
    docs += [(400 + i, docs[3][1].upper() if i % 2 else docs[3][1]) for i in range(5)]
    docs += [(500, None), (501, ""), (502, " \t\n "), (503, None), (504, "word"), (505, "two words"), (506, "a" * 3000), (507, "ab " * 900), (508, prose(9000)), (509, "\x1c\x85 　x ¡Ñ 漢字 😀 <|endoftext|>")]
    docs += [(510, "SHOUT LOUD " * 30), (511, "x | " * 60), (512, "spam spam spam spam eggs eggs eggs eggs " * 8), (513, "\n".join([line] * 20))]
    docs += [docs[1], docs[1], (7, "another text under a known id " * 12), (None, docs[2][1]), (None, None)]
    docs += [(8, prose(90)), (None, prose(60)), (None, docs[-1][1]), (None, docs[4][1])]
    docs += [docs[-3], (9, docs[6][1])]
    return docs


DOCS = sample()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{(i or 0) % 3}" if i != 5 else None, "en" if (i or 0) % 2 else None, len(t or "")) + ("clash",) * len(CLASHING) for i, t in DOCS]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((v is not None, v) if not isinstance(v, list) else (True, tuple(v)) for v in row)


def same(frame, expected):
    got = sorted(map(key, frame.collect()))
    want = sorted(map(key, expected))
    assert len(got) == len(want)
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]] == []


def test_line_dedup(docs, empty):
    kept = brute.fuzzy_lines(DOCS)
    same(line_dedup.line_dedup(docs).select("doc_id", "kept_text"), [(i, kept[i, t]) for i, t in DOCS])
    assert line_dedup.line_dedup(empty).count() == 0


def test_quality_rules(docs, empty):
    rows = quality_rules.quality_rules(docs, sample_rows=40)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = [(i, *(brute.measures(t)[c] for c in cols[1:-1]), brute.kept_by_rules(t)) for i, t in DOCS]
    same(rows.select(*cols), want)
    assert quality_rules.quality_rules(empty).count() == 0
    filtered = quality_rules.quality_filter(docs, sample_rows=40)
    assert filtered.columns == docs.columns
    same(filtered.select("doc_id", "text", "ws"), [(i, t, "clash") for i, t in DOCS if brute.kept_by_rules(t)])


def test_rule_order_and_reasons(docs):
    rules = [quality_rules.Rule("never", F.lit(False)), quality_rules.Rule("always", F.lit(True)), quality_rules.Rule("half", F.col("n_words") % 2 == 0)]
    stats = [("never", 0.1, 0.0), ("always", 0.5, 1.0), ("half", 0.1, 0.5)]
    assert [r.name for r in quality_rules.ordered(rules, stats)] == ["half", "always", "never"]
    reasons = {r.first_rejection for r in quality_rules.quality_rules(docs, rules, sample_rows=40).collect()}
    assert reasons <= {"base", "half", "always"}
    assert quality_rules.quality_rules(docs, [], sample_rows=40).where("kept = base_failed").count() == 0


VERSIONS = {v: public_tokenizers.path(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}


def encoder(name):
    ranks = bpe.read_ranks(public_tokenizers.path(f"{name}.tiktoken"))
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})


def recounted(docs):
    out = defaultdict(lambda: [0, 0, 0])
    for name in VERSIONS:
        encode = encoder(name).encode_ordinary
        for _, source, lang, text in docs:
            for k, v in enumerate((1, len(encode(text or "")), len(text or ""))):
                out[source, lang, name][k] += v
    return [(*k, *v) for k, v in out.items()]


def test_token_counts_follow_changes(spark, docs, empty):
    labels = spark.createDataFrame([(100, 1, 1), (101, 0, 0), (102, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    state = {i: (i, f"s{(i or 0) % 3}" if i != 5 else None, "en" if (i or 0) % 2 else None, t) for i, t in sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0))}
    greatest = {}
    encode = encoder("byte_bpe_50k").encode_ordinary
    for i, t in DOCS:  # of rows that share a doc_id the one with the greatest counts stays
        greatest[i] = max([greatest.get(i, ""), t or ""], key=lambda x: (len(encode(x)), len(x)))
    state = {i: (*v[:3], greatest[i]) for i, v in state.items() if i not in (100, 102)}
    state[101] = (*state[101][:3], state[101][3].translate({ord(c): None for c in "#*$%&|<>"}))
    same(rolled_up(docs, labels, VERSIONS, public_tokenizers.PATTERN), recounted(state.values()))
    assert rolled_up(empty, labels, VERSIONS, public_tokenizers.PATTERN).count() == 0


def test_token_batches_commit_once(spark, docs):
    rollup = TokenRollup(spark, Scratch(spark, "tokens").root, VERSIONS, public_tokenizers.PATTERN)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    (name, load), *_ = corpus_history(docs.where("doc_id < 50"), labels)
    assert rollup.commit(name, load) and not rollup.commit(name, load)
    before = sorted(map(key, rollup.totals().collect()))
    rollup.commit("empty", load.limit(0))
    load.where("doc_id = 0").write.mode("overwrite").parquet(f"{rollup.folder}/elsewhere")
    # a batch that was written but never named in commits does not count, and is overwritten when sent again
    spark.createDataFrame([("s0", None, "byte_bpe_50k", 9, 9, 9)], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long").write.parquet(f"{rollup.folder}/deltas/batch=half/attempt=lost")
    assert sorted(map(key, rollup.totals().collect())) == before
    assert not rollup._claim(1, name, "another writer of the same number")
    rollup.commit("half", load.where("doc_id = 0").withColumn("op", F.lit("delete")))
    assert sum(r.n_docs for r in rollup.totals().collect()) == sum(x[3][1] for x in before) - len(VERSIONS)


def test_token_batches_of_two_writers(spark):
    """A crash inside the commit loses no batch; a batch that another overtakes is worked out again."""
    folder = Scratch(spark, "tokens").root
    rollup = TokenRollup(spark, folder, VERSIONS, public_tokenizers.PATTERN)
    frame = lambda op, text: spark.createDataFrame([(op, 1, "s", "en", text)], "op string, doc_id long, source string, lang string, text string")
    total = lambda: {(r.n_docs, r.n_tokens) for r in rollup.totals().where("tokenizer = 'byte_bpe_50k'").collect()}
    n = {t: len(encoder("byte_bpe_50k").encode_ordinary(t)) for t in ("hello world", "hello big world", "hello very big world")}

    class Crashing(TokenRollup):
        def _claim(self, number, batch, attempt):
            fs, path = self._fs(f"commits/_{attempt}")
            fs.create(path, True).close()  # an entry that was begun
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        Crashing(spark, folder, VERSIONS, public_tokenizers.PATTERN).commit("one", frame("insert", "hello world"))
    assert not total() and rollup.commit("one", frame("insert", "hello world")) and total() == {(1, n["hello world"])}

    class Overtaken(TokenRollup):
        calls = 0

        def _claim(self, number, batch, attempt):
            self.calls += 1
            if self.calls == 1:
                assert rollup.commit("two", frame("revise", "hello big world"))
            return super()._claim(number, batch, attempt)

    late = Overtaken(spark, folder, VERSIONS, public_tokenizers.PATTERN)
    assert late.commit("three", frame("revise", "hello very big world")) and late.calls == 2
    assert total() == {(1, n["hello very big world"])}
    assert [r.number for r in rollup.commits().orderBy("number").collect()] == [1, 2, 3]
    assert not rollup.commit("two", frame("revise", "hello world"))


def test_substring_dedup(docs, empty):
    want = brute.cut_windows(DOCS, 50)
    same(substring_dedup.substring_dedup(docs), [(i, *want[i, t]) for i, t in DOCS])
    assert substring_dedup.substring_dedup(empty).count() == 0
    rows = substring_dedup.without_repeats(docs, length_col="n_chars")
    assert rows.columns == docs.columns and rows.schema == docs.schema
    new = [(i, want[i, t][2] if want[i, t][1] else t) for i, t in DOCS]
    same(rows.select("doc_id", "text", "n_chars", "cut_from"), [(i, t, len(t or ""), "clash") for i, t in new])


def test_difference_cover():
    period, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_quality_classifier(spark, docs, empty):
    rows = quality_classifier(docs).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier(empty).count() == 0
    one = spark.createDataFrame([(1, None), (1, None)], "doc_id long, text string")
    assert quality_classifier(one).count() == 2


def test_quality_classifier_held_out(spark):
    folder = "/root/testdata/sf0.01"
    scores = {r.doc_id: r.score for r in quality_classifier(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good, bad = [scores[r.doc_id] for r in labels if r.quality == 1], [scores[r.doc_id] for r in labels if r.quality == 0]
    wins = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert wins > 0.9
    assert np.mean(np.array(good) >= 0.5) > 0.95


def test_label_model_finds_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.8, 0.65])
    right = r.random((len(truth), 3)) < accuracy
    votes = np.where(right == truth[:, None], 1, -1) * (r.random((len(truth), 3)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, good, bad = fit_label_model(patterns, counts)
    assert abs(prior - 0.7) < 0.05 and np.abs(good - accuracy).max() < 0.06 and np.abs(bad - accuracy).max() < 0.1
    assert posterior(np.zeros((1, 3), int), prior, good, bad)[0] == pytest.approx(prior)


def test_bpe(docs, empty):
    tokens, pattern = bpe.read_ranks(VERSIONS["byte_bpe_50k"]), public_tokenizers.PATTERN
    encode = encoder("byte_bpe_50k").encode_ordinary
    encoded = bpe.encode(docs, tokens, pattern)
    same(encoded, [(i, encode(t or "")) for i, t in DOCS])
    same(bpe.decode(encoded, tokens).select("doc_id", F.decode("decoded", "UTF-8")), [(i, t or "") for i, t in DOCS])
    digests = {(r.doc_id, r.decoded_sha256): (r.n_tokens, r.ids_sha256) for r in bpe.digests(bpe.decode(encoded, tokens)).collect()}
    assert digests == {(i, brute.sha(t or "")): (len(encode(t or "")), brute.sha(" ".join(map(str, encode(t or ""))))) for i, t in DOCS}
    assert bpe.digests(bpe.decode(bpe.encode(empty, tokens, pattern), tokens)).count() == 0


def test_perfect_hash_and_merges():
    tokens = bpe.read_ranks(VERSIONS["byte_bpe_50k"])
    codec, encode = bpe.live(tokens, public_tokenizers.PATTERN), encoder("byte_bpe_50k").encode_ordinary
    ends = np.cumsum([len(t) for t in tokens])
    starts = np.r_[0, ends[:-1]]
    data = np.frombuffer(b"".join(tokens), np.uint8)
    assert codec.whole.find(data, starts, ends).tolist() == list(range(len(tokens)))
    assert sorted(codec.whole.slots.tolist()) == list(range(len(tokens)))
    known = set(tokens)
    other = [(a, b) for a, b in zip(starts[:5000].tolist(), (ends[:5000] + 3).tolist(), strict=True)]
    want = [bytes(data[a:b]) in known for a, b in other]
    assert (codec.whole.find(data, *np.array(other).T) >= 0).tolist() == want
    r = random.Random(9)
    letters = "aAbé \n\t\r'stvemlld.!?#0123９٣ \x1c\x85　漢字😀İ́"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert codec.encode(text).tolist() == encode(text)


def test_exact_dedup(docs, empty):
    want = brute.exact(DOCS)
    rows = [(i, *want[i, brute.sha(brute.fold(t))], i == want[i, brute.sha(brute.fold(t))][0], brute.sha(brute.fold(t))) for i, t in DOCS]
    same(exact_dedup(docs), rows)
    same(exact_dedup(docs.repartition(37), fan_in=3), rows)
    assert exact_dedup(docs, keep="min").where("kept AND group_size > 1 AND doc_id = 3").count() == 1
    assert exact_dedup(empty).count() == 0


def test_suffix_dedup(docs, empty):
    # rows of one doc_id come in the order of a hash of their text
    order = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    want = brute.cut_strings(sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0, order[x])), 100)
    same(suffix_dedup.suffix_dedup(docs), [(i, *want[i, t][:3], bytearray(want[i, t][3])) for i, t in DOCS])
    same(suffix_dedup.suffix_dedup(docs, cell_phrases=3), [(i, *want[i, t][:3], bytearray(want[i, t][3])) for i, t in DOCS])
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffixes_of_rows_without_an_id(spark):
    """A row without a doc_id loses what starts earlier in itself, and nothing for another row's sake."""
    r = random.Random(9)
    u, v = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (192, 5000))
    texts = [u + u, u + u, v + "x" + v[100:3000] + "y" + v[:150], "ab" * 400, u, "", None, "é" * 90, v]
    rows = spark.createDataFrame([(None, t) for t in texts] + [(5, u + u + "z")], "doc_id long, text string")
    want = []
    for t in texts:
        data, seen, gone = (t or "").encode(), set(), set()
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone |= set(range(i, i + 100))
            seen.add(data[i : i + 100])
        want.append((len(data), len(gone), bytes(b for i, b in enumerate(data) if i not in gone)))
    got = suffix_dedup.suffix_dedup(rows).collect()
    assert sorted((x.n_bytes, x.n_removed, bytes(x.kept)) for x in got if x.doc_id is None) == sorted(want)
    assert [x.n_removed for x in got if x.doc_id == 5] == [192]


def test_suffixes_are_sorted():
    r = np.random.default_rng(6)
    data = np.r_[r.integers(97, 99, 400), np.full(150, 97), r.integers(97, 99, 50)].astype(np.uint8)
    text = bytes(data)
    for length in (3, 8, 20, 100):
        rank = suffix_dedup.cut_suffix_ranks(data, length)
        at = range(len(data) - length + 1)
        want = {s: i for i, s in enumerate(sorted({text[i : i + length] for i in at}))}
        got = sorted({int(rank[i]) for i in at})
        assert [got.index(int(rank[i])) for i in at] == [want[text[i : i + length]] for i in at]


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    pieces = defaultdict(int)
    for i, t in DOCS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            pieces[i, s, len(ids[s : s + 1024]), zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes()), len(ids)] += 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert got == pieces
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(parts[-1]) <= 1024
    assert packing.pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


def test_packing_patterns():
    r = random.Random(4)
    for _ in range(30):
        histogram = {r.randint(1, 64): r.randint(1, 500) for _ in range(r.randint(1, 30))}
        patterns = packing.pack(histogram, 64)
        assert all(sum(p) <= 64 for p, _ in patterns)
        count = defaultdict(int)
        for p, n in patterns:
            for x in p:
                count[x] += n
        assert count == histogram
    many = {i: 1000 - i for i in range(1, 1025)}
    many = {k: v for k, v in many.items() if v > 0}
    full = packing.pack(many, 1024)
    used = sum(k * v for k, v in many.items())
    assert used / (1024 * sum(n for _, n in full)) > 0.98


def test_simhash_dedup(docs, empty):
    same(simhash_dedup.simhash_dedup(docs), brute.near(DOCS))
    assert simhash_dedup.simhash_dedup(empty).count() == 0


@pytest.mark.parametrize("options", [{}, {"paired": True}, {"cell_rows": 40}])
def test_simhash_links_are_complete(spark, options):
    r = random.Random(8)
    prints = []
    for _ in range(60):
        p = r.getrandbits(64)
        for _ in range(10):
            prints.append(p)
            for b in r.sample(range(64), r.randint(0, 4)):
                p ^= 1 << b
    prints = np.array(sorted(set(prints)), np.uint64)
    roots = brute.join(len(prints), lambda a: np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= 4))
    scratch = Scratch(spark, "test")
    frame = spark.createDataFrame([(int(x),) for x in prints.astype(np.int64)], "fp long")
    links = scratch.table(simhash_dedup.near_links(frame, scratch, **options), "links")
    got = {x.node: x.root for x in components(links, scratch).collect()}
    groups = defaultdict(set)
    for p, root in zip(prints.astype(np.int64), roots, strict=True):
        groups[root].add(int(p))
    want = {p: min(g) for g in groups.values() if len(g) > 1 for p in g}
    assert got == want


def test_golay_anchors():
    code = simhash_dedup.golay(1)
    words = np.array(random.Random(2).sample(range(1 << 23), 500))
    at, home = code.anchors(words, 0)
    assert at.tolist() == list(range(500)) and (np.bitwise_count(words ^ home) <= 3).all()
    at, far = code.anchors(words, 1)
    assert (np.bitwise_count(words[at] ^ far) == 4).all()
    assert np.isin(code.anchors(home, 0)[1], home).all()
    for b in range(23):  # one bit away: the other's home is among the anchors
        _, other = code.anchors(words ^ (1 << b), 0)
        near = {(int(i), int(a)) for d in (0, 1) for i, a in zip(*code.anchors(words, d), strict=True)}
        assert all((i, int(a)) in near for i, a in enumerate(other))


def test_components_of_a_path(spark):
    scratch = Scratch(spark, "test")
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in components(links, scratch).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components(links.limit(0), scratch, "none").count() == 0


def test_scratch_uses_the_shared_folder(spark):
    assert Scratch(spark, "x").root.startswith(spark.conf.get("spark.checkpoint.dir"))
