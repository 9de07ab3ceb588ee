"""Line dedup finds lines that differ in one word, whatever their length."""

import random
from pathlib import Path

import xxhash
from pyspark.sql import functions as F

from evidencelake.llm import line_dedup
from evidencelake.llm.queries import QUERIES

from . import brute


def pairs():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    out = []
    for n in [*range(1, 14), 16, 20, 31, 60, 90]:
        for kind in ("change", "extra", "missing", "letter", "letter", "another"):
            a = [word() for _ in range(n)]
            b, at = a[:], r.randrange(n)
            if kind == "change":
                b[at] = word()
            elif kind == "extra":
                b.insert(at, word())
            elif kind == "missing":
                del b[at]
            else:
                k = r.randrange(len(a[at]))
                b[at] = a[at][:k] + ("9" if kind == "letter" else "") + a[at][k + 1 :]
            x, y = " ".join(a), " ".join(b)
            # of one or two words, those that differ in one character are found
            if brute.distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9) and (n > 2 or kind in ("letter", "another")):
                out.append((x, y))
    return out


def test_one_word_edits_are_found(spark, tmp_path):
    found = pairs()
    assert len(found) > 60
    docs = [(i, text) for k, (x, y) in enumerate(found) for i, text in ((k, x), (1000 + k, f"{y}!"))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gone = {r.doc_id for r in QUERIES["op1_line_dedup"](spark, str(tmp_path)).where("n_removed = 1").collect()}
    assert [found[k] for k in range(len(found)) if 1000 + k not in gone] == []
    assert all(i >= 1000 for i in gone)


def test_lines_that_are_not_similar_stay(spark):
    texts = ["the cat", "the dog", "a b c", "a b d", "one two three four verylongword", "one two three four otherthings", "abcde", "abxyz", "hello", "hallo", "abcd", "abce"]
    rows = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in rows.where("n_removed > 0").collect()} == {3, 9}


def test_short_keys_differ_by_little(spark):
    lines = ["x", "hello", "a" * 3000, "one two three"]
    frame = spark.createDataFrame([(x, len(x.split())) for x in lines], "norm string, n int")
    keys = [r.k for r in frame.select(line_dedup.short_keys(F.col("norm"), F.col("n")).alias("k")).collect()]
    assert [len(k) for k in keys] == [0, 5, 4, 4]


def test_keys_meet_where_kinds_change(spark, tmp_path):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(600)]
    near = []
    for n in (38, 39, 40, 41):
        w = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        near.append((w, f"{w[:7]}9{w[7:]}"))
    for n in (4, 9, 10, 11, 12, 19, 20, 21, 26, 27, 28, 57, 58, 63, 64, 65, 71, 72, 115, 127, 128, 129, 141, 255, 256, 257):
        w = [r.choice(words) for _ in range(n)]
        near.append((" ".join(w), " ".join(w[: n // 2] + ["extra"] + w[n // 2 :])))
    docs = [(i, text) for k, pair in enumerate(near) for i, text in zip((k, 1000 + k), pair, strict=True)]
    rows = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id for r in rows.where("n_removed = 1").collect()} == {1000 + k for k in range(len(near))}


def test_recall_against_all_pairs(spark):
    """Lines with words changed at random, of all kinds of length: at least nine of ten similar pairs end in one group."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    common = [word() for _ in range(40)]
    found = []
    for n in range(5, 125):
        a = [r.choice(common) if r.random() < 0.4 else word() for _ in range(n)]
        b = a[:]
        for at in r.sample(range(n), max(1, round(n * r.choice((0.03, 0.06, 0.1, 0.14))))):
            b[at] = word()
        x, y = " ".join(a), " ".join(b)
        if brute.distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9):
            found.append((x, y))
    assert len(found) > 100
    docs = [(i, text) for k, pair in enumerate(found) for i, text in zip((k, 1000 + k), pair, strict=True)]
    gone = {x.doc_id for x in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).where("n_removed = 1").collect()}
    print("recall", len(gone) / len(found))
    assert all(i >= 1000 for i in gone) and len(gone) >= 0.9 * len(found)


def test_very_long_lines_are_compared_by_characters(spark):
    a = [f"w{i}" for i in range(2000)]
    b, c = a[:], a[:]
    b[::10], c[::2] = ["other"] * 200, ["other"] * 1000
    frame = spark.createDataFrame([(0, " ".join(a), " ".join(b)), (1, " ".join(a), " ".join(c)), (2, "kitten", "sitten"), (3, "abcde", "abxyz")], "i int, na string, nb string")
    assert [x.s for x in frame.select("i", line_dedup.similar("na", "nb", 0.8).alias("s")).orderBy("i").collect()] == [True, False, True, False]


def test_blocks_are_simhashes_of_runs(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    lines = [[word() for _ in range(n)] for n in (1, 2, 3, 5, 18, 24, 25, 60, 450)] + [["ab"] * 40]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    runs = []
    for i, ws in enumerate(lines):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in ws]
        for k in (3, 2):
            for j in range(len(ws) - k + 1):
                if k == 3 or (len(ws) <= 24 and len(" ".join(ws[j : j + 2])) > 10):
                    turned = [(x << 21 * t | x >> (64 - 21 * t)) % (1 << 64) for t, x in enumerate(h[j : j + k])]
                    bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in turned) > k)
                    padded = f" {' '.join(ws)} "
                    runs.append((i, k, signed(bits), len(ws) - 2, padded.index(f" {' '.join(ws[j : j + k])} ") + 1))
    frame = spark.createDataFrame(runs, "i long, k int, bits long, n int, at int").select("i", "k", "n", "at", F.xxhash64("k", "bits").alias("b"))
    want = {(x.i, x.b, x.at) for x in frame.collect() if x.k == 2 or x.n <= 16 or ((x.b % (1 << 64)) >> 1) < (1 << 63) * 16 / x.n}
    assert 500 > sum(x.k == 3 and x.i == 8 for x in frame.collect()) > 8 * sum(i == 8 for i, _, _ in want) > 0
    frame = spark.createDataFrame([(i, len(" ".join(w)), len(w), " ".join(w)) for i, w in enumerate(lines)], "id long, size int, words int, norm string")
    assert {(x.id, x.bucket, x.at) for x in line_dedup.blocks(frame).collect()} == want


def test_recall_of_words_and_characters(spark):
    """Of lines of 8, 20, 40 and 120 words with words or characters changed, nine of ten similar pairs end in one group."""
    r = random.Random(5)
    letter = lambda: r.choice("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(letter() for _ in range(r.randint(2, 9)))
    pairs = []
    for n in (8, 20, 40, 120):
        for of_words, rate in ((True, 0.08), (True, 0.16), (False, 0.03), (False, 0.1)):
            for _ in range(25):
                a = [word() for _ in range(n)]
                x, b = " ".join(a), a[:] if of_words else list(" ".join(a))
                for at in r.sample([i for i, c in enumerate(b) if c != " "], max(1, round(rate * len(b)))):
                    b[at] = word() if of_words else letter()
                y = " ".join(b) if of_words else "".join(b)
                if brute.distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9):
                    pairs.append((of_words, x, y))
    docs = [(i, text) for k, (_, *pair) in enumerate(pairs) for i, text in zip((k, 1000 + k), pair, strict=True)]
    gone = {x.doc_id for x in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).where("n_removed = 1").collect()}
    assert all(i >= 1000 for i in gone)
    for of_words in (True, False):
        of_kind = {1000 + k for k, p in enumerate(pairs) if p[0] == of_words}
        print("recall", "words" if of_words else "characters", len(of_kind & gone) / len(of_kind))
        assert len(of_kind & gone) >= 0.9 * len(of_kind)


def test_words_made_to_collide_share_no_window(spark):
    """A word of 2,048 letters after Thue and Morse and its complement agree under every polynomial modulo a power of two."""
    from evidencelake.llm.substring_dedup import substring_dedup

    a = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    words = " ".join(f"w{i}" for i in range(49))
    rows = spark.createDataFrame([(1, f"{words} {a}"), (2, f"{words} {b}"), (3, f"{words} {a}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(rows).collect()} == {1: 0, 2: 0, 3: 50}


def test_prose_of_any_script_is_kept(spark):
    """Words without case are words; tables of numbers are not."""
    from evidencelake.llm.quality_rules import quality_filter, quality_rules

    prose = {
        1: "今天 天气 很 好 我们 一起 去 公园 散步 看到 许多 孩子 在 草地 上 玩耍 老人 坐 在 长椅 上 聊天 我 觉得 这样 的 生活 非常 平静",
        2: "ذهب الولد إلى المدرسة في الصباح الباكر وكان يحمل حقيبة كبيرة مليئة بالكتب والدفاتر ثم عاد إلى البيت بعد الظهر وتناول الطعام مع عائلته وقرأ قصة جميلة",
        3: "आज सुबह मैं अपने दोस्त के साथ बाज़ार गया और हमने वहाँ से ताज़ी सब्ज़ियाँ तथा फल खरीदे फिर घर लौटकर खाना बनाया और सबने मिलकर भोजन किया",
        4: "הילד הלך בבוקר לבית הספר עם התיק שלו ופגש בדרך את חבריו הם דיברו על המשחק של אתמול ואחר כך נכנסו לכיתה והמורה סיפרה להם סיפור",
        5: "วันนี้ ฉัน ไป ตลาด กับ แม่ เรา ซื้อ ผัก และ ผลไม้ มากมาย แล้ว กลับ บ้าน มา ทำ อาหาร ให้ ทุก คน ใน ครอบครัว กิน ด้วย กัน อย่าง มี ความสุข",
        6: " ".join(f"{i},{i * 7} ---" for i in range(40)),
    }
    docs = spark.createDataFrame(list(prose.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in quality_rules(docs).where("kept").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.doc_id for r in quality_filter(docs).collect()) == [1, 2, 3, 4, 5]


def test_only_shared_buckets_are_written_and_pairs_go_in_parts(spark, monkeypatch):
    """Blocks that are alone in their bucket are never written, and no part of the pairs holds much more text than all lines."""
    r = random.Random(9)
    words = lambda n: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]
    # 14 lines share a run of three words in their middle and nothing else: every pair of them meets
    hot = [" ".join([*words(7), "one", "two", "three", *words(7)]) for _ in range(14)]
    base = words(20)
    near, alone = [" ".join([*base, x]) for x in ("seven", "eight")], [" ".join(words(30)) for _ in range(200)]
    rows, table = {}, line_dedup.Scratch.table

    def counted(self, frame, name):
        out = table(self, frame, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup.Scratch, "table", counted)
    monkeypatch.setattr(line_dedup, "PART_CHARS", 1)
    docs = spark.createDataFrame(list(enumerate([*hot, *near, *alone])), "doc_id long, text string")
    assert [x.doc_id for x in line_dedup.line_dedup(docs).where("n_removed > 0").collect()] == [15]
    assert "blocks" not in rows and rows["buckets"] < 100
    assert rows["cross-pairs"] >= 78 and "cross-1" in rows


def test_shuffle_files_are_gone_after_a_release(spark, monkeypatch):
    """What a long step of the line dedup has shuffled is deleted before the next step begins."""
    dirs = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {str(x) for d in dirs for x in Path(d).rglob("shuffle_*")}
    release, left = line_dedup.Scratch.release, []

    def watched(self):
        there = shuffled()
        if hasattr(self, "since"):
            self.since -= 10  # as if the step had taken ten seconds more
        release(self)
        left.append(there & shuffled())

    monkeypatch.setattr(line_dedup.Scratch, "release", watched)
    line_dedup.line_dedup(spark.createDataFrame([(i, f"one two three {i}\nfour five six seven {i}") for i in range(40)], "doc_id long, text string"))
    assert len(left) > 5 and not any(left[1:])


def test_pieces_that_a_line_lacks_turn_down_most_others_and_no_similar_line(spark):
    """Lines of letters of one byte, two and four with edits of every kind at random, on both sides of the threshold."""
    r, rows = random.Random(13), []
    for letters in ("ab", "abcdefgh ", "aé ñüoß", "a日本語漢字 ", "𠮷𠀋a文 "):
        for _ in range(150):
            a = [r.choice(letters) for _ in range(r.randint(1, 90))]
            b = a[:]
            for _ in range(r.randint(0, max(1, len(a) // 3))):
                at, kind = r.randrange(len(b)), r.randrange(3)
                b[at : at + (kind < 2)] = [r.choice(letters)] * (kind > 0)
                b = b or ["a"]
            rows.append(("".join(a), "".join(b)))
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(400)]
    line = lambda mid: " ".join([*r.sample(words, 15), *mid, *r.sample(words, 15)])
    others = [(line(["one", "two", "three"]), line(["one", "two", "three"])) for _ in range(100)]
    moved = [(f"{x} {y}", f"{y} {x}") for x, y in ((line([]), line([])) for _ in range(20))]
    frame = spark.createDataFrame([*rows, *others, *moved], "na string, nb string")
    frame = frame.select("na", "nb", line_dedup.similar("na", "nb", 0.8).alias("same"), line_dedup.apart("na", "nb", 0.8).alias("apart"))
    got = frame.collect()
    near = [brute.distance(x.na, x.nb) <= int(0.2 * max(len(x.na), len(x.nb)) + 1e-9) for x in got]
    assert 200 < sum(near) < len(got) - 200 and [x.same for x in got] == near
    assert not any(x.apart and n for x, n in zip(got, near, strict=True))
    of_others = {(x.na, x.nb) for x in got if x.apart}
    assert sum(p in of_others for p in others) >= 90 and any(not n and (not x.na.isascii()) and x.apart for x, n in zip(got, near, strict=True))
