"""Seeded transforms of whole documents against plain versions, and the grid of them."""

import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from evidencelake.functions import textsem
from evidencelake.operators import perturb
from evidencelake.plans.perturb_queries import title_words

FOLDER, MASK = "/root/testdata/sf0.001", 0xFFFFFFFF
WS = regex.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04X}", textsem.WS)


def seeded(text):
    h = 0x811C9DC5
    for c in text.encode():
        h = ((h ^ c) * 0x01000193) & MASK
    return h


def drawn(seed, i):
    a = (seed + i * 0x6D2B79F5) & MASK
    t = ((a ^ a >> 15) * (1 | a)) & MASK
    t = ((t + ((t ^ t >> 7) * (61 | t) & MASK)) & MASK) ^ t
    return ((t ^ t >> 14) & MASK) / 2**32


def trim(s):
    return regex.sub(f"^{WS}+|{WS}+$", "", s)


def sentences(text):
    return [s for s in map(trim, regex.split(rf"(?<=[.!?]){WS}+", text)) if s]


def human_edit(text, seed, protected):
    seed, every = seeded(f"human_edit:{seed}"), sentences(text)
    if not every:
        return text
    kept, n = [s for i, s in enumerate(every) if drawn(seed, i + 1) >= 0.1] or every[:1], len(every)
    if len(kept) >= 2:
        n += 1
        at = int(drawn(seed, n) * (len(kept) - 1))
        kept[at], kept[at + 1] = kept[at + 1], kept[at]
    out = []
    for i, s in enumerate(kept):
        for w in [" "] * (i > 0) + regex.findall(f"{WS}+|[^{WS[1:-1]}]+", s):
            core = regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w).lower()
            if regex.match(WS, w) or core in protected:
                out.append(w)
                continue
            n += 1
            out.append(w if drawn(seed, n) >= 0.05 else "")
    return "".join(out)


def synonyms(text):
    out = []
    for w in regex.findall(r"\p{L}[\p{L}'-]*|[^\p{L}]+", text):
        new = perturb.SYNONYMS.get(w.lower())
        if new is None or not regex.match(r"\p{L}", w):
            out.append(w)
        elif w == w.upper() != w.lower():
            out.append(new.upper())
        else:
            out.append(new[0].upper() + new[1:] if w[0] == w[0].upper() and w[1:] == w[1:].lower() else new)
    return "".join(out)


def swapped(s, coin):
    at = s.find(", ")
    if at < 1 or coin < 0.5 or not s[at + 2 :]:
        return s
    first, rest = s[:at], s[at + 2 :]
    end = rest[-1] if rest[-1] in ".!?" else ""
    body = rest[: len(rest) - len(end)]
    return f"{body[:1].upper()}{body[1:]}, {first[0].lower()}{first[1:]}{end}"


def paraphrase(text, seed):
    seed, i, out = seeded(f"paraphrase:{seed}"), 0, []
    for s in map(synonyms, sentences(text)):
        i += ", " in s
        out.append(swapped(s, drawn(seed, i)))
    return " ".join(out) if out else synonyms(text)


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    more = ["However, the novel METHOD works. Therefore, we compare it! Is it, robust?", "", "  \n ", "One sentence only", "A, b. " * 40, "Analyzing\tdata, We Utilize it.  The OF the-of."]
    return rows + [(10**6 + i, t) for i, t in enumerate(more)]


def test_human_edit_and_paraphrase_of_documents(spark, texts):
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    seed = F.col("doc_id").cast("string")
    edited = perturb.human_edit(F.col("text"), seed, F.array(F.lit("the"), F.lit("of")))
    got = {r.doc_id: (r.e, r.p) for r in frame.select("doc_id", edited.alias("e"), perturb.paraphrase(F.col("text"), seed).alias("p")).collect()}
    for i, t in texts:
        assert got[i] == (human_edit(t, str(i), {"the", "of"}), paraphrase(t, str(i))), i
    assert sum(got[i][0] != t for i, t in texts) > len(texts) / 2 and any(got[i][1] != t for i, t in texts)


def test_transform_grid_of_documents(spark, texts):
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    none = F.array().cast("array<string>")
    calls = {"human_edit": lambda t, s: perturb.human_edit(t, s, none), "paraphrase": perturb.paraphrase, "plugged": perturb.python_transform(title_words, seeded=False), "translate": None}
    rows = perturb.transform_grid(frame, calls, 2, "doc_id").select("doc_id", "transform", "repeat", "available", F.sha2("text", 256).alias("digest"), "error")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in texts:
        for r in (1, 2):
            want[i, "human_edit", r] = (True, sha(human_edit(t, f"{i}:human_edit:{r}", set())), None)
            want[i, "paraphrase", r] = (True, sha(paraphrase(t, f"{i}:paraphrase:{r}")), None)
            want[i, "plugged", r] = (True, None, "ValueError: one word") if len(t.split()) < 2 else (True, sha(t.title()), None)
            want[i, "translate", r] = (False, None, None)
    assert {(x.doc_id, x.transform, x.repeat): (x.available, x.digest, x.error) for x in rows.collect()} == want
