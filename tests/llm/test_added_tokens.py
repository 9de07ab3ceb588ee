"""Packing takes the ids that `tokenizers` gives, also where a text holds an added token."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evidencelake.llm.queries import QUERIES

TEXTS = ["a<|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x ", "plain text", "  <|endoftext|>\n\n don't<|endoftext", "", None, "é漢 <|endoftext|> " * 700]


@pytest.mark.parametrize("query", ["op9_packing", "pipeline"])
def test_added_tokens(spark, tmp_path, query):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = (QUERIES[query](spark, str(tmp_path)) if query in QUERIES else corpus_pipeline.packing(spark, docs, str(tmp_path))).collect()
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    assert tokenizer.encode(TEXTS[0], add_special_tokens=False).ids == [64, 50256, 275]
    for i, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want |= {(i, s, len(ids[s : s + 1024]), zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 1024)}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows} == want and len(rows) == len(want)
