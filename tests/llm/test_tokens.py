"""Ids against an encoder that gets each text whole."""

import base64
import random

import pytest

from strataq.llm import tokens

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def whole():
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("head", [tokens.HEAD_WORDS, 5])
def test_round_trip(spark, monkeypatch, whole, head):
    monkeypatch.setattr(tokens, "HEAD_WORDS", head)
    rnd = random.Random(1)
    alphabet = " \t\n\r   ​\x1c\x85'sdreé中文ไทยด้हिन्दी☃️😀𝔘٣½<|endoftext|>.,-_0123ÀSTLL"
    texts = ["", None, " ", "\n\n", "<|endoftext|>", "it's we'll I'D", "  two  spaces \n\n x", "a" * 30_000, "word " * 5000, "﻿bom\r\n"]
    texts += ["".join(rnd.choices(alphabet, k=rnd.randrange(1, 80))) for _ in range(300)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(5, texts[5], 7), (None, "no id", 7), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    want = sorted({(str(i), tuple(whole.encode_ordinary(t or ""))) for i, t, _ in rows})
    out = tokens.encode(df)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in out.collect()) == want
    back = sorted((str(r.doc_id), r.text) for r in tokens.decode(out).collect())
    assert back == sorted({(str(i), t or "") for i, t, _ in rows})
    assert tokens.encode(df.limit(0)).collect() == []
