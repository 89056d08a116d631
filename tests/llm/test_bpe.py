"""Ids against the tiktoken library on whole texts, and the round trip."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from tidalpanel.llm import bpe


def _library():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    (1, None, "x"), (2, "", "x"), (2, "", "x"), (3, " \n\t  a  b\r\n", "x"), (None, "I'll won't 'S ½ ٣٤ ॐ \U0001f600 x‍", "x"), (5, "é" * 5000, None),
    (6, "<|endoftext|>", "x"), (7, "word " * 60_000, "x"), (8, "\x00\x1c\x85  ﻿", "x"),
]


def test_ids_and_round_trip(spark):
    library = _library()
    docs = spark.createDataFrame(ODD, "doc_id long, text string, ids string").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "lang as ids")
    )
    for chars in (1 << 24, 20_000):
        got = bpe.decode(bpe.encode(docs, block_chars=chars)).collect()
        want = sorted((str(r.doc_id), tuple(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
        assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.data)) for r in got) == want


def test_digests(spark):
    library = _library()
    docs = spark.createDataFrame(ODD, "doc_id long, text string, x string")
    want = []
    for doc_id, text, _ in ODD:
        ids = library.encode_ordinary(text or "")
        want.append((str(doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(docs).collect()) == sorted(want)
    assert bpe.digests(docs.limit(0)).count() == 0
