"""The files against the tokenizers library, and the coding alone."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidalpanel.llm import token_files as tf


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(0, 70_000, 7))])
def test_coding(values):
    control, data = tf.code(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4) and len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)
    assert tf.uncode(control, data, len(values)).tolist() == values


@pytest.mark.parametrize("ordinary", [False, True])
def test_files(spark, tmp_path, monkeypatch, ordinary):
    monkeypatch.setattr(tf, "BLOCK_VALUES", 5000)
    odd = [(None, "no id"), (-5, None), (-5, ""), (-5, ""), (10**6, "x " * 40_000), (3, "<|endoftext|> a\t\tb  \n"), (4, "a <|endoftext|> b"), (4, "<|endoftext|>")]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumn("ids", F.lit("extra"))
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "lang as ids").repartition(5))
    library = Tokenizer.from_file(public_tokenizers.path(tf.TOKENIZER))
    library.encode_special_tokens = ordinary
    tf.write(docs, str(tmp_path / "files"), ordinary=ordinary)
    got = sorted(tf.read(spark, str(tmp_path / "files")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got][0] is None and [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    want = sorted((str(r.doc_id), tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in docs.collect())
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    ranks = {r.id: r.rank for r in spark.read.parquet(str(tmp_path / "files/vocabulary")).collect()}
    counts = {}
    for _, ids in want:
        for i in ids:
            counts[i] = counts.get(i, 0) + 1
    assert [i for i, _ in sorted(ranks.items(), key=lambda x: x[1])] == sorted(counts, key=lambda i: (-counts[i], i))


def test_query_and_nothing(spark, tmp_path):
    rows = tf.query(spark, "/root/testdata/sf0.001").collect()
    library = Tokenizer.from_file(public_tokenizers.path(tf.TOKENIZER))
    at = 0
    for r, d in zip(sorted(rows, key=lambda r: r.doc_id), spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    tf.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    assert tf.read(spark, str(tmp_path / "none")).count() == 0


def test_parts_against_the_library():
    """Texts of words, white space and marks at random, in batches that share words; the memo is emptied on the way."""
    rng = random.Random(4)
    with open(public_tokenizers.path(tf.TOKENIZER), encoding="utf-8") as f:
        encoder = tf.PieceEncoder(f.read())
    parts = ["a", "thand", "Don't", "x1", "é", "ñdo,", "end.", "...", "😀", " ", " ", " ", " ", "  ", "\n", "\t", "\u3000", "\u00a0", "<|endoftext|>", "'s", "(b)", "word,", "12", "_"]
    for k in range(40):
        texts = [None if rng.random() < 0.05 else "".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(30)]
        if k == 20:
            encoder._forget()
        n, ids = encoder.encode(pa.array(texts, pa.string()))
        want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, tf.END_ID] for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_rows_are_gathered_and_ids_packed_narrowly():
    """Small batches are encoded together, in order and whole; ids below 2**16 take two bytes before compression."""
    batches = [pa.RecordBatch.from_pydict({"k": list(range(n, n + m)), "text": ["x" * 9] * m}) for n, m in ((0, 3), (3, 0), (3, 4), (7, 1))]
    got = list(tf._gathered(iter(batches)))
    assert len(got) == 1 and got[0].column("k").to_pylist() == list(range(8)) and not list(tf._gathered(iter([])))
    rng = np.random.default_rng(1)
    for top, most in ((1 << 16, 2), (1 << 32, 4)):
        ids = rng.integers(0, top, 5000, np.uint32)
        assert np.array_equal(tf._unsqueeze(tf._squeeze(ids)), ids) and tf._squeeze(ids)[0] == most
    assert not len(tf._unsqueeze(tf._squeeze(ids[:0])))


def test_a_worker_keeps_its_encoder():
    """The next task of a worker gets the words that the last one knew, but no encoder of other rules or of a task that has not ended."""
    with open(public_tokenizers.path(tf.TOKENIZER), encoding="utf-8") as f:
        definition = f.read()
    first = tf._lent(definition, False)
    assert tf._lent(definition, False) is not first
    tf._kept(first)
    assert tf._lent(definition, False) is first
    tf._kept(first)
    assert tf._lent(definition, True) is not first and not tf._KEPT
