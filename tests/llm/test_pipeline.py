"""The pipeline against brute force, stage by stage on its own input."""

import re

import corpus_pipeline as cp
import tiktoken
from pyspark.sql import functions as F

from tests.llm.test_bpe import _library
from tests.llm.test_dedup import _squeezed
from tests.llm.test_near_dedup import _kept
from tidalpanel.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 100_000)).unionByName(docs.filter("doc_id < 3"))
    seen, columns = [docs.collect()], docs.columns
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
        assert name == cp.STAGES[-1][0] or docs.columns == columns
    every, clean, unique, apart, mixed, encoded = seen

    judged = toxicity.scores(spark.createDataFrame(every, spark.read.parquet(f"{SF}/documents.parquet").schema), spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in judged.collect() if not r.predicted)

    least = {}
    for r in clean:
        t = _squeezed(r.text)
        least[t] = min(least.get(t, r.doc_id), r.doc_id)
    assert sorted((r.doc_id, r.text) for r in unique) == sorted({(r.doc_id, r.text) for r in clean if least[_squeezed(r.text)] == r.doc_id})

    assert sorted(r.doc_id for r in apart) == _kept(unique)

    taken = {r.doc_id: r.taken for r in mixing.mixture(spark.read.parquet(str(tmp_path / "simhash_near_dedup"))).collect()}
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in apart}
    assert {i: sum(words[r.doc_id] for r in mixed if r.doc_id == i) for i in words} == taken

    library: tiktoken.Encoding = _library()
    assert sorted((r.doc_id, r.n_tokens) for r in encoded) == sorted((r.doc_id, len(library.encode_ordinary(r.text))) for r in mixed)


def test_odd_rows_and_clashing_columns(spark):
    """Nulls in every column, empty and long texts, repeats, and columns with the operators' own names go through every stage."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "lonely text here", "en", "a"), (None, None, None, None), (3, "word " * 20_000, "en", "b"), (4, "one two three four five six", "en", "b")]
    rows += [(4, "one two three four five six", "en", "b"), (5, "one  two three four five six", None, "b")] + [(i, f"own text number {i} of many words", "de", "c") for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    for name in ("x_norm", "x_size", "k_text", "f_hit", "x_keep", "fp", "score", "run"):
        docs = docs.withColumn(name, F.lit(f"mine {name}"))
    columns, stages = docs.columns, dict(cp.STAGES)
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, SF)
        assert out.columns == columns
        got = out.collect()
        assert {r.x_norm for r in got} == {"mine x_norm"} and {r.run for r in got} == {"mine run"}
        ids = sorted(r.doc_id for r in got if r.doc_id is not None)
        if name == "toxicity":
            assert len(got) == len(rows)
        elif name != "mix_sources":
            assert ids == [1, 3, 4, *range(10, 30)] and sum(r.doc_id is None for r in got) == 1
        assert stages[name](spark, docs.limit(0), SF).count() == 0
    assert sorted(str(r.doc_id) for r in stages["byte_bpe"](spark, docs, SF).collect()) == sorted(str(r[0]) for r in rows)
