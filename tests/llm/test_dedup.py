"""Exact and near duplicates against brute force, with the odd rows that corpora hold."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidalpanel.llm import exact_dedup, simhash
from tidalpanel.llm.components import components

SCHEMA = "doc_id long, text string, digest string, key int"
ROWS = [
    (5, "a  b\tc", "x", 1), (2, "a b c", "y", 2), (9, "a b c", None, 3), (1, None, None, None), (7, "", "z", 4),
    (7, "", "z", 4), (3, " ", "z", 4), (4, "\n\t ", "z", 4), (None, "lonely", "n", 0), (None, "a b c", "n", 0),
    (11, "w " * 30_000, "long", 0), (12, "w\n" * 30_000, "long", 0),
]


def _squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("digest_bits", [256, 8])
def test_exact_groups(spark, digest_bits):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup.groups(docs, digest_bits).collect()
    by = {}
    for doc_id, text, *_ in ROWS:
        by.setdefault(_squeezed(text), []).append(doc_id)
    want = sorted((str(i), str(min([x for x in ids if x is not None], default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(by)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_deduplicate_keeps_columns_and_one_row_a_group(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len({_squeezed(r.text) for r in rows}) == len(rows) == len({_squeezed(t) for _, t, *_ in ROWS})
    assert {r.doc_id for r in rows if _squeezed(r.text) == "a b c"} == {2}
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def _clashing(docs):
    names = ("x_norm", "x_digest", "x_keep", "f_hit", "f_word", "x_fp", "x_root", "k_text", "h_found", "run")
    return docs.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])


@pytest.mark.parametrize("deduplicate", [exact_dedup.deduplicate, simhash.deduplicate])
def test_clashing_columns_stay(spark, deduplicate):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = deduplicate(_clashing(docs))
    assert out.columns == _clashing(docs).columns
    assert sorted(map(str, out.collect())) == sorted(map(str, _clashing(deduplicate(docs)).collect()))


def test_runs_filters_and_levels(spark, monkeypatch):
    """Many runs, a fan-in of two, a filter of few bits, and a group in every run."""
    monkeypatch.setattr(exact_dedup, "FANOUT", 2)
    docs = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then concat('t ', id % 70) else concat('own ', id) end as text").repartition(11)
    by = {}
    for r in docs.collect():
        by.setdefault(r.text, []).append(r.doc_id)
    want = sorted((i, min(ids), len(ids), i == min(ids)) for ids in by.values() for i in ids)
    for bits in (24, 10):
        monkeypatch.setattr(exact_dedup, "FILTER_BITS", bits)
        got = exact_dedup.groups(docs)
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want
        assert sorted(r.doc_id for r in exact_dedup.deduplicate(docs).collect()) == sorted(min(ids) for ids in by.values())
    index = exact_dedup.build(docs)
    assert index.alone.count() + index.meeting.count() == 4000
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 24)
    alone = exact_dedup.build(docs).alone
    assert alone.count() > 1500 and {r.group_size for r in alone.select("doc_id").join(got, "doc_id").collect()} == {1}


def _fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 2)[0]:
            x, y = find(i), find(i + 1 + int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_by_hand():
    for text in ("", None, "One", "One TWO", "ÀB c D e F g", "x\x0by\x1cz a b c d", "w " * 70_000 + "end"):
        for width in (3, 5):
            assert simhash.fingerprint(text, width) == _fingerprint(text, width)


@pytest.mark.parametrize("crowded", [False, True])
def test_simhash_groups(spark, crowded, monkeypatch):
    if crowded:
        monkeypatch.setattr(simhash, "NEIGHBOURS", 0)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1).alias("fp"))
    odd = spark.createDataFrame([(-1, None, 0), (-2, "", 0), (-3, "x", 0), (-3, "x", 0), (-4, "X", 0)], "doc_id long, text string, fp int")
    docs = table.unionByName(odd)
    rows = docs.collect()
    fps = [_fingerprint(r.text, 3) for r in rows]
    roots = _components(fps)
    least = {}
    for r, c in zip(rows, roots):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted((r.doc_id, np.uint64(f).astype(np.int64), least[c]) for r, f, c in zip(rows, fps, roots))
    assert sorted(map(tuple, simhash.groups(docs, 3).collect())) == want


def test_simhash_crowded_keys_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centre = int(rng.integers(0, 2**62))
    near = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(150)})
    frame = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in near], "fp long")
    want = _components(near)
    for limit in (0, 65):
        monkeypatch.setattr(simhash, "NEIGHBOURS", limit)
        found = {r.node: r.root for r in components(simhash.links(frame)).collect()}
        got = [found.get(int(np.uint64(x).astype(np.int64)), x) for x in near]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in components(path).collect()} == {0}
    assert components(path.limit(0)).count() == 0
