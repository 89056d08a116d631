"""Perplexities against a plain model in dictionaries, and held-out quality."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidalpanel.llm import quality as q


def _plain(texts, trusted):
    """logp of a text under the same model, from the definition."""
    pad = chr(q.PAD) * (q.ORDER - 1)
    counts = Counter()
    for t in trusted:
        s = pad + t
        counts.update(s[i : i + q.ORDER] for i in range(len(t)))
    levels = {q.ORDER: counts}
    for k in range(q.ORDER - 1, 0, -1):
        levels[k] = Counter(g[-k:] for g in levels[k + 1])
    rules = {}
    for k, table in levels.items():
        n = [sum(v == j for v in table.values()) for j in (1, 2, 3, 4)]
        d = [0.5] * 3
        if n[0]:
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.0), j) if n[j - 1] else 0.5 for j in (1, 2, 3)]
        total, left = Counter(), Counter()
        for g, v in table.items():
            total[g[:-1]] += v
            left[g[:-1]] += d[min(v, 3) - 1]
        rules[k] = (table, d, total, left)

    def p(gram, k):
        if not k:
            return 1 / (len(levels[1]) + 1)
        table, d, total, left = rules[k]
        lower = p(gram[1:], k - 1)
        if gram[:-1] not in total:
            return lower
        v = table.get(gram, 0)
        return (v - (d[min(v, 3) - 1] if v else 0)) / total[gram[:-1]] + left[gram[:-1]] / total[gram[:-1]] * lower

    return [sum(math.log(p((pad + t)[i : i + q.ORDER], q.ORDER)) for i in range(len(t))) for t in texts]


@pytest.mark.parametrize("chars", [1 << 23, 3000])
def test_against_the_definition(spark, monkeypatch, chars):
    monkeypatch.setattr(q, "BLOCK_CHARS", chars)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).select("doc_id", "text", "lang")
    odd = [(None, "no id ☃", None), (-1, None, "en"), (-1, "", "en"), (-2, "😀" * 3000, "xx"), (-2, "😀" * 3000, "xx")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).withColumnsRenamed({}).selectExpr("*", "1 as block", "'x' as gram")
    rows = docs.collect()
    labels = spark.createDataFrame([(r.doc_id, int(i % 3 > 0), 0) for i, r in enumerate(rows)] + [(None, 1, 1)], "doc_id long, quality int, n int")
    good = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            good[r.doc_id] = min(good.get(r.doc_id, 1), int(i % 3 > 0))
    trusted = [r.text or "" for r in rows if good.get(r.doc_id) and zlib.crc32(str(r.doc_id).encode()) % 5]
    want = sorted((str(r.doc_id), len(r.text or ""), round(lp, 1)) for r, lp in zip(rows, _plain([r.text or "" for r in rows], trusted)))
    got = q.scores(docs, labels).collect()
    have = sorted((str(r.doc_id), r.n_chars, round(r.log_prob, 1)) for r in got)
    assert [h[:2] for h in have] == [w[:2] for w in want]
    assert np.allclose([h[2] for h in have], [w[2] for w in want], rtol=1e-5, atol=0.11)
    assert all(r.kept == (r.perplexity is not None and r.perplexity <= r.threshold) for r in got)


def test_held_out_documents(spark):
    rows = {r.doc_id: r for r in q.query(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(rows[i], y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(rows) == 1000
    good = [r for r, y in held if y]
    assert np.mean([r.kept for r in good]) >= 0.95
    bad = [rows[i] for i, y in labels.items() if not y]
    assert np.mean([r.kept for r in bad]) <= 0.6


def test_few_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "abc", "en"), (2, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in q.scores(docs, labels).collect()}
    assert got[1].kept and got[1].perplexity == pytest.approx(1.0) and not got[2].kept
    assert q.scores(docs.limit(0), labels).count() == 0


def test_slices_lose_nothing(monkeypatch):
    monkeypatch.setattr(q, "SLICE", 7)
    texts = ["", "abc", "a longer text than a slice", "x" * 50]
    pieces = [p for group in q._groups((True, t) for t in texts) for _, p in group]
    got = Counter(c for p in pieces for c in q.codes(p).tolist())
    assert got == Counter(c for t in texts for c in q.codes(q.points(t)).tolist())
    parts = [q._distinct(g) for g in q._groups((True, t) for t in texts)]
    assert sum(int(n.sum()) for _, _, n in parts) == sum(map(len, texts))
    assert all((q._gram_codes(g) == c).all() for c, g, _ in parts)
