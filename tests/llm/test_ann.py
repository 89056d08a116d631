"""Recall and order against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalpanel.llm import ann


def _brute(rows, every, k):
    x = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for i in sorted(x):
        if i % every == 0:
            out[i] = sorted(((-float(x[i] @ x[j]), j) for j in x if j != i))[:k]
    return out


def _held(got, want):
    seen, hit, due = {}, 0, 0
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        seen.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert seen.keys() == {q for q, w in want.items() if w}
    for q, found in seen.items():
        assert [r.rank for r in got if r.query_id == q] is not None
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len({i for i, _ in found}) == len(found) == len(want[q])
        hit += len({i for i, _ in found} & {j for _, j in want[q]})
        due += len(want[q])
    return hit / due


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf, monkeypatch):
    monkeypatch.setattr(ann, "TILE", 300)
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = _brute(rows, 100, 20)
    got = ann.neighbours(table.repartition(3), 100).collect()
    assert _held(got, want) >= 0.95
    exact = {(q, j): -s for q, w in want.items() for s, j in w}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)


def test_estimates_and_bounds():
    rng = np.random.default_rng(1)
    x, q, centre, turn = rng.standard_normal((500, 64)), rng.standard_normal((40, 64)), rng.standard_normal(64) / 10, ann.rotations(64)
    code, factor, error = ann.encode(x, centre, turn)
    tile = ann.Tile([(np.arange(500), np.arange(500), code, np.bitwise_count(code).sum(axis=1), factor, error, x)])
    chunk = ann.Queries(q, np.full(40, -1), 20, centre, turn)
    counted = chunk.estimates(np.arange(40), tile.code)
    about = (counted * chunk.counted[:, None] + chunk.ones[:, None] * tile.ones + chunk.rest[:, None]) * factor + chunk.base[:, None]
    off = np.abs(about - q @ x.T) / (chunk.norm[:, None] * error + chunk.rounding[:, None] * factor)
    assert np.mean(off > ann.CONFIDENCE) < 0.01 and np.mean(off) > 0.2
    assert (q @ x.T <= (q @ tile.middle + chunk.norm * tile.radius)[:, None]).all()


def test_clusters_skip_tiles(spark, monkeypatch):
    """Far clusters: a tile of another cluster is never estimated, and nothing is lost."""
    rng = np.random.default_rng(5)
    centres = 40 * rng.standard_normal((8, 16))
    rows = [(i, [float(v) for v in centres[i % 8] + rng.standard_normal(16)]) for i in range(1, 1601)]
    monkeypatch.setattr(ann, "TILE", 50)
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert _held(got, _brute(rows, 20, 20)) >= 0.99


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.standard_normal(9)]) for i in range(200)]
    good += [(1000 + i, good[7][1]) for i in range(60)]
    bad = [(2000, None), (2020, []), (2040, [0.0] * 9), (2060, [1.0, None] + [0.0] * 7), (2080, [float("nan")] + [1.0] * 8), (2100, [float("inf")] + [1.0] * 8), (2120, [1.0]), (None, [1.0] * 9)]
    docs = spark.createDataFrame(good + bad + good[:5], "vec_id long, embedding array<double>").withColumn("vector", F.lit(1)).withColumn("code", F.lit(2))
    rows = ann.neighbours(docs).collect()
    # ids 0 to 4 have two rows each: each finds the other first, and other queries find both
    twice = [r for r in rows if r.query_id == 0]
    assert len(twice) == 40 and all(r.vec_id == 0 and r.score == pytest.approx(np.square(good[0][1]).sum()) for r in twice if r.rank == 1 and r.vec_id == 0)
    alone = docs.filter("vec_id >= 5 or vec_id is null")
    assert _held(ann.neighbours(alone).collect(), _brute([g for g in good if g[0] >= 5], 20, 20)) >= 0.95
    few = spark.createDataFrame(good[:3], "vec_id long, embedding array<double>")
    assert _held(ann.neighbours(few).collect(), _brute(good[:3], 20, 20)) == 1
    assert ann.neighbours(docs.limit(0)).count() == 0
