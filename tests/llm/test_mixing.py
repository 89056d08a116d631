"""Targets, copies and reruns of the mixture."""

import math

from pyspark.sql import functions as F

from tidalpanel.llm import mixing


def _fill(sizes, weights, most=3):
    total, capped = sum(sizes), set()
    while True:
        room = total - sum(most * sizes[i] for i in capped)
        opened = sum(w for i, w in enumerate(weights) if i not in capped)
        if not opened:
            return [most * s for s in sizes]
        over = {i for i in range(len(sizes)) if i not in capped and room * weights[i] / opened > most * sizes[i]}
        if not over:
            return [most * s if i in capped else room * weights[i] / opened for i, s in enumerate(sizes)]
        capped |= over


def test_targets_and_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixture(docs.withColumn("source", F.expr("if(source in ('src1', 'src2'), null, if(source < 'src15', 'hot', source))"))).collect()
    by = {}
    names = {r.doc_id: r.source for r in docs.selectExpr("doc_id", "if(source in ('src1', 'src2'), null, if(source < 'src15', 'hot', source)) as source").collect()}
    for r in rows:
        by.setdefault(names[r.doc_id], []).append(r)
    order = sorted([s for s in by if s is not None]) + [None]
    sizes = [sum(r.size for r in by[s]) for s in order]
    want = _fill(sizes, [1 + k % 3 for k in range(len(order))])
    for s, size, target in zip(order, sizes, want):
        assert {r.source_size for r in by[s]} == {size}
        assert all(math.isclose(r.target, target, rel_tol=1e-12) for r in by[s])
        taken = sum(r.taken for r in by[s])
        assert abs(taken - target) <= max(r.size for r in by[s]) / 2  # the next document in order either fills half the gap or leaves less
        assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in by[s])


def test_mix_repeats_rows_and_reruns_agree(spark):
    data = [(i, "w " * (i % 17 + 1), f"s{i % 4}" if i % 5 else None, "extra") for i in range(300)] + [(5, None, "s0", ""), (None, "a b", "s1", ""), (5, "w", "s9", "")] + [(7, "same row", "s2", "e")] * 5
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, p string")
    first = mixing.mix(docs)
    assert first.columns == docs.columns
    once, again = sorted(map(str, first.collect())), sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert once == again
    taken = mixing.mixture(docs)
    assert taken.agg(F.sum("taken")).first()[0] == sum(len(r.split()) for r in [r.text or "" for r in first.collect()])
    assert mixing.mixture(docs.limit(0)).count() == 0
    assert mixing.mixture(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0
