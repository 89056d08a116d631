"""Near copies by exact Jaccard similarity against brute force, with edited copies."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidalpanel.llm import components, near_dedup, simhash

SF = "/root/testdata/sf0.001"


def _set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def _kept(rows):
    sets = [_set(r.text) for r in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    least = {}
    for r, c in zip(rows, root, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    return sorted(least.values())


def _edited(seed):
    """Groups of copies with words replaced, at similarities about and below 0.8, texts with one common passage, odd rows."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(30)]
    texts = []
    for n in (40, 90, 400):
        base = [word() for _ in range(n)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, n // 30 + 2)):
                copy[rng.randrange(n)] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(0, 40))]) for _ in range(40)]
    return [(i, t) for i, t in enumerate([*texts, None, "", " \n", "One two", "one  TWO", "a b c d e", "a b c d f"])]


@pytest.mark.parametrize("crowded", [48, 2])
def test_edited_copies(spark, crowded, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    docs = spark.createDataFrame(_edited(3), "doc_id long, text string")
    got = near_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    want = _kept(docs.collect())
    assert sorted(r.doc_id for r in got.collect()) == want and 10 < len(want) < 80


def test_crowds_lose_no_link_and_need_no_squares(spark, monkeypatch):
    """Many texts around one passage, with own parts from none to a third, in two families that share half of it."""
    monkeypatch.setattr(near_dedup, "CROWDED", 5)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage = [word() for _ in range(120)]
    other = passage[:70] + [word() for _ in range(50)]
    texts = [" ".join([*base, *[word() for _ in range(rng.randrange(0, 40))]]) for base in (passage, other) for _ in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _kept(docs.collect())
    assert sorted(r.doc_id for r in near_dedup.deduplicate(docs).collect()) == want and 4 < len(want) < 120


def test_stage_drops_edited_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["text"])
    long = docs.filter("size(split(text, ' ')) between 100 and 2000")
    copies = long.withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("text", F.concat("text", F.lit(" with two other words at its end")))
    docs = docs.unionByName(copies)
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    want = _kept(docs.collect())
    assert sorted(r.doc_id for r in got.collect()) == want and not [i for i in want if i >= 100_000]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF).count() == 0


def test_fingerprints_make_the_first_candidates(spark, monkeypatch):
    """The stage gets pairs through SimHash and its Golay keys: all sets with fingerprints that are equal or within two bits."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(1500)] for _ in range(12)]
    texts = [" ".join(b[: len(b) - cut]) for b in base for cut in (0, 1, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.xxhash64("text"))
    prints = near_dedup._prints(docs, 5)
    of, mask = {r.c: r.fp for r in prints.collect()}, 2**64 - 1
    assert sorted(of.values()) == sorted(r.fp for r in simhash.fingerprints(docs, 5).collect())
    found = near_dedup._simhash_pairs(prints.select("c", "fp")).collect()
    assert found and all(((of[r.a] ^ of[r.b]) & mask).bit_count() <= 2 for r in found)
    group = {c: c for c in of}
    for r in found:
        old, new = group[r.a], group[r.b]
        group = {c: new if g == old else g for c, g in group.items()}
    assert all(group[a] == group[b] for a in of for b in of if ((of[a] ^ of[b]) & mask).bit_count() <= 2)
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *rest: asked.append(fps.count()) or links(fps, *rest))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs.drop("t"), SF).collect()) == list(range(0, 36, 3))
    assert asked == [len(set(of.values()))]


def test_common_shingles_go_last_however_small_their_share(spark, monkeypatch):
    """A passage of 60 in 3,000 texts makes no candidates: the share sampled, not a fixed number of texts, finds it."""
    monkeypatch.setattr(near_dedup, "SAMPLE", 10)
    rng = random.Random(7)
    own = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage = own(5)
    texts = [" ".join([*own(20), *(passage if k < 60 else []), *own(20)]) for k in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.xxhash64("text"))
    common = int(near_dedup.shingles(" ".join(passage), 5).view("int64")[0])
    held = near_dedup._prints(docs, 5).filter("doc_id < 60")
    assert held.count() == 60 and held.filter(F.array_contains("prefix", common)).count() == 0


def test_families_of_near_copies_need_no_square_of_checks(spark, monkeypatch):
    """Copies with a word or two replaced, most of them similar to most others: few pairs are verified, and no link is missed."""
    monkeypatch.setattr(near_dedup, "CROWDED", 5)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**7)}"
    texts = []
    for n in (70, 130):
        base = [word() for _ in range(n)]
        for _ in range(120):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(n)] = word()
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    checked, verified = [], near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *rest, **more: checked.append(pairs.count()) or verified(pairs, *rest, **more))
    got = sorted(r.doc_id for r in near_dedup.deduplicate(docs).collect())
    assert got == _kept(docs.collect()) and sum(checked) < 4 * len(texts), checked


def test_stars_take_no_round(spark, monkeypatch):
    """Links that are stars around their smallest nodes, in either direction and repeated, are written once: no round only finds that nothing changed."""
    written, stage = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, name, *rest: written.append(name) or stage(df, name, *rest))
    stars = [(1, k) for k in range(2, 40)] + [(k, 50) for k in range(51, 60)] + [(7, 1), (9, 9)]
    found = components.components(spark.createDataFrame(stars, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {k: 1 for k in range(1, 40)} | {k: 50 for k in range(50, 60)}
    assert found.count() == 49 and written == ["links"]
    chain = spark.createDataFrame([(0, 1), (5, 4), (2, 1), (3, 4), (3, 2)], "a long, b long")
    assert sorted(tuple(r) for r in components.components(chain).collect()) == [(k, 0) for k in range(6)] and len(written) > 2


def test_turns_leave_little_garbage_to_the_driver(spark, monkeypatch):
    """The driver collects its garbage between the phases and turns, and each turn's components start from the stars found before."""
    monkeypatch.setattr(near_dedup, "CROWDED", 5)
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**7)}" for _ in range(90)]
    texts = [" ".join([*base[:at], "x", *base[at + 1 :], *[f"w{rng.randrange(10**7)}" for _ in range(rng.randrange(0, 12))]]) for at in (rng.randrange(90) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    calls, collected, linked = [], near_dedup.collected, near_dedup.components
    monkeypatch.setattr(near_dedup, "collected", lambda s: calls.append("collected") or collected(s))
    monkeypatch.setattr(near_dedup, "components", lambda links: calls.append("components") or linked(links))
    assert sorted(r.doc_id for r in near_dedup.deduplicate(docs).collect()) == _kept(docs.collect())
    turns = [k for k, x in enumerate(calls) if x == "components"]
    assert len(turns) > 1 and all("collected" in calls[a:b] for a, b in zip(turns, turns[1:], strict=False)), calls
