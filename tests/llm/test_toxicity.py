"""Held-out accuracy, the transducers by hand, and odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidalpanel.llm import toxicity as tox


def _held_out(spark, sf):
    rows = {r.doc_id: r for r in tox.query(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    return np.array(held)


def test_held_out_precision_and_recall(spark):
    said, toxic = _held_out(spark, "/root/testdata/sf0.1").T
    caught = (said * toxic).sum()
    assert toxic.sum() > 80 and caught / toxic.sum() >= 0.9 and caught / said.sum() >= 0.9
    said, toxic = _held_out(spark, "/root/testdata/sf0.01").T
    assert (said == toxic).mean() >= 0.95


def test_marks_lower_the_score_as_data_tell(spark):
    """A word that is toxic when plain or aimed and harmless when negated or reported; the texts asked are not in the fit."""
    forms = ["w{0} {1} v{0}"] * 11 + ["you w{0} {1} v{0}"] * 11 + ["not w{0} {1} v{0}", "said w{0} {1} v{0}"]
    rows = [(i, f"first{i} second{i}. " + forms[i % 24].format(i, "vile" if i // 24 % 2 else "fine"), int(i % 24 < 22 and i // 24 % 2)) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    asked = [(10_000 + k, forms[f].format(f"new{k}", "vile")) for k, f in enumerate((0, 11, 22, 23))] + [(10_004, "nothing here")]
    asked = spark.createDataFrame(asked, "doc_id long, text string")
    found = {r.doc_id - 10_000: r for r in tox.scores(docs.select("doc_id", "text").unionByName(asked), docs).filter("doc_id >= 10000").collect()}
    plain, aimed, negated, reported, nothing = (found[k].score for k in range(5))
    assert min(plain, aimed) >= 0.5 > max(negated, reported, nothing)


def _classes(text):
    return {int(k) for k in np.nonzero(tox.Grammar({"vile": 2.0, "crud*": 1.0}).features(text))[0]}


def test_transducers():
    assert _classes("a vile thing") == {0}
    assert _classes("the crudest of crudities") == {0}
    assert _classes("crud") == set() == _classes(None) == _classes("")
    assert _classes("this is not a vile thing") == {1}
    assert _classes("this is not so. It seems a vile thing") == {0}
    assert _classes("he said. vile") == {0} and _classes("someone said a vile thing") == {2}
    assert _classes('a "vile" thing') == {2}
    assert _classes("you are vile") == {4} and _classes("you are never vile") == {5}
    assert _classes("vile you") == {4} and _classes("vile one two three you") == {4} and _classes("vile one two three four you") == {0}


def test_threats_need_no_learned_word():
    assert _classes("i will kill you") == {12} and _classes("we are going to destroy them") == {12}
    assert _classes("kill you") == {12} and _classes("kill them") == set() and _classes("kill time. You see") == set()
    assert _classes("you will be shot") == {12} and _classes("you saw it shot") == set()
    assert _classes("i will not kill you") == {13} and _classes("he said i will kill you") == {14}
    assert _classes("i will crudify you") == {12}


def test_a_clause_counts_once():
    grammar = tox.Grammar({"vile": 2.0, "rot": 3.0})
    assert grammar.clauses("vile vile vile") == grammar.clauses("vile") == [(0, 2.0)]
    assert grammar.clauses("vile rot. not rot! vile") == [(0, 3.0), (1, 3.0), (0, 2.0)]
    assert len(grammar.clauses("vile " * 400)) == 400 // tox.CLAUSE_TOKENS


WORDS = {"vile": tox.INSULT, "rot": tox.INSULT, "kill": tox.THREAT, "you": tox.TARGET, "them": tox.PERSON, "i": tox.FIRST_PERSON, "will": tox.MODAL, "not": tox.NEGATION, "said": tox.REPORT, '"': tox.QUOTE, "a": tox.OTHER, "the": tox.OTHER}


def _naive(words, weight):
    """The grammar by its definitions: every match looks around itself; no states."""
    out, quotes, clauses = [], 0, [[]]
    for w in words:
        if w == "." or len(clauses[-1]) == tox.CLAUSE_TOKENS:
            clauses.append([])
        if w != ".":
            clauses[-1].append(w)
    for clause in clauses:
        kind = [WORDS[w] for w in clause]

        def near(i, kinds, least, most):
            return any(kind[j] in kinds for j in range(max(0, i + least), min(len(kind), i + most + 1)) if j != i)

        def marks(i):
            quoted = (quotes + sum(k == tox.QUOTE for k in kind[:i])) % 2
            return near(i, {tox.NEGATION}, -tox.NEGATION_SCOPE, -1) | (bool(quoted) or tox.REPORT in kind[:i]) << 1

        people, found, verb = {tox.TARGET, tox.PERSON}, [], None
        for i, k in enumerate(kind):
            armed = near(i, {tox.FIRST_PERSON, tox.MODAL}, -tox.THREAT_SCOPE, -1)
            if k == tox.INSULT:
                aimed = near(i, people, -tox.TARGET_SCOPE, tox.TARGET_SCOPE)
                found.append((weight[clause[i]], -i, marks(i) | aimed << 2))
            if verb is not None and i - verb[0] > tox.TARGET_SCOPE:
                verb = None
            hit = verb is not None and (k == tox.TARGET or k == tox.PERSON and verb[1])
            if hit or k == tox.THREAT and armed and near(i, {tox.TARGET}, -tox.PASSIVE_SCOPE, -1):
                found.append((tox.THREAT_WEIGHT, -i, marks(i) | 12))
                verb = None
            if k == tox.THREAT or k == tox.INSULT and armed:
                verb = (i, armed)
        if found:
            best = max(found)
            out.append((best[2], best[0]))
        quotes += sum(k == tox.QUOTE for k in kind)
    return out


def test_composed_machine_against_definitions():
    rng, weight = random.Random(11), {"vile": 2.0, "rot": 6.0}
    grammar = tox.Grammar(weight)
    for _ in range(4000):
        words = rng.choices([*WORDS, "."], weights=[2, 2, 3, 3, 2, 2, 2, 2, 1, 1, 6, 6, 2], k=rng.randint(0, 60))
        assert grammar.clauses(" ".join(words)) == _naive(words, weight), words


def test_odd_rows(spark):
    data = [(i, f"some words here {'vile rot' if i % 3 == 0 else 'fine day'} number{i}", "x") for i in range(200)]
    data += [(None, None, "x"), (1001, "", "x"), (1001, "", "x"), (1002, "vile " * 50_000, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 9) for i in range(200)] + [(None, 1, 1), (7, None, 1), (1001, 1, 0)], "doc_id long, toxic int, lang int")
    got = tox.scores(docs, labels).collect()
    assert len(got) == len(data)
    assert all(r.predicted == (r.doc_id is not None and (r.doc_id == 1002 or r.doc_id < 200 and r.doc_id % 3 == 0)) for r in got)
    kept = tox.reject(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    clash = tox.reject(docs.withColumn("x_score", F.lit(0.9)).withColumn("x_toxic", F.lit("mine")), labels)
    assert clash.count() == kept.count() and clash.select("x_score", "x_toxic").distinct().collect() == [(0.9, "mine")]
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.predicted for r in tox.scores(docs, few).collect()} == {0}
    assert tox.scores(docs.limit(0), labels).count() == 0


def test_every_labelled_row_is_learned_from(spark):
    """150,000 labelled rows, of which about 120,000 may be learned from; words that only six toxic texts hold are learned, so no row is left out."""
    ids = [i for i in range(0, 150_000, 10) if zlib.crc32(str(i).encode()) % 5]
    rare = spark.createDataFrame([(ids[100 * k + j * 2_000], f"q{k}rare") for k in range(15) for j in range(6)], "doc_id long, rare string")
    rows = spark.range(150_000).selectExpr("id AS doc_id", "concat('first', id, ' second', id) AS text", "int(id % 10 = 0) AS toxic").join(F.broadcast(rare), "doc_id", "left")
    rows = rows.select("doc_id", F.concat_ws(" ", "text", "rare").alias("text"), "toxic")
    learnable = {r["toxic"]: r["count"] for r in rows.filter("crc32(string(doc_id)) % 5 <> 0").groupBy("toxic").count().collect()}
    texts, n_toxic, n_clean = tox._training(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert learnable[0] + learnable[1] > 110_000 and (n_toxic, n_clean) == (learnable[1], learnable[0])
    assert {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()} == learnable
    assert {f"q{k}rare" for k in range(15)} <= set(tox.learn_lexicon(texts, n_toxic, n_clean))


def test_sums_of_tasks_fit_the_model(spark):
    """Newton's steps by sums of several tasks against gradients of all rows at once."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (300, tox.CLASSES)) * (rng.random((300, tox.CLASSES)) < 0.2).astype(float)
    y, n = (np.log1p(x) @ tox._prior() + rng.normal(size=300) > 3).astype(int), rng.integers(1, 5, 300)
    rows = spark.createDataFrame([(int(a), b.tolist(), int(c)) for a, b, c in zip(y, x, n, strict=True)], "toxic int, x array<double>, n long").repartition(7)
    weights, intercept = tox._fit(rows)
    full, w, prior = np.column_stack([np.log1p(x), np.ones(300)]), np.append(weights, intercept), np.append(tox._prior(), tox.INTERCEPT)
    assert np.abs(full.T @ (n * (1 / (1 + np.exp(-full @ w)) - y)) + tox.PULL * (w - prior)).max() < 1e-5
