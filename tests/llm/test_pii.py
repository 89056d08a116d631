"""Base spans against plain regular expressions, and what contexts add."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tidalpanel.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def _check(rows, texts):
    for r in rows:
        want = _base(texts[r.key])
        assert r.base == want
        assert set(want) <= set(r.all)


def _extracted(docs):
    spans = lambda c: F.expr(f"transform({c}, s -> concat_ws(':', array('email', 'ip', 'card', 'phone')[s.k], string(s.start), string(s.end)))")
    return pii.extract(docs).select("doc_id", spans("base").alias("base"), spans("all").alias("all"))


def test_base_on_random_and_odd_texts(spark):
    rng = random.Random(5)
    parts = ["a@b.c", "x_y@z.com", "@", ".", "1", "255", "256", "0007", "+", " ", "-", "4111111111111111", "é", "😀", "(", ")", "a", "5500 0000 0000 0004", "_", "%", "1.2.3.4", "\n", "+1 (988) 555-2485", "b.c_d@e.f.g"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(600)]
    texts += [None, "", "1" * 50_000, "a" * 50_000, "a." * 30_000 + "@", "1." * 30_000, "+1" + "(" * 50_000, "1 " * 30_000, "x@y.z " * 5_000, "😀 a@b.c 1.2.3.4"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit("clash")).repartition(8)
    got = _extracted(docs).withColumnRenamed("doc_id", "key").collect()
    assert len(got) == len(texts)
    _check(got, texts)


def test_query_columns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = pii.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = _base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]
        assert not want or ",".join(want) in r.spans or set(want) <= set(r.spans.split(","))


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"well reach me on: +1 (555) 010-{1000 + i} thanks") for i in range(30)]
    rows += [(100, "well reach me on: (555) 010-7777, thanks"), (101, "well reach me on: nobody2 thanks"), (102, "page 5550107777 of the book"), (None, "reach me on: 555-010-8888"), (103, None)]
    rows += [(103, None), (200, "mail to: joe(at)host2.example now")] + [(300 + i, f"please mail to: a{i}@host.example now") for i in range(20)]
    got = {r.doc_id: (r.base, r.all) for r in _extracted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {i: [s for s in every if s not in base] for i, (base, every) in got.items()}
    assert added[100] == ["phone:18:32"] and added[None] == ["phone:13:25"] and added[200] == ["email:9:29"]
    assert all(not a for i, a in added.items() if i not in (100, None, 200))
    assert all(base == every[: len(base)] for base, every in got.values())


def test_nothing(spark):
    assert pii.extract(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_running_sum(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        got = spark.range(1).select(F.expr(f"transform(slice(sequence(1L, 1000L), 1, {n}), x -> x * x)").alias("v")).select(pii.running_sum(F.col("v"))).first()[0]
        assert got == [sum(k * k for k in range(1, i + 1)) for i in range(n)]


def test_secrets_are_seeded_and_discovered(spark):
    rng = random.Random(2)
    key = lambda n: "".join(rng.choices("0123456789abcdef", k=n - 2)) + "a1"
    rows = [(i, f'words of text {i} token = "{key(40)}" and more') for i in range(40)]
    rows += [(100, f'words token = "{key(14)}", short'), (101, f"commit {key(40)} of no one"), (102, "token = nothing here"), (103, f"API_KEY={key(32)}; next")]
    rows += [(104, f"again {rows[0][1].split(chr(34))[1]} elsewhere"), (105, None)]
    got = {r.doc_id: r.spans for r in pii._spans(pii.extract(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(got[i] == f"secret:{rows[i][1].index(chr(34)) + 1}:{rows[i][1].index(chr(34)) + 41}" for i in range(40))
    assert got[100] == "secret:15:29" and got[103] == "secret:8:40" and got[104] == "secret:6:46"
    assert got[101] == got[102] == got[105] == ""


def test_secrets_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {r.doc_id: len(re.findall(r'(?i)token = "[0-9a-f]{40}"', r.text)) for r in docs.collect()}
    got = {r.doc_id: r for r in pii.query(spark, "/root/testdata/sf0.01").collect()}
    assert {i: r.n_secret for i, r in got.items()} == planted and sum(planted.values()) > 10
    assert all(r.n_spans == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_secret for r in got.values())
