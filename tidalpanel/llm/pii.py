"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail and IP addresses, cards and phone numbers; those are the seeds. Secrets
(keys, tokens, passwords) are a fifth kind without a base pattern: its seeds are long mixed strings right
after a name such as "token =". Every identifier-like span (words with a digit or "@", or with "(at)") is
an instance, the one or two words before it are its patterns, and both form a bipartite graph of distinct surfaces. Spark
scores the graph in rounds: a pattern's confidence in a kind is the score its instances
have in that kind over their number, an unlabelled instance's score is the noisy-or
of its patterns. After the last round, unlabelled instances with a score of at
least CONFIDENCE whose shape suits the kind are added as spans, and the seeds of secrets; base spans stay.

Only DataFrame functions are used. Each base pattern equals its contract's under leftmost
search but is linear in the text: lookbehinds and possessive repeats only spare starts
and retries that cannot succeed. Offsets are code points, from the lengths of the
pieces around the matches. Sums over patterns and instances combine before the
shuffle; a surface that a million documents share is one node.

Defined results: null text is empty, with no spans; null doc_ids pass through; repeated
rows are answered each; very long texts are searched whole, in time linear in their length; an instance
that several kinds claim goes to the best score, ties to the first kind listed; an empty table gives an
empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalpanel.llm.shared import heavy_join, stage, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the graph and its seeds give.
ADDED_KINDS = ("secret",)
SECRET = len(KINDS)
#: Of leftmost search; see the docstring.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words with a digit or "@", with further groups of digits if no letter follows the first; words with "(at)" or "[at]".
INSTANCE = r"(?<!\S)(?:[^\s0-9@]*+[0-9@](?:[^\sA-Za-z]*+(?!\S)(?:\x20[(+]?[0-9]\S*+)++|\S*+)|[A-Za-z][A-Za-z._%+-]*+(?:\(at\)|\[at\])\S++)"
# Names that announce a secret.
SECRET_NAME = r"(?:token|secret|password|passwd|pwd|credential|api[_ -]?key|access[_ -]?key|auth[_ -]?key|private[_ -]?key)s?"
#: What ends just before a seed of that kind, and the seed itself.
SECRET_LEAD = rf"(?i)(?<![a-z]){SECRET_NAME}[\"']?\s{{0,3}}[:=]{{1,2}}\s{{0,3}}$"
SECRET_SEED = r"^(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])[a-z0-9_+/=.-]{20,}$"
CONFIDENCE = 0.75
#: Instances that a pattern needs.
SUPPORT = 5
ROUNDS = 3
#: Lengths are summed in runs of so many, so that a text with very many matches stays cheap.
RUN = 256


def running_sum(lengths: Column) -> Column:
    """The sums of all elements before each, for arrays of any size."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int"))), lambda c: F.slice(lengths, c * RUN + 1, F.lit(RUN)))
    sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x))
    starts = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))

    def within(r: Column, c: Column) -> Column:
        upto = F.aggregate(F.slice(r, 1, F.size(r) - 1), F.array(F.element_at(starts, c + 1)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.when(F.size(r) > 0, upto).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(runs, within))


def _matches(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """df with `name`: array of (start, end, found, before), before being the text since the last match."""
    df = df.withColumn("x_found", F.regexp_extract_all("x_text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("x_between", F.when(F.size("x_found") > 0, F.split("x_text", pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("x_lengths", F.zip_with(F.slice("x_between", F.lit(1), F.size("x_found")), "x_found", lambda b, m: (F.char_length(b) + F.char_length(m)).cast("long")))
    df = df.withColumn("x_starts", F.when(F.size("x_found") > 0, running_sum(F.col("x_lengths"))).otherwise(F.array().cast("array<bigint>")))
    rows = F.transform(
        F.arrays_zip(F.col("x_starts").alias("s"), F.col("x_found").alias("m"), F.slice("x_between", F.lit(1), F.size("x_found")).alias("b")),
        lambda x: F.struct(
            (x["s"] + F.char_length(x["b"])).alias("start"), (x["s"] + F.char_length(x["b"]) + F.char_length(x["m"])).alias("end"), x["m"].alias("found"), F.right(x["b"], F.lit(80)).alias("before")
        ),
    )
    return df.withColumn(name, rows).drop("x_found", "x_between", "x_lengths", "x_starts")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """For up to 19 digits: every second from the right is doubled, with its digits added."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _kept(k: int, kind: str) -> Column:
    kept = F.filter(f"x_{kind}", lambda m: _valid(kind, m["found"]))
    return F.transform(kept, lambda m: F.struct(F.lit(k).alias("k"), m["start"].alias("start"), m["end"].alias("end")))


def base_spans(df: DataFrame) -> DataFrame:
    """df (with x_text) with base: array of (k, start, end) by kind, then start; k is the kind's place in KINDS."""
    for k, kind in enumerate(KINDS):
        df = _matches(df, PATTERNS[kind], f"x_{kind}")
        df = df.withColumn(f"x_{kind}", _kept(k, kind))
    return df.withColumn("base", F.concat(*[f"x_{kind}" for kind in KINDS])).drop(*[f"x_{kind}" for kind in KINDS])


def instances(df: DataFrame) -> DataFrame:
    """df (with x_text and base) with inst: array of (start, end, surface, label, patterns); label is the kind of a base span it overlaps."""
    df = _matches(df, INSTANCE, "x_inst")

    def one(m: Column) -> Column:
        head = F.regexp_extract(m["found"], rf"^(?:(?i:{SECRET_NAME})[\"']?[:=]{{1,2}})?(?:[\[<{{\"'«“]|\((?![0-9]{{1,4}}\)))*", 0)
        lead = F.char_length(head).cast("long")
        tail = F.char_length(F.regexp_extract(m["found"], r"[.,;:!?)\]>}\"'»”#$%&*|]*$", 0)).cast("long")
        inside = F.char_length(m["found"]) - lead - tail
        start, end = m["start"] + lead, F.greatest(m["start"] + lead, m["end"] - tail)
        surface = F.lower(F.substr(m["found"], lead + 1, F.greatest(inside, F.lit(0))))
        based = F.array_min(F.transform(F.filter("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])), lambda b: b["k"]))
        announced = F.rlike(F.concat(F.right(m["before"], F.lit(40)), F.regexp_replace(head, r"[\[<{\"'«“(]+$", "")), F.lit(SECRET_LEAD))
        label = F.coalesce(based, F.when(F.rlike(surface, F.lit(SECRET_SEED)) & announced, F.lit(SECRET)))
        words = F.filter(F.split(F.lower(m["before"]), r"\s+"), lambda w: w != "")
        last = F.transform(F.array(F.lit(1), F.lit(2)), lambda n: F.when(F.size(words) >= n, F.array_join(F.slice(words, -n, n), " ")))
        return F.struct(
            start.alias("start"), end.alias("end"), surface.alias("surface"), label.alias("label"),
            F.filter(last, lambda p: p.isNotNull()).alias("patterns"),
        )

    return df.withColumn("inst", F.filter(F.transform("x_inst", one), lambda i: i["end"] > i["start"])).drop("x_inst")


def suits(surface: Column) -> list[Column]:
    """Whether the shape of a surface suits each kind: a check on what patterns find, wider than the base patterns."""
    n = F.length(_digits(surface))
    email = F.rlike(surface, F.lit(r"@|[(\[]at[)\]]")) & F.rlike(surface, F.lit(r"[a-z0-9]\W*[a-z0-9]"))
    ip = F.rlike(surface, F.lit(r"^[0-9a-f]{1,4}([.:]{1,2}[0-9a-fx*]{1,4}){3,7}$"))
    secret = F.rlike(surface, F.lit(r"^(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])[a-z0-9_+/=.!$%&*#-]{8,}$"))
    return [email, ip, n.between(12, 19) & ~F.rlike(surface, F.lit("[a-z]{3}")), n.between(7, 15) & ~F.rlike(surface, F.lit("[a-z@]")), secret]


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """edges (pattern, surface, label), distinct -> (surface, k) of unlabelled surfaces that the graph assigns a kind."""
    scores = edges.filter("label is not null").groupBy("surface").agg(F.min("label").alias("k")).withColumn("s", F.lit(1.0))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {SUPPORT}")
    open_edges = edges.filter("label is null").select("pattern", "surface")
    suited = F.array(*suits(F.col("surface")))
    found = None
    for _ in range(rounds):
        told = edges.select("pattern", "surface").join(scores, "surface").groupBy("pattern", "k").agg(F.sum("s").alias("told"), F.count(F.lit(1)).alias("m"))
        trusted = told.filter(f"m >= {SUPPORT}").join(sizes, "pattern").withColumn("conf", F.col("told") / (F.col("n") + 1)).filter(f"conf >= {CONFIDENCE}")
        trusted = stage(trusted.select("pattern", "k", "conf"), "pii-patterns")
        voted = open_edges.join(trusted, "pattern").groupBy("surface", "k").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("s"))
        best = voted.filter(F.element_at(suited, F.col("k") + 1)).groupBy("surface").agg(F.max(F.struct("s", (-F.col("k")).alias("k"))).alias("b"))
        new = stage(best.select("surface", (-F.col("b.k")).alias("k"), F.col("b.s").alias("s")).filter(f"s >= {CONFIDENCE}"), "pii-found")
        seeds = edges.filter("label is not null").groupBy("surface").agg(F.min("label").alias("k")).withColumn("s", F.lit(1.0))
        scores, found = seeds.unionByName(new), new
    return found.select("surface", "k")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS + ADDED_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, all): arrays of (k, start, end), by kind and start; one row a document."""
    rows = instances(base_spans(docs.select("doc_id", text_or_empty().alias("x_text"))))
    rows = stage(rows.select("doc_id", "base", "inst").withColumn("row_key", F.monotonically_increasing_id()), "pii-rows")
    each = rows.select("row_key", F.explode("inst").alias("i")).select("row_key", "i.*")
    edges = each.select("surface", "label", F.explode("patterns").alias("pattern"))
    edges = stage(edges.groupBy("pattern", "surface").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n")), "pii-edges")
    total = edges.agg(F.sum("n")).first()[0] or 0
    found = bootstrap(edges, rounds)
    # a seed of a secret is one wherever it stands
    found = found.unionByName(edges.filter(f"label = {SECRET}").select("surface", F.lit(SECRET).alias("k"))).groupBy("surface").agg(F.min("k").alias("k"))
    found = stage(found.join(edges.groupBy("surface").agg(F.sum("n").alias("n")), "surface"), "pii-surfaces")
    seeded = each.filter(f"label = {SECRET}").select("row_key", F.lit(SECRET).alias("k"), "start", "end")
    open_rows = each.filter("label is null").select("row_key", "surface", "start", "end")
    named = heavy_join(open_rows, found, "surface", "n", total).select("row_key", "k", "start", "end")
    added = named.unionByName(seeded).groupBy("row_key").agg(F.collect_list(F.struct("k", "start", "end")).alias("added"))
    out = rows.join(added, "row_key", "left")
    return out.select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("all"))


def _spans(found: DataFrame) -> DataFrame:
    """The columns of the query from extract()."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.k = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    more = [F.expr(f"cast(size(filter(all, s -> s.k = {SECRET})) as long)").alias("n_secret"), F.size("all").cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), *more)


def query(spark, sf_dir):
    return _spans(extract(spark.read.parquet(f"{sf_dir}/documents.parquet")))
