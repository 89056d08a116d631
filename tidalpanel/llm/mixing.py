"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources share the words of all documents by weight; a source stops at
`most` times its own words and the excess is shared again until none is above.

Copies: a document of a source with target t and words S is due r = t / S copies.
floor(r) are certain whole copies; the source's rest, p = r - floor(r) of its words, is a
sample with unequal probabilities: a document's inclusion odds are p / (1 - p) times its size
over the source's mean size, so long documents are likelier than short ones. Documents are ranked by
(u / (1 - u)) / odds, u a hash of the id, and taken in that order up to the words
that are still due (a fixed size in words, not a Poisson sample). Last, the one document
left that fills the gap best is taken if it brings the source nearer.

Scale: words, histograms and gaps are sums that combine before the shuffle. A source is
never sorted as a whole: a histogram over 4096 rank buckets finds the bucket in which the
limit falls, and only that bucket is ordered. The decisions are a small table
(one row a source), which Spark broadcasts while it is small and else joins with skew splitting.

Defined results: null or empty text has size 0 and takes 0 words; null source is a
source of its own, last in order; equal rows (id and text) are taken together or
not at all, beyond the certain copies; ties in rank go to the smaller id, then text hash; with no words
at all every target is 0; a very long text counts whole, and its source misses its target by at most
half of it; an empty table gives an empty table; extra columns are ignored by plan() and kept by mix(),
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalpanel.llm.shared import SPACE, bounded_batches, discard, stage, text_or_empty

BUCKETS = 4096
MOST = 3
WEIGHTS = (1, 2, 3)
_INTERNAL = ("x_size", "x_tie", "x_u")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def _uniform(doc_id: Column) -> Column:
    """In (0, 1), from 52 bits of a hash of the id."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(4503599627370496.0)


def _measured(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    bounded_batches(docs.sparkSession)
    return docs.withColumn("x_size", words(text)).withColumn("x_tie", F.md5(text)).withColumn("x_u", _uniform(F.col("doc_id")))


def ranked(df: DataFrame, column: str) -> DataFrame:
    """df (one row a value) with rank from 0 in code-point order, nulls last: a range
    partitioning and a prefix sum over its partitions, so no task sorts all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(column).asc_nulls_last()
    cut = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("x_id", F.monotonically_increasing_id())
    cut = stage(cut.withColumn("x_part", F.expr("shiftright(x_id, 33)")).withColumn("x_at", F.expr("x_id & 8589934591")), "mix-order")
    sizes = cut.groupBy("x_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("x_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("x_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("x_start"))
    return cut.join(F.broadcast(starts), "x_part").withColumn("rank", F.expr("x_start + x_at")).drop("x_id", "x_part", "x_at", "x_start")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """totals (source, source_size) -> with weight and target. Each round sends the driver
    two sums; the capped sources only grow, so it ends."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    table = stage(ranked(totals, "source").withColumn("weight", weight).drop("rank"), "mix-sources")
    total = table.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level, share = None, (total, None)
    while True:
        capped = F.lit(False) if level is None else F.expr(f"{most} * source_size * {level[1]}BD < {level[0]}BD * weight")
        row = table.agg(
            F.sum(F.when(capped, F.col("source_size") * most)).alias("taken"), F.sum(F.when(~capped, F.col("weight"))).alias("open")
        ).first()
        now = (total - (row["taken"] or 0), row["open"])
        if now == level or not now[1]:
            break
        level = now
    share = level or share
    if not share[1]:
        return table.withColumn("target", F.lit(0.0))
    open_share = (F.lit(share[0]) * F.col("weight")).cast("double") / F.lit(share[1]).cast("double")
    return table.withColumn("target", F.least((F.col("source_size") * most).cast("double"), open_share))


def _rank() -> Column:
    """Random odds over inclusion odds; null for documents that cannot be sampled."""
    u, p = F.col("x_u"), F.col("p")
    size = (F.col("x_size") * F.col("n_docs")).cast("double") / F.col("source_size").cast("double")
    return F.when((p > 0) & (F.col("x_size") > 0), (u / (1.0 - u)) / (p / (1.0 - p) * size))


def _bucket(q: Column) -> Column:
    return F.floor(q / (1.0 + q) * BUCKETS).cast("int")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, measured: DataFrame | None = None) -> DataFrame:
    """One row a source: source, source_size, target, certain copies, inclusion
    probability, the rank up to which documents are taken and the document that fills the gap."""
    rows = measured if measured is not None else _measured(docs).select("doc_id", "source", *_INTERNAL)
    totals = rows.groupBy("source").agg(F.sum("x_size").alias("source_size"), F.count_if(F.col("x_size") > 0).alias("n_docs"))
    base = targets(totals, weights, most)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = base.withColumn("due", due).withColumn("certain", F.floor("due").cast("long")).withColumn("p", F.col("due") - F.col("certain"))
    base = stage(base.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size")).drop("due"), "mix-base")
    chances = base.filter("p > 0 and rest > 0").select(F.col("source").alias("x_source"), "p", "rest", "n_docs", "source_size")
    odds = rows.filter("x_size > 0").join(chances, rows.source.eqNullSafe(chances.x_source)).withColumn("q", _rank()).withColumn("b", _bucket(F.col("q")))
    histogram = odds.groupBy("x_source", "b").agg(F.sum("x_size").alias("w"), F.first("rest").alias("rest"))
    order = Window.partitionBy("x_source").orderBy("b")
    running = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    edge = histogram.withColumn("before", running - F.col("w")).filter("before <= rest and before + w > rest").groupBy("x_source").agg(F.min("b").alias("edge"), F.min("before").alias("before"))
    edge = stage(edge.withColumnRenamed("x_source", "e_source"), "mix-edge")
    met = odds.join(edge, F.expr("x_source <=> e_source and b = edge"))
    peers = Window.partitionBy("x_source").orderBy("q", F.col("doc_id").asc_nulls_first(), "x_tie").rangeBetween(Window.unboundedPreceding, 0)
    fits = met.withColumn("upto", F.col("before") + F.sum("x_size").over(peers)).filter("upto <= rest")
    limit = fits.groupBy("x_source").agg(F.max("upto").alias("upto"), F.max(_key()).alias("last"))
    limit = edge.join(limit, F.expr("e_source <=> x_source"), "left").select("e_source", "edge", F.coalesce("upto", "before").alias("used"), "last")
    limit = stage(limit, "mix-limit")
    left = odds.join(limit, F.expr("x_source <=> e_source")).filter(~_taken()).withColumn("gap", F.col("rest") - F.col("used"))
    left = left.filter("x_size > 0 and abs(x_size - gap) < gap")
    filler = left.groupBy("e_source", "gap").agg(F.min(F.struct(F.abs(F.col("x_size") - F.col("gap")).alias("off"), "q", F.col("doc_id").isNotNull().alias("named"), "doc_id", "x_tie", "x_size")).alias("f"))
    filler = filler.select(F.col("e_source").alias("f_source"), "gap", F.col("f.doc_id").alias("f_id"), F.col("f.x_tie").alias("f_tie"), F.col("f.x_size").alias("f_size"))
    alike = rows.join(filler, F.expr("source <=> f_source and doc_id <=> f_id and x_tie = f_tie")).groupBy("f_source", "gap", "f_id", "f_tie", "f_size").agg(F.count(F.lit(1)).alias("n"))
    filler = alike.filter("abs(n * f_size - gap) < gap").select("f_source", "f_id", "f_tie")
    out = base.join(limit, F.expr("source <=> e_source"), "left").join(filler, F.expr("source <=> f_source"), "left")
    out = out.select("source", "source_size", "n_docs", "target", "certain", "p", "edge", "last", "f_id", "f_tie")
    out = stage(out.toDF("m_source", "source_size", "n_docs", "target", "certain", "p", "edge", "last", "f_id", "f_tie"), "mix-plan")
    discard(edge, limit, base)
    return out


def _key() -> Column:
    return F.struct("q", F.col("doc_id").isNotNull().alias("named"), F.col("doc_id").alias("id"), F.col("x_tie").alias("tie"))


def _taken() -> Column:
    return F.coalesce((F.col("b") < F.col("edge")) | ((F.col("b") == F.col("edge")) & (_key() <= F.col("last"))), F.lit(False))


def _copies(measured: DataFrame, decided: DataFrame) -> DataFrame:
    """measured with x_copies, source_size and target; a pure function of the row and its source's decisions."""
    out = measured.join(decided, measured.source.eqNullSafe(decided.m_source))
    out = out.withColumn("q", _rank()).withColumn("b", _bucket(F.col("q")))
    filler = F.coalesce(F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("x_tie") == F.col("f_tie")), F.lit(False))
    return out.withColumn("x_copies", F.col("certain") + _taken().cast("long") + filler.cast("long"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs."""
    rows = stage(_measured(docs).select("doc_id", "source", *_INTERNAL), "mix-rows")
    out = _copies(rows, plan(docs, weights, most, rows))
    return out.select("doc_id", F.col("x_size").alias("size"), "source_size", "target", (F.col("x_copies") * F.col("x_size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: the columns of docs, each document as many times as it is taken."""
    rows = stage(_measured(docs).select("doc_id", "source", *_INTERNAL), "mix-rows")
    names = docs.columns
    kept = docs.select(*[F.col(c).alias(f"k_{c}") for c in names], "doc_id", "source", "text")
    out = _copies(_measured(kept), plan(docs, weights, most, rows)).filter("x_copies > 0")
    out = out.withColumn("x_times", F.explode(F.expr("sequence(1L, x_copies)")))
    return out.select(*[F.col(f"k_{c}").alias(c) for c in names])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS tie,
         (CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (size > 0) AS n_docs, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), c AS (
  SELECT *, (SELECT sum(source_size) FROM s) AS total, (SELECT sum(weight) FROM s) AS weights,
         coalesce(sum(3 * source_size) OVER o, 0) AS c_before, coalesce(sum(weight) OVER o, 0) AS w_before
  FROM s WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, 3 * source_size * (weights - w_before) < (total - c_before) * weight AS capped FROM c
), l AS (
  SELECT max(total) - coalesce(sum(3 * source_size) FILTER (capped), 0) AS rest, coalesce(sum(weight) FILTER (NOT capped), 0) AS open FROM f
), t AS (
  SELECT source, source_size, n_docs, CASE WHEN open = 0 THEN CAST(3 * source_size AS DOUBLE)
         ELSE least(CAST(3 * source_size AS DOUBLE), CAST(rest * weight AS DOUBLE) / CAST(open AS DOUBLE)) END AS target FROM f, l
), p AS (
  SELECT *, CAST(floor(r) AS BIGINT) AS certain, r - floor(r) AS p, target - floor(r) * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM t)
), q AS (
  SELECT d.*, p.source_size, p.target, p.certain, p.rest, p.p,
         CASE WHEN p.p > 0 AND p.rest > 0 AND size > 0 THEN (u / (1.0::DOUBLE - u)) / (p.p / (1.0::DOUBLE - p.p) * (CAST(size * p.n_docs AS DOUBLE) / CAST(p.source_size AS DOUBLE))) END AS q
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), w AS (
  SELECT *, q IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, tie) <= rest AS taken FROM q
), g AS (
  SELECT *, rest - coalesce(sum(size) FILTER (taken) OVER (PARTITION BY source), 0) AS gap,
         count(*) OVER (PARTITION BY source, doc_id, tie) AS alike FROM w
), e AS (
  SELECT source, min_by(doc_id, (abs(size - gap), q, doc_id, tie)) AS f_id, min_by(tie, (abs(size - gap), q, doc_id, tie)) AS f_tie
  FROM g WHERE NOT taken AND q IS NOT NULL AND size > 0 AND abs(size - gap) < gap GROUP BY source
)
SELECT g.doc_id, CAST(g.size AS BIGINT) AS size, g.source_size, g.target,
       CAST(g.size * (g.certain + CAST(g.taken AS INT) + CAST(coalesce(g.doc_id = e.f_id AND g.tie = e.f_tie AND abs(alike * size - gap) < gap, FALSE) AS INT)) AS BIGINT) AS taken
FROM g LEFT JOIN e ON g.source IS NOT DISTINCT FROM e.source
"""


def query(spark, sf_dir):
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
