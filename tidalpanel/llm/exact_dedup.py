"""Exact deduplication with a log-structured merge index of text digests.

Flush: every task writes its documents' digests as a sorted run (a memtable that is full), and
each run gets a one-hash filter: the slots it fills, and whether it fills one twice.
Probe: a digest whose slot no other run and no second row of its own run fills is alone; it
needs no merge and is never shuffled. Compaction merges the other entries level by level, FANOUT
runs into one, and keeps the smallest identifier of each digest. Hits (digests of several rows)
are verified on the bytes: equal digests with unequal texts are split into their own groups.

Filters have at most 2**FILTER_BITS bits, whatever the input; beyond that they let more entries
through, which costs shuffle and changes nothing else. A digest that very many rows share
is merged in every run before it moves, and its rows learn their group by broadcast.

Only DataFrame functions are used. Defined results:
  null text        counts as the empty text
  null doc_id      sorts after every other; a group of only null ids has keep_id null
  repeated rows    one row of the group stays, whichever was flushed first
  ties             the smaller doc_id stays
  empty table      no rows
  very long texts  are hashed whole; only those of hits are moved, once a run
  extra columns    are ignored by the index and kept by deduplicate(), whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalpanel.llm.shared import SPACE, bounded_batches, discard, filter_bits, filter_words, heavy_join, keep_first, maybe_member, shielded, stage, text_or_empty, unshielded

#: Rows of one run file.
MEMTABLE_ROWS = 1_000_000
#: Runs that a level merges into one.
FANOUT = 32
#: Bits of a filter: at most 2**18 words of 64.
FILTER_BITS = 24


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; a lone space is left as it is."""
    return F.regexp_replace(text, f"[{SPACE}]{{2,}}|[\\x09-\\x0D]", " ")


def _digest(norm: Column, digest_bits: int) -> Column:
    full = F.unhex(F.sha2(norm, 256))
    return full if digest_bits == 256 else F.substring(full, 1, max(1, digest_bits // 8))


def _with_digest(docs: DataFrame, digest_bits: int) -> DataFrame:
    """docs (with text) with x_norm and x_digest."""
    out = docs.withColumn("x_norm", normalised(text_or_empty()))
    return out.withColumn("x_digest", _digest(F.col("x_norm"), digest_bits))


def flush(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    """Sorted runs (digest, doc_id, sha, row_key, run), one row a document."""
    bounded_batches(docs.sparkSession)
    norm = normalised(text_or_empty())
    runs = docs.select("doc_id", F.unhex(F.sha2(norm, 256)).alias("sha"), F.monotonically_increasing_id().alias("row_key"))
    runs = runs.withColumn("digest", F.col("sha") if digest_bits == 256 else F.substring("sha", 1, max(1, digest_bits // 8)))
    runs = runs.withColumn("run", F.shiftrightunsigned("row_key", 33).cast("int"))
    return stage(runs.sortWithinPartitions("digest", "doc_id"), "dedup-runs", maxRecordsPerFile=str(MEMTABLE_ROWS))


def _slot(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("digest"), 64 - bits)


def run_filters(runs: DataFrame, bits: int) -> DataFrame:
    """(run, f_word, once, again): the slots that a run fills, 64 a row, and those it may fill twice."""
    words = runs.select("run", F.shiftright(_slot(bits), 6).alias("f_word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    return words.groupBy("run", "f_word").agg(F.bit_or("bit").alias("once"), F.count(F.lit(1)).alias("n")).withColumn("again", F.expr("if(n > bit_count(once), once, 0L)")).drop("n")


def met_slots(filters: DataFrame) -> DataFrame:
    """(f_word, f_bits): the slots filled by several runs, or twice in one; at most 2**(FILTER_BITS - 6) rows."""
    # a word's runs are folded in parts of FANOUT, so the list of a part is bounded
    def fold(level: DataFrame) -> DataFrame:
        both = F.expr("aggregate(x, named_struct('o', 0L, 'a', 0L), (s, r) -> named_struct('o', s.o | r.once, 'a', s.a | r.again | (s.o & r.once)))")
        out = level.groupBy("run", "f_word").agg(F.collect_list(F.struct("once", "again")).alias("x")).withColumn("y", both)
        return out.select("run", "f_word", F.col("y.o").alias("once"), F.col("y.a").alias("again"))

    highest = filters.agg(F.max("run")).first()[0] or 0
    while True:
        filters = fold(filters.withColumn("run", F.expr(f"run div {FANOUT}").cast("int")))
        if highest < FANOUT:
            return filters.filter("again <> 0").select("f_word", F.col("again").alias("f_bits"))
        highest //= FANOUT


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))


def compact(runs: DataFrame) -> DataFrame:
    """One row for each digest of the runs: the smallest identifier and the number of rows.
    Each level merges FANOUT runs into one; a run's entries combine before they move."""
    highest = runs.agg(F.max("run")).first()[0] or 0
    level = runs.select("run", "digest", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key").alias("first"), F.lit(1).cast("long").alias("group_size"))
    while True:
        level = level.groupBy(F.expr(f"run div {FANOUT}").cast("int").alias("run"), "digest").agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size"))
        if highest < FANOUT:
            break
        highest //= FANOUT
    return stage(level.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row_key").alias("keep_row"), "group_size"), "dedup-level")


class Index:
    """The runs of docs, the entries that their filters say may meet others, and the compacted level of those."""

    def __init__(self, runs: DataFrame):
        self.runs = runs
        self.rows = runs.count()
        self.bits = filter_bits(self.rows, FILTER_BITS)
        self.met = stage(met_slots(run_filters(runs.withColumn("slot", _slot(self.bits)), self.bits)), "dedup-filter")
        probed = maybe_member(runs, self.met, F.xxhash64("digest"), self.bits, keep_rest=True)
        self.alone, self.meeting = probed.filter("not f_hit").drop("f_hit"), probed.filter("f_hit").drop("f_hit")
        self.level = compact(self.meeting)

    def hits(self) -> DataFrame:
        return self.level.filter("group_size > 1")

    def hit_filter(self) -> tuple[DataFrame, int]:
        bits = filter_bits(self.hits().count(), FILTER_BITS)
        return stage(filter_words(self.hits(), F.xxhash64("digest"), bits), "dedup-hits"), bits

    def groups(self) -> DataFrame:
        """runs with keep_id, keep_row, group_size."""
        alone = self.alone.select("*", F.col("doc_id").alias("keep_id"), F.col("row_key").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
        return alone.unionByName(heavy_join(self.meeting, self.level, "digest", "group_size", self.rows))


def verify(docs: DataFrame, index: Index, digest_bits: int = 256) -> bool:
    """Compare the bytes behind every hit: whether equal digests always meant equal texts."""
    words, bits = index.hit_filter()
    candidates = maybe_member(_with_digest(docs.select("text"), digest_bits), words, F.xxhash64("x_digest"), bits)
    # equal texts meet in each task before the shuffle, so a large group sends one row a task
    classes = candidates.groupBy("x_digest", "x_norm").agg(F.count(F.lit(1)).alias("n"))
    collided = classes.groupBy("x_digest").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1").isEmpty()
    discard(words)
    return collided


def build(docs: DataFrame, digest_bits: int = 256) -> Index:
    """The verified index of docs."""
    index = Index(flush(docs, digest_bits))
    if not verify(docs, index, digest_bits):
        # the digest was too short for these texts: the runs hold the whole one as well
        discard(index.level, index.met)
        index = Index(index.runs.withColumn("digest", F.col("sha")))
        if not verify(docs, index):
            raise ValueError("different texts share a SHA-256 digest")
    return index


def groups(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    found = build(docs, digest_bits).groups()
    return found.select("doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns and whole texts.

    Only rows of groups meet in a shuffle, and only the one with the smallest id of each
    text in a task; rows that a bounded filter shows to be alone pass straight through."""
    index = build(docs)
    grouped = index.hits().select(F.col("digest").alias("x_digest"), F.col("digest").alias("x_root"), F.col("keep_id").alias("x_keep"), F.col("group_size").alias("x_count"))
    marked = _with_digest(shielded(docs, "doc_id", "text"), 256).drop("x_norm", "text")
    return unshielded(keep_first(marked, grouped, "x_digest", index.rows), docs.columns)


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def query(spark, sf_dir):
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
