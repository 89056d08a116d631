"""Text quality from an interpolated modified Kneser-Ney model over character n-grams.

The model is trained on all trusted text (labels of quality 1, less a fifth held out by a
hash of the id). Perplexity per character is thresholded for each language at a quantile
of the held-out trusted documents.

Counts and scores are joined in shards of the n-grams:
1. Documents are packed into blocks of BLOCK_CHARS characters (or one longer text) in a table
   bucketed by block.
2. Every block asks for its distinct n-grams, dealt by hash into shards, with their counts in
   trusted text. A shard adds up the counts of all blocks. Nothing is sampled or pruned, and
   an n-gram that every document holds is one entry a block.
3. The model is a chain of joins over the distinct n-grams: counts, continuation counts,
   contexts with their discounts, and the next lower order.
4. Each shard streams the blocks' questions past its part of the model; the answers join
   their blocks, which are not shuffled.

Defined results: null and empty texts have no perplexity and are not kept; null lang is a
language of its own; a language without held-out trusted documents takes the quantile of all
of them; without any, everything that has a perplexity is kept; without trusted text all
characters are equally likely; repeated rows are answered each; extra columns are
ignored by scores(); an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalpanel.llm.shared import bounded_batches, shared_dir, stage

ORDER = 4
BLOCK_CHARS = 1 << 23
SHARDS = 64
#: Of the held-out trusted documents of a language, this share is kept.
QUANTILE = 0.99
#: Stands before a text, ORDER - 1 times; not a character of any text.
PAD = 0x10FFFF
#: Characters whose codes are in memory at a time.
SLICE = 1 << 20

# Odd 64-bit multipliers of the rolling code, one for each place.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def _pack(data: bytes, level: int = 6) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def _unpack(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _planes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.dtype.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def points(text: str) -> np.ndarray:
    """Code points of a text with its padding."""
    return np.append(np.full(ORDER - 1, PAD, "<u4"), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))


def codes(padded: np.ndarray) -> np.ndarray:
    """A 64-bit code of the n-gram that ends at each character."""
    n = len(padded) - ORDER + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(ORDER):
        out += padded[k : k + n].astype(np.uint64) * MULTIPLIERS[k]
    return out


def _pack_documents(docs: DataFrame, buckets: int) -> str:
    """Step 1: a bucketed table (block, doc_ids, langs, sizes, texts). Returns its name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block() -> pd.DataFrame:
            data = [t.encode("utf-8") for *_, t in held]
            return pd.DataFrame({
                "block": [(task << 32) + k], "doc_ids": [[i for i, *_ in held]], "langs": [[x for _, x, _ in held]],
                "sizes": [[len(d) for d in data]], "texts": [_pack(b"".join(data))],
            })

        size = 0
        for batch in batches:
            for doc_id, lang, text in zip(batch["doc_id"], batch["lang"], batch["text"], strict=True):
                text = text or ""
                if held and size + len(text) > BLOCK_CHARS:
                    yield block()
                    held, size, k = [], 0, k + 1
                held.append((None if pd.isna(doc_id) else int(doc_id), lang, text))
                size += len(text)
        if held:
            yield block()

    spark = docs.sparkSession
    name = f"kn_blocks_{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    out = rows.mapInPandas(run, "block long, doc_ids array<long>, langs array<string>, sizes array<long>, texts binary")
    out.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/staged/{name}").option("compression", "uncompressed").format("parquet").saveAsTable(name)
    return name


def _texts(row) -> Iterator[str]:
    data, at = _unpack(row.texts), 0
    for n in row.sizes:
        yield data[at : at + n].decode("utf-8")
        at += n


def _groups(texts: Iterator[tuple[bool, str]]) -> Iterator[list[tuple[bool, np.ndarray]]]:
    """Padded pieces of texts with their marks, together about SLICE characters; pieces of a long text overlap by ORDER - 1."""
    held, size = [], 0
    for mark, text in texts:
        p = points(text)
        for a in range(0, max(1, len(p) - ORDER + 1), SLICE):
            piece = p[a : a + SLICE + ORDER - 1]
            held.append((mark, piece))
            size += len(piece)
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _distinct(group: list[tuple[bool, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, n-grams, counts in marked pieces) of the distinct n-grams of a group."""
    every = np.concatenate([codes(p) for _, p in group])
    ends = np.concatenate([np.arange(ORDER - 1, len(p)) + at for (_, p), at in zip(group, np.cumsum([0, *[len(p) for _, p in group[:-1]]]), strict=True)])
    marked = np.repeat([m for m, _ in group], [len(p) - ORDER + 1 for _, p in group])
    distinct, first = np.unique(every, return_index=True)
    n = np.bincount(np.searchsorted(distinct, every[marked]), minlength=len(distinct))
    joined, last = np.concatenate([p for _, p in group]), ends[first]
    grams = np.stack([joined[last - ORDER + 1 + k] for k in range(ORDER)], axis=1) if len(first) else np.zeros((0, ORDER), "<u4")
    return distinct, grams, n


def _questions(blocks: DataFrame, trusted: DataFrame, shards: int) -> DataFrame:
    """Step 2: (block, shard, grams, counts): the distinct n-grams of a block in order of their codes."""

    def run(key, documents: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        learn = set(flags["doc_id"].tolist())
        for row in documents.itertuples():
            found = [_distinct(group) for group in _groups((i in learn, t) for i, t in zip(row.doc_ids, _texts(row), strict=True))]
            every, first, inverse = np.unique(np.concatenate([f[0] for f in found]), return_index=True, return_inverse=True)
            n = np.bincount(inverse, np.concatenate([f[2] for f in found]), len(every)).astype(np.int64)
            grams, distinct = np.concatenate([f[1] for f in found])[first], every
            del found, inverse
            shard = (distinct % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                out.append((row.block, int(shard[part[0]]), _pack(b"".join(_planes(grams[part, k].astype("<u4")) for k in range(ORDER))), _pack(_planes(n[part].astype("<u4")))))
        return pd.DataFrame(out, columns=["block", "shard", "grams", "counts"])

    asked = blocks.groupBy("block").cogroup(trusted.groupBy("of_block")).applyInPandas(run, "block long, shard int, grams binary, counts binary")
    return stage(asked, "kn-questions", "none")


def _unpack_grams(blob: bytes) -> np.ndarray:
    data = _unpack(blob)
    size = len(data) // ORDER
    return np.stack([_from_planes(data[k * size : (k + 1) * size], "<u4") for k in range(ORDER)], axis=1)


def _gram_codes(grams: np.ndarray) -> np.ndarray:
    return (grams.astype(np.uint64) * MULTIPLIERS[:ORDER]).sum(axis=1, dtype=np.uint64)


def _totals(asked: DataFrame, shards: int) -> DataFrame:
    """(gram, n): all distinct n-grams with their counts in trusted text; equal n-grams of all blocks meet in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = np.zeros((0, ORDER), "<u4"), np.zeros(0, np.int64)

        def merge(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            distinct, first, inverse = np.unique(_gram_codes(grams), return_index=True, return_inverse=True)
            del distinct
            return grams[first], np.bincount(inverse, counts, len(first)).astype(np.int64)

        for batch in batches:
            parts = [_unpack_grams(b) for b in batch["grams"]]
            counts = [_from_planes(_unpack(b), "<u4").astype(np.int64) for b in batch["counts"]]
            if parts:
                held, n = merge(np.concatenate([held, *parts]), np.concatenate([n, *counts]))
        text = held.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
        yield pd.DataFrame({"gram": pd.Series(grams, dtype=object), "n": n})

    return stage(asked.select("shard", "grams", "counts").repartition(shards, "shard").mapInPandas(run, "gram string, n long"), "kn-totals")


def _discounts(table: DataFrame) -> list[float]:
    n = table.agg(*[F.coalesce(F.sum(F.expr(f"int(n = {k})")), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    if not n[0]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
    return [min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), raw, strict=True)]


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).when(n >= 3, d[2]).otherwise(0.0)


def probabilities(totals: DataFrame) -> DataFrame:
    """totals (gram, n) -> (gram, logp) of every n-gram asked for, seen in trusted text or not. Step 3."""
    levels = {ORDER: totals.filter("n > 0")}
    wanted = {ORDER: totals.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = stage(levels[k + 1].select(F.right("gram", F.lit(k)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "kn-level")
        wanted[k] = wanted[k + 1].select(F.right("gram", F.lit(k)).alias("gram")).distinct()
    known = levels[1].count()
    below = None
    for k in range(1, ORDER + 1):
        d = _discounts(levels[k])
        contexts = levels[k].groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("n").alias("all"), F.sum(_discount(F.col("n"), d)).alias("left"))
        rows = wanted[k].join(levels[k], "gram", "left").withColumn("context", F.substring("gram", 1, k - 1)).join(contexts, "context", "left")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / (known + 1)))
        else:
            rows = rows.withColumn("suffix", F.right("gram", F.lit(k - 1))).join(below, "suffix")
        seen = (F.coalesce("n", F.lit(0)) - _discount(F.coalesce("n", F.lit(0)), d)) / F.col("all")
        p = F.when(F.col("all").isNull(), F.col("lower")).otherwise(seen + F.col("left") / F.col("all") * F.col("lower"))
        table = stage(rows.select("gram", p.alias("p")), "kn-probabilities")
        below = table.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
    return table.select("gram", F.log("p").alias("logp"))


def _answers(asked: DataFrame, model: DataFrame, shards: int) -> DataFrame:
    """Step 4: (block, shard, logps); a shard's part of the model comes first, then the questions stream past it."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = np.frombuffer("".join(batch["gram"]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER)
            shard = (_gram_codes(grams) % np.uint64(shards)).astype(np.int64)
            logp = batch["logp"].to_numpy()
            for s in np.unique(shard):
                mine = shard == s
                yield pd.DataFrame({"shard": [s], "block": [-1], "grams": [_pack(b"".join(_planes(grams[mine, k]) for k in range(ORDER)), 1)], "logps": [_pack(_planes(logp[mine]), 1)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, known, values = None, np.zeros(0, np.uint64), np.zeros(0)
        parts: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples():
                if row.shard != of:
                    of, parts, known = row.shard, [], np.zeros(0, np.uint64)
                if row.block < 0:
                    parts.append((_gram_codes(_unpack_grams(row.grams)), _from_planes(_unpack(row.logps), "<f8")))
                    continue
                if parts:
                    known, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    order = np.argsort(known)
                    known, values, parts = known[order], values[order], []
                found = values[np.searchsorted(known, _gram_codes(_unpack_grams(row.grams)))]
                yield pd.DataFrame({"block": [row.block], "shard": [row.shard], "logps": [_pack(_planes(found.astype("<f4")))]})

    kind = "shard int, block long, grams binary, logps binary"
    both = model.mapInPandas(deal, kind).unionByName(asked.select("shard", "block", "grams", F.lit(None).cast("binary").alias("logps")))
    return both.repartition(shards, "shard").sortWithinPartitions("shard", "block").mapInPandas(run, "block long, shard int, logps binary")


def _scored(blocks: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """(doc_id, lang, n_chars, log_prob) of every document, block by block."""

    def run(key, documents: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        parts = {int(r.shard): _from_planes(_unpack(r.logps), "<f4").astype(np.float64) for r in found.itertuples()}
        out: list[tuple] = []
        for row in documents.itertuples():
            parts_of = [np.unique(np.concatenate([codes(p) for _, p in group])) for group in _groups((False, t) for t in _texts(row))]
            distinct = np.unique(np.concatenate(parts_of))
            shard = (distinct % np.uint64(shards)).astype(np.int64)
            logp = np.zeros(len(distinct))
            order = np.argsort(shard, kind="stable")
            logp[order] = np.concatenate([parts[s] for s in sorted(parts)]) if parts else 0.0
            sums, sizes = [], []
            for text in _texts(row):
                p = points(text)
                sizes.append(len(p) - ORDER + 1)
                sums.append(sum(float(logp[np.searchsorted(distinct, codes(p[a : a + SLICE + ORDER - 1]))].sum()) for a in range(0, sizes[-1], SLICE)))
            ids = [None if x is None or x != x else int(x) for x in row.doc_ids]
            out += zip(ids, row.langs, sizes, sums, strict=True)
        return pd.DataFrame(out, columns=["doc_id", "lang", "n_chars", "log_prob"], dtype=object)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, "doc_id long, lang string, n_chars long, log_prob double")


def _trusted(labels: DataFrame) -> DataFrame:
    """(doc_id, held_out) of documents all of whose labels say quality 1."""
    rows = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return rows.filter("quality >= 1").select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"))


def scores(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_chars, log_prob, perplexity, threshold, kept) for every row of docs."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(SHARDS, 2 * buckets)
    blocks = spark.table(_pack_documents(docs, buckets))
    trusted = stage(_trusted(labels), "kn-trusted")
    learn = blocks.select("block", F.explode("doc_ids").alias("doc_id")).join(trusted.filter("not held_out"), "doc_id").select(F.col("block").alias("of_block"), "doc_id")
    asked = _questions(blocks, learn, shards)
    model = probabilities(_totals(asked, shards))
    scored = _scored(blocks, _answers(asked, model, shards), shards)
    perplexity = F.when(F.col("n_chars") > 0, F.exp(-F.col("log_prob") / F.col("n_chars")))
    scored = stage(scored.withColumn("perplexity", perplexity), "kn-scores")
    held = scored.join(trusted.filter("held_out"), "doc_id").filter("perplexity is not null")
    at = F.percentile_approx("perplexity", quantile, 10_000)
    limits = held.groupBy(F.col("lang").alias("x_lang")).agg(at.alias("x_limit"))
    overall = held.agg(at.alias("t")).first()["t"]
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("x_lang")), "left")
    out = out.withColumn("threshold", F.coalesce("x_limit", F.lit(overall).cast("double")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_chars", "log_prob", "perplexity", "threshold", kept.alias("kept"))


def query(spark, sf_dir):
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
