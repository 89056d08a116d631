"""SimHash near-duplicates through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments, each a word of the perfect
(23, 12) Golay code padded with zeros. At most two bits differ between linked
fingerprints, so by the pigeonhole principle there is a segment without an error
whose successor (cyclically) has at most one. The key of a pair of segments is the
exact first segment with a codeword index of the second: one side gives the index of
the nearest codeword (at distance 3 at most), the other the indices of all codewords
up to distance 4 (one or six). Fingerprints one bit apart in that segment
therefore always share a key. Sharers are joined and verified on all 64 bits.

A key held by so many fingerprints that joining them would cost more than naming
all their one-bit neighbours goes another, equally exact way: two fingerprints are
within two bits if and only if their one-bit neighbourhoods meet, so members are
grouped by the neighbours they name (65 each).

Defined results: null and empty texts have fingerprint zero and link like any
other; texts of fewer words than a shingle are one shingle; equal rows share a
component; null doc_ids never name a component unless it has no other; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalpanel.llm.components import components
from tidalpanel.llm.shared import bounded_batches, heavy_join, keep_first, shielded, shingle_hashes, stage, unshielded

#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0xC75
#: Neighbours that a fingerprint names on the other way: itself and 64.
NEIGHBOURS = 65


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first: byte histograms times the bits of a byte."""
    planes = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8) + _PLANE
    seen = np.bincount(planes.ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BYTE_BITS).ravel()


_PLANE = np.arange(8, dtype=np.int64) * 256
_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: str | None, width: int) -> int:
    """Bit k is 1 if it is set in over half the shingles' XXH64 (seed 42); unsigned."""
    return majority(shingle_hashes(text, width))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes that come in parts."""
    n, counts = 0, np.zeros(64, np.int64)
    for hashes in parts:
        n += len(hashes)
        counts += _bit_counts(hashes)
    return int(((2 * counts > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, width: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, fp) with fp as a signed long, one row a document."""

    return docs.select(key, _fingerprint_udf(docs.sparkSession, width)("text").alias("fp"))


def _fingerprint_udf(spark, width: int):
    bounded_batches(spark)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return of


def _golay_errors() -> np.ndarray:
    """Row s: the error patterns up to weight 4 with syndrome s, lightest first, -1 where there are no more."""
    patterns = [[0]]
    for _ in range(4):
        patterns.append(sorted({p | 1 << k for p in patterns[-1] for k in range(23) if not p >> k & 1}))
    table = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight, group in enumerate(patterns):
        errors = np.array(group, np.int64)
        for error, s in zip(errors, _syndrome(errors), strict=True):
            if weight < 4 or filled[s] < 6:
                table[s, filled[s]] = error
                filled[s] += 1
    return table


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for k in range(22, 10, -1):
        rest ^= np.where(rest >> k & 1, GENERATOR << (k - 11), 0)
    return rest


def golay_keys(fps: np.ndarray, errors: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): with every, keys of all codewords up to distance 4, else of the nearest."""
    words = fps.astype(np.int64, copy=False).view(np.uint64)
    cut = [((words >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for j in range(3):
        near = cut[(j + 1) % 3]
        found = errors[_syndrome(near)]
        if not every:
            found = found[:, :1]
        row, slot = np.nonzero(found >= 0)
        index = (near[row] ^ found[row, slot]) >> 11
        rows.append(row)
        keys.append((np.int64(j) << 34) | (cut[j][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keys(fps: DataFrame) -> DataFrame:
    """(key, fp, exact): exact rows hold the nearest codeword's key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        errors = _golay_errors()
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            for every in (False, True):
                row, key = golay_keys(fp, errors, every)
                yield pd.DataFrame({"key": key, "fp": fp[row], "exact": not every})

    return fps.select("fp").mapInPandas(run, "key long, fp long, exact boolean")


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints within `distance` (at most 2) bits that the
    star or join ways name; their connected components are those of all such pairs."""
    if not 0 <= distance <= 2:
        raise ValueError("the keys are proven for at most two differing bits")
    keys = stage(_keys(fps), "simhash-keys")
    sizes = keys.groupBy("key").agg(F.sum(F.expr("int(exact)")).alias("l"), F.sum(F.expr("int(not exact)")).alias("r"))
    crowded = stage(sizes.filter(f"l * r > {NEIGHBOURS} * (l + r)").select("key"), "simhash-crowded")
    some = not crowded.isEmpty()
    usual = keys.join(crowded, "key", "left_anti") if some else keys
    left = usual.filter("exact").select("key", F.col("fp").alias("a"))
    right = usual.filter("not exact").select("key", F.col("fp").alias("b"))
    out = left.join(right, "key").filter(f"a <> b and bit_count(a ^ b) <= {distance}").select("a", "b")
    if some:
        members = keys.join(crowded, "key", "left_semi").select("fp").distinct()
        out = out.unionByName(_neighbour_links(members, distance))
    return out


def _neighbour_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links between fingerprints whose one-bit neighbourhoods meet; a neighbour is named by at most 65."""
    near = F.expr("concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k)))")
    met = fps.select("fp", F.explode(near).alias("point")).groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("met"))
    pairs = met.filter("size(met) > 1").select(F.element_at("met", 1).alias("a"), F.explode("met").alias("b"))
    if distance < 2:
        pairs = met.select(F.explode("met").alias("a"), "met").select("a", F.explode("met").alias("b"))
    return pairs.filter(f"a <> b and bit_count(a ^ b) <= {distance}")


def groups(docs: DataFrame, width: int = 5, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    prints = stage(fingerprints(docs, width), "simhash-prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    found = components(links(classes, distance))
    named = classes.join(found, classes.fp == found.node, "left").select(classes.fp, "least", "n", F.coalesce("root", classes.fp).alias("root"))
    named = stage(named, "simhash-classes")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(roots, "root").select("fp", "n", "component_id")
    return heavy_join(prints, of_class, "fp", "n", prints.count()).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, width: int = 5, distance: int = 2, similarity: float | None = None) -> DataFrame:
    """docs with one document of each component: that with the smallest id (of repeated
    rows one). Only rows of fingerprints that are shared or linked meet in a shuffle;
    a bounded filter lets the others pass with their whole texts.

    With similarity 0.8, texts are linked by that similarity of their sets of shingles (near_dedup): the pairs that the
    fingerprints' keys find are verified on whole sets, and as two fingerprints differ in about ten
    bits then, which no number of Golay segments can promise to find, a prefix join finds the rest."""
    if similarity is not None:
        from tidalpanel.llm import near_dedup

        if similarity != near_dedup.SIMILARITY:
            raise ValueError(f"the prefix join is made for a similarity of {near_dedup.SIMILARITY}")
        return near_dedup.deduplicate(docs, width)
    marked = shielded(docs, "doc_id", "text").withColumn("x_fp", _fingerprint_udf(docs.sparkSession, width)("text")).drop("text")
    prints = stage(marked.select("doc_id", "x_fp"), "simhash-prints").withColumnRenamed("x_fp", "fp")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    found = components(links(classes, distance))
    named = classes.join(found, classes.fp == found.node, "left").select("fp", "least", "n", "node", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "simhash-classes")
    roots = named.groupBy("root").agg(F.min("least").alias("keep_id"), F.sum("n").alias("size"))
    grouped = stage(named.join(roots.filter("size > 1"), "root").select(F.col("fp").alias("x_fp"), F.col("root").alias("x_root"), F.col("keep_id").alias("x_keep"), F.col("n").alias("x_count")), "simhash-grouped")
    return unshielded(keep_first(marked, grouped, "x_fp", prints.count()), docs.columns)


def query(spark, sf_dir):
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
