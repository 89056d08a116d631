"""Near-duplicates by SimHash candidates and exact Jaccard similarity of word shingles, without a missed pair.

Texts are sets of shingles (XXH64 of five words in lower case) and have a SimHash fingerprint of the same shingles. Fingerprints
that are equal or that Golay keys find within two bits (simhash.links) make the first candidates. At a similarity of 4/5 two
fingerprints differ in about ten bits, which such keys cannot promise to find; the other candidates come from the sets. Of all
candidates those of the fewest differing bits are verified first. Two sets of similarity 4/5
share at least 4/5 of the larger one, so in any common order of all shingles they share one of
the first n - ceil(4n/5) + 1 of each (prefix filter). Pairs that share such a key, and whose
sizes, positions and sketches (the parity of each of 1024 buckets, which bounds the difference of two
sets from below) still allow the similarity, are verified on whole sets. Any order of keys will do: shingles that a fixed share of the documents finds common go last, so a passage
that many texts hold makes few pairs, however many texts there are. The sample sets the order only, not the result.

A key with more than CROWDED holders first pairs each holder with one of them, that which the bounds
let match most others, so it stands nearest to what the holders share. Holders that no holder of the key can match, by
the bounds, drop out. Of the pairs found so far one of each set is verified, and the links make components. Then, for a
few turns, holders of a crowded key meet another one of them, drawn anew, and of the pairs between two components that with
the nearest sketches is verified: families of near copies become one component in about as many pairs as sets. At last only pairs
between components are left to verify, and holders of a crowded key that are not in its largest component are paired
with those of the key's holders of like size in other components that the bounds and sketches allow, each pair at the first crowded
key that both hold. So no link between components is missed, and large groups of copies need no squares.

Defined results: null and empty texts are one empty set and are copies of each other; texts of
fewer words than a shingle are one shingle; a component keeps its smallest id (of repeated
rows one); null ids never name a component unless it has no other. Sets and texts are known by
64-bit hashes, which fail for one of about 10**5 corpora of 15 million documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalpanel.llm import simhash
from tidalpanel.llm.components import components
from tidalpanel.llm.shared import SEED, bounded_batches, collected, discard, filter_array, filter_words, heavy_join, keep_first, maybe_member, released, shielded, shingle_hashes, stage, unshielded

#: The Jaccard similarity that links two texts: 4/5, on which all bounds below rest.
SIMILARITY = 0.8
#: Holders of a key that are all paired with each other at once.
CROWDED = 48
#: Turns at most in which one pair of each two components is verified; a turn that finds at most one in WORTH of the first links is the last.
TURNS = 4
WORTH = 10
#: Crowded keys of a set that tell where a pair has met before.
FIRST_KEYS = 16
#: Share of the documents sampled for common shingles, documents sampled at least (about), and the holders in the sample that put a shingle later.
SHARE = 1 / 8
SAMPLE = 8_000
COMMON = (3, 24)
#: Buckets of a sketch, a multiple of 64.
BUCKETS = 1024
#: Bits of the filters that spare keys and texts a shuffle: at most 2**17 words.
FILTER_BITS = 23


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted; unsigned."""
    return _distinct(shingle_hashes(text, width))


def _distinct(hashes: Iterable[np.ndarray]) -> np.ndarray:
    found = [np.unique(part) for part in hashes]
    if not found:
        return np.empty(0, np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _sets(spark, width: int):
    bounded_batches(spark)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t, width).view(np.int64) for t in texts])

    run = released(run)

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    return of


def _common(texts: DataFrame, width: int) -> list[np.ndarray]:
    """Filters of the shingles that several sampled documents hold, one for each number in COMMON: bits by a shingle's first FILTER_BITS.

    Their size is bounded; a shingle that a full filter takes for common is put later in all texts alike."""
    share = min(1.0, max(SHARE, SAMPLE / max(1, texts.count())))
    sample = texts.filter(F.pmod("t", F.lit(1 << 20)) < int((1 << 20) * share))
    held = sample.select(F.explode(_sets(texts.sparkSession, width)("text")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    held = stage(held.filter(f"n >= {min(COMMON)}"), "near-common")
    filters = [filter_array(held.filter(f"n >= {least}"), F.col("s"), FILTER_BITS) for least in COMMON]
    discard(held)
    return filters


def _late(found: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    """How many of the filters hold each shingle."""
    slot = found >> np.uint64(64 - FILTER_BITS)
    word, bit = (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)
    late = np.zeros(len(found), np.int8)
    for bits in filters:
        late += (bits[word] >> bit & np.uint64(1)).astype(np.int8)
    return late


def _prints(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, t, c, n, fp, prefix, sketch): t stands for the text, c for its set of n shingles, fp is its SimHash fingerprint."""
    spark = texts.sparkSession
    common = spark.sparkContext.broadcast(_common(texts, width))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for column in batches:
            rows = []
            for text in column:
                hashes = list(shingle_hashes(text, width))
                found = _distinct(hashes)
                first = found[np.argsort(_late(found, common.value), kind="stable")][: len(found) - -(-4 * len(found) // 5) + 1]
                odd = np.bincount((found % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) & 1
                c = np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64)
                fp = np.uint64(simhash.majority(hashes)).astype(np.int64)
                rows.append((c, len(found), fp, first.view(np.int64), np.packbits(odd.astype(bool)).view(np.int64)))
            yield pd.DataFrame(rows, columns=["c", "n", "fp", "prefix", "sketch"]).astype({"c": np.int64, "n": np.int32, "fp": np.int64})

    run = released(run)

    @F.pandas_udf("c long, n int, fp long, prefix array<long>, sketch array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(batches)

    return stage(texts.select("doc_id", "t", of("text").alias("x")).select("doc_id", "t", "x.*"), "near-prints")


def _may_match(a: str, b: str) -> Column:
    """Sizes and positions allow the similarity, if this is the first key that the two share."""
    return F.expr(f"9L * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= 4L * ({a}.n + {b}.n)")


def _sketches_apart(a: str, b: str) -> str:
    """In how many buckets two sketches differ; word by word, so that it compiles."""
    return "(" + " + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(BUCKETS // 64)) + ")"


def _sketches_allow(a: str, b: str, sizes: str) -> Column:
    """The sketches differ in so few buckets that the sets may be similar."""
    return F.expr(f"9 * {_sketches_apart(a, b)} <= {sizes}")


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches still allow the similarity, with the bits in which their fingerprints differ and how far their sketches are apart, written."""
    left, right = (classes.select(F.col("c").alias(k), *[F.col(x).alias(x + k) for x in ("n", "fp", "sketch")]) for k in "ab")
    met = pairs.join(left, "a").join(right, "b").filter(_sketches_allow("sketcha", "sketchb", "na + nb"))
    far = F.expr(f"{_sketches_apart('sketcha', 'sketchb')} / greatest(na + nb, 1)")
    return stage(met.select("a", "b", F.expr("bit_count(fpa ^ fpb)").alias("bits"), far.alias("far")), "near-alike")


def _simhash_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints are equal, or within two bits as Golay keys find them; of equal fingerprints one set stands for all."""
    first = stage(classes.groupBy("fp").agg(F.min("c").alias("first"), F.max("c").alias("last")), "near-fingerprints")
    equal = classes.join(first.filter("first <> last"), "fp").filter("c <> first").select(F.col("first").alias("a"), F.col("c").alias("b"))
    left, right = (first.select(F.col("fp").alias(k), F.col("first").alias("f" + k)) for k in "ab")
    near = simhash.links(first.select("fp")).join(left, "a").join(right, "b")
    return equal.unionByName(near.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")))


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of each set's pairs one: at most as many pairs as sets, that of the fewest differing bits of the fingerprints."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "bits"))
    least = both.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("x")).select("a", "x.b")
    return least.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().toDF("a", "b")


def _between(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, far, ra, rb) between each two components ra and rb that whose sketches are nearest."""
    near = pairs.groupBy(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")).agg(F.min(F.struct("far", "a", "b")).alias("p"))
    return near.select("p.a", "p.b").distinct()


def _star(placed: DataFrame, total: int, turn: int) -> DataFrame:
    """(a, b, far, ra, rb): holders of a crowded key with one of like size in another component, where bounds and sketches
    allow; at most a pair a holder. Every turn draws others: even turns from all holders, odd ones from all components."""
    drawn = [F.xxhash64("c", F.lit(turn)).alias("h")]
    if turn % 2:
        drawn.insert(0, F.xxhash64("root", F.lit(turn)).alias("g"))
    pivots = placed.groupBy("g").agg(F.max(F.struct(*drawn, "c", "n", "pos", "root", "sketch")).alias("y"), F.count(F.lit(1)).alias("holders"), F.min("root").alias("l"), F.max("root").alias("m"))
    pivots = stage(pivots.filter("l <> m").drop("l", "m"), "near-pivots")
    met = heavy_join(placed, pivots, "g", "holders", total).filter("root <> y.root").withColumn("x", F.struct("c", "n", "pos", "root", "sketch"))
    met = met.filter(_may_match("x", "y")).filter(_sketches_allow("x.sketch", "y.sketch", "x.n + y.n"))
    far = F.expr(f"{_sketches_apart('x.sketch', 'y.sketch')} / greatest(x.n + y.n, 1)")
    return met.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"), far.alias("far"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb"))


def _halves_allow(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the upper halves of the hashes allow: what two sets share of these, and the most that shared hashes
    may have lost by equal halves, is no less than what the sets share. Pairs that fail move half the bytes."""
    half = sets.select("c", F.size("s").alias("n"), F.expr("array_distinct(transform(s, x -> int(shiftright(x, 32))))").alias("h"))
    left, right = (half.select(F.col("c").alias(k), F.col("n").alias("n" + k), F.col("h").alias("h" + k)) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.expr("size(array_intersect(ha, hb)) + least(na - size(ha), nb - size(hb))"))
    return stage(both.filter("9L * i >= 4L * (na + nb)").select("a", "b"), "near-halves")


def _whole_sets(nodes: DataFrame, texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(c, s) for every set c of nodes, written."""
    wanted = stage(classes.join(nodes, "c").select("c", "t"), "near-wanted")
    words = stage(filter_words(wanted, F.xxhash64("t"), FILTER_BITS), "near-filter")
    some = maybe_member(texts, words, F.xxhash64("t"), FILTER_BITS).join(wanted, "t").dropDuplicates(["c"])
    sets = stage(some.select("c", _sets(texts.sparkSession, width)("text").alias("s")), "near-sets")
    discard(wanted, words)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, few_hold: bool = False) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is at least 4/5; few_hold: most are expected to fail."""
    words = stage(filter_words(pairs.select(F.explode(F.array("a", "b")).alias("c")), F.xxhash64("c"), FILTER_BITS), "near-filter")
    sets = maybe_member(sets, words, F.xxhash64("c"), FILTER_BITS)
    if few_hold:
        pairs = _halves_allow(pairs, sets)
    left, right = sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), sets.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    out = stage(both.filter("9L * i >= 4L * (size(sa) + size(sb))").select("a", "b"), "near-links")
    discard(words)
    return out


def _links(prints: DataFrame, texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame | None]:
    """(a, b): sets whose components are those of all pairs of sets of similarity 4/5 or more; and those components (node, root), where known."""
    spark = texts.sparkSession
    least = prints.groupBy("c").agg(F.min("t").alias("t"), F.max("t").alias("most"), *[F.first(x).alias(x) for x in ("n", "sketch")], F.min("fp").alias("fp"))
    classes = stage(least, "near-classes")
    # of several texts with one set, one names the keys
    others = prints.select("c", "t").join(classes.filter("t <> most").select("c", F.col("t").alias("first")), "c").filter("t <> first").select("t")
    keys = prints.join(stage(others, "near-others"), "t", "left_anti").select("c", "n", F.posexplode("prefix").alias("pos", "key"))
    sizes = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "near-sizes")
    words = stage(filter_words(sizes, F.xxhash64("key"), FILTER_BITS), "near-filter")
    held = stage(maybe_member(keys, words, F.xxhash64("key"), FILTER_BITS).join(sizes, "key"), "near-keys")

    def pairs(x: DataFrame, y: DataFrame, also: Column, *last: Column) -> DataFrame:
        on = ["key", "size"] if "size" in y.columns else ["key"]
        met = x.alias("x").join(y.alias("y"), on).filter(functools.reduce(Column.__and__, [also, _may_match("x", "y"), *last]))
        return met.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"))

    few = held.filter(f"m <= {CROWDED}").drop("m")
    usual = pairs(few, few, F.expr("x.c < y.c"))
    crowded = held.filter(f"m > {CROWDED}").withColumn("room", F.expr("9L * (n - pos) - 4L * n"))
    pivots = crowded.groupBy("key").agg(
        F.max(F.struct("room", F.xxhash64("c").alias("h"), "c", "n", "pos")).alias("pivot"), F.min("n").alias("n_min"), F.count(F.lit(1)).alias("holders")
    )
    total = held.count()
    crowded = heavy_join(crowded, pivots, "key", "holders", total).filter("9L * (n - pos) >= 4L * (n + n_min) and pivot.room >= 4L * n").drop("m", "room", "n_min")
    crowded = stage(crowded, "near-crowded")
    star = crowded.filter("c <> pivot.c and 9L * least(n - pos, pivot.n - pivot.pos) >= 4L * (n + pivot.n)")
    star = star.select(F.least("c", "pivot.c").alias("a"), F.greatest("c", "pivot.c").alias("b"))
    collected(spark)
    # first one pair of each set: most copies are then in one component, and only pairs between components are left
    alike = _alike(_simhash_pairs(classes).unionByName(usual).unionByName(star).distinct(), classes)
    discard(held, sizes, words)
    collected(spark)
    sets = _whole_sets(alike.select(F.explode(F.array("a", "b")).alias("c")).unionByName(crowded.select("c")).distinct(), texts, classes, width)
    tried = stage(_nearest(alike.drop("far")), "near-first")
    links = _verified(tried, sets)
    found, first = stage(components(links), "near-found"), links.count()

    def stars() -> DataFrame:
        """Links enough for the components found so far."""
        return found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))

    def rooted(rows: DataFrame, column: str, name: str) -> DataFrame:
        heads = found.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
        return rows.join(heads, F.col(column) == F.col("head"), "left").withColumn(name, F.coalesce("head_root", column)).drop("head", "head_root")

    def open_pairs() -> DataFrame:
        return rooted(rooted(alike.join(tried, ["a", "b"], "left_anti"), "a", "ra"), "b", "rb").filter("ra <> rb").select("a", "b", "far", "ra", "rb")

    some = not crowded.isEmpty()
    # sizes of similar sets differ by a quarter at most, so their classes by one
    size = F.floor(F.log("n") / float(np.log(1.25))).cast("int").alias("size")
    sketched = stage(crowded.drop("pivot", "holders").join(classes.select("c", "sketch"), "c").select("key", "c", "n", "pos", "sketch", size, F.xxhash64("key", size).alias("g")), "near-sketched")
    holders = sketched.count()
    # then, in turns, one pair of each two components, so that what still holds is found in about as many pairs as sets
    for turn in range(TURNS):
        collected(spark)
        met = open_pairs()
        if some:
            placed = stage(rooted(sketched, "c", "root"), "near-placed")
            met = met.unionByName(_star(placed, holders, turn).join(tried, ["a", "b"], "left_anti"))
        chosen = stage(_between(met), "near-turn")
        more = _verified(chosen, sets)
        tried, many = tried.unionByName(chosen), more.count()
        if many:
            found = stage(components(stars().unionByName(more)), "near-found")
        if many * WORTH <= first:
            break
    collected(spark)
    left = open_pairs().select("a", "b")
    if some:
        # a pair meets at the first crowded key that both hold, as far as FIRST_KEYS tell
        earlier = sketched.groupBy("c").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "key"))), 1, FIRST_KEYS).alias("firsts"))
        placed = rooted(sketched.drop("g"), "c", "root").join(earlier, "c").withColumn("before", F.expr("transform(filter(firsts, f -> f.pos < pos), f -> f.key)"))
        placed = stage(placed.drop("firsts"), "near-placed")
        # holders of the key's largest component need not meet each other
        most = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("holders"), F.count(F.lit(1)).alias("parts"))
        most = stage(most.filter("parts > 1").drop("parts"), "near-most")
        placed = stage(heavy_join(placed, most, "key", "holders", holders).withColumn("apart", F.expr("root <> most.root")).drop("most", "holders"), "near-apart")
        beside = placed.filter("apart").withColumn("size", F.explode(F.expr("array(size - 1, size, size + 1)")))
        allow = _sketches_allow("x.sketch", "y.sketch", "x.n + y.n")
        rest = pairs(beside, placed, F.expr("x.root <> y.root and (x.c < y.c or not y.apart)"), allow, F.expr("not arrays_overlap(x.before, y.before)")).distinct()
        left = left.unionByName(rest.join(tried.unionByName(alike.select("a", "b")), ["a", "b"], "left_anti"))
    left = stage(left, "near-left")
    discard(crowded, alike, sketched)
    more = _verified(left, sets, few_hold=True)
    discard(sets)
    return (stars(), found) if more.isEmpty() else (stars().unionByName(more), None)


def deduplicate(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs with one document of each component of texts whose similarity is at least 4/5: that with
    the smallest id (of repeated rows one). Only rows of components of several meet in a
    shuffle; a bounded filter lets the others pass with their whole texts."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    prints = _prints(texts, width)
    collected(docs.sparkSession)
    links, found = _links(prints, texts.select("text", "t"), width)
    found = components(links) if found is None else found
    named = prints.select("doc_id", "t", "c").join(found, F.col("c") == F.col("node"), "left").select("doc_id", "t", F.coalesce("root", "c").alias("x_root"))
    collected(docs.sparkSession)
    named = stage(named.groupBy("t", "x_root").agg(F.min("doc_id").alias("x_keep"), F.count(F.lit(1)).alias("x_count")), "near-named")
    roots = named.groupBy("x_root").agg(F.min("x_keep").alias("x_keep"), F.sum("x_count").alias("size")).filter("size > 1").drop("size")
    grouped = stage(named.drop("x_keep").join(roots, "x_root").select(F.col("t").alias("x_t"), "x_root", "x_keep", "x_count"), "near-grouped")
    marked = shielded(docs, "doc_id").withColumn("x_t", F.xxhash64("k_text"))
    return unshielded(keep_first(marked, grouped, "x_t", prints.count()), docs.columns)
