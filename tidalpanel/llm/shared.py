"""What the operators of this package share: staged tables and bounded membership filters."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of the driver's heap in use from which a staged table has its garbage collected.
HEAP_SHARE = 0.3
#: Used only where a session on one machine names no folder, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/tidalpanel"
#: A key with more than one in so many of all rows is heavy; so there are fewer than so many heavy keys.
HEAVY = 1000
#: Bits of the filter behind keep_first(): at most 2**18 words of 64.
KEEP_BITS = 24
#: Rows and bytes of the Arrow batches that carry texts to Python.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20
#: Rows that a Parquet reader holds at once: a vector of long texts is one large array.
READ_ROWS = 512
#: White space of the text contracts, as a Java and RE2 character class.
SPACE = r"\x20\x09-\x0D"
#: Seed of XXH64.
SEED = 42
#: Shingles hashed at a time, so that a very long text needs bounded memory.
CHUNK = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or LOCAL_CHECKPOINTS).rstrip("/")


def stage(df: DataFrame, name: str, compression: str | None = None, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    runtime = spark._jvm.java.lang.Runtime.getRuntime()  # noqa: SLF001
    if runtime.totalMemory() - runtime.freeMemory() > HEAP_SHARE * runtime.maxMemory():
        collected(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path  # noqa: SLF001
    return back


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        path = getattr(df, "_staged_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)  # noqa: SLF001


def sweep(spark: SparkSession) -> None:
    """Delete everything staged; only when no result that reads it is still needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged")  # noqa: SLF001
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def collected(spark: SparkSession) -> None:
    """Have the driver collect its garbage. Broadcasts, shuffle files and plans of many small queries stay until it does, on executors
    too; a driver that has room left puts it off. What its hundreds of threads and its compilers have freed beside the heap
    goes back to the system, where the JVM has a command for it (17 and later, on Linux)."""
    gc.collect()
    jvm = spark._jvm  # noqa: SLF001
    jvm.System.gc()
    # by reflection: the server's own class is not open to py4j
    run = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # noqa: SLF001
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        run.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # another JVM
        pass


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches and Parquet vectors to what a worker can hold of long texts; never raises them.

    Plans read the settings when they run, so they stay set."""
    for name, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
        ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS),
    ):
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def released(run: Callable) -> Callable:
    """A function on an iterator of batches, for a Python worker that lives on: at its end the memory it used goes back
    to the system, so that the workers beside a full heap hold what they need only."""

    @functools.wraps(run)
    def wrapped(*args):
        yield from run(*args)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles in order, repeats included, unsigned, by chunks; a text of fewer words is one shingle, one of none has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    width = min(width, len(words))
    n = len(words) - width + 1
    for at in range(0, n, CHUNK):
        m = min(CHUNK, n - at)
        parts = [words[at + k : at + k + m] for k in range(width)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*parts, strict=True)), repeat(SEED)), np.uint64, m)


def shielded(docs: DataFrame, *needed: str) -> DataFrame:
    """All columns of docs as k_<name>, out of the way of an operator's own names, and those it reads under theirs."""
    return docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in docs.columns], *needed)


def unshielded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`k_{c}`").alias(c) for c in names])


def heavy_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with table, which has one row a key and in `count` how many of all `total` rows have it.

    Heavy keys, fewer than HEAVY, are broadcast and leave their rows where they are; no other key
    brings more than one in HEAVY of the rows to a task."""
    heavy = table.filter(F.col(count) * HEAVY > total)
    marked = rows.join(F.broadcast(heavy.select(key, F.struct(*[c for c in table.columns if c != key]).alias("h_found"))), key, "left")
    light = marked.filter("h_found is null").drop("h_found").join(table.filter(F.col(count) * HEAVY <= total), key)
    names = light.columns
    some = marked.filter("h_found is not null").select(*rows.columns, *[F.col(f"h_found.{c}").alias(c) for c in table.columns if c != key])
    return light.unionByName(some.select(*names))


def filter_bits(keys: int, most: int) -> int:
    """Bits for about one key in 16 slots, as far as `most` allows."""
    return min(most, max(10, (16 * max(1, keys)).bit_length()))


def filter_words(keys: DataFrame, hash_column: Column, bits: int) -> DataFrame:
    """A one-hash membership filter of 2**bits bits as rows (f_word, f_bits); at most 2**(bits - 6) rows."""
    slot = F.shiftrightunsigned(hash_column, 64 - bits)
    return (
        keys.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("f_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("f_bits"))
    )


def filter_array(keys: DataFrame, hash_column: Column, bits: int) -> np.ndarray:
    """The filter of filter_words() as an array of 2**(bits - 6) unsigned words, for use in Python workers."""
    out = np.zeros(1 << (bits - 6), np.uint64)
    for row in filter_words(keys, hash_column, bits).collect():
        out[row["f_word"]] = row["f_bits"] & (2**64 - 1)
    return out


def maybe_member(df: DataFrame, filter_: DataFrame, hash_column: Column, bits: int, keep_rest: bool = False) -> DataFrame:
    """Rows of df that the filter may hold; with keep_rest all rows, marked by f_hit. The filter is broadcast: its size is bounded by bits."""
    slot = F.shiftrightunsigned(hash_column, 64 - bits)
    out = df.withColumn("f_slot", slot).withColumn("f_word", F.shiftright("f_slot", 6))
    out = out.join(F.broadcast(filter_), "f_word", "left" if keep_rest else "inner")
    hit = F.coalesce(F.expr("(shiftrightunsigned(f_bits, cast(f_slot & 63 as int)) & 1) = 1"), F.lit(False))
    if keep_rest:
        return out.withColumn("f_hit", hit).drop("f_slot", "f_word", "f_bits")
    return out.filter(hit).drop("f_slot", "f_word", "f_bits")


def keep_first(marked: DataFrame, grouped: DataFrame, key: str, total: int) -> DataFrame:
    """Of the rows of each group one: that whose doc_id is the group's x_keep (of repeats one); rows of no group all stay.

    marked has doc_id and key; grouped, staged, has a row for each key of a group: key, x_root, x_keep and x_count, how
    many of all `total` rows have it. Rows that a bounded filter shows to be in no group are not moved, nor are the rows of
    heavy keys, but for the one that stays."""
    bits = filter_bits(grouped.count(), KEEP_BITS)
    words = stage(filter_words(grouped, F.xxhash64(key), bits), "keep-filter")
    split = maybe_member(marked, words, F.xxhash64(key), bits, keep_rest=True)
    heavy = grouped.filter(F.col("x_count") * HEAVY > total).select(key, F.col("x_keep").alias("h_keep"), F.lit(True).alias("h_group"))
    near = split.filter("f_hit").join(F.broadcast(heavy), key, "left").filter("h_group is null or h_keep <=> doc_id").drop("h_keep", "h_group")
    met = near.join(grouped, key, "left")
    single = met.filter("x_root is null")
    first = met.filter("x_root is not null and x_keep <=> doc_id").dropDuplicates(["x_root"])
    out = split.filter("not f_hit").drop("f_hit")
    return out.unionByName(single.select(out.columns)).unionByName(first.select(out.columns))
