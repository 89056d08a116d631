"""Byte-level BPE over a corpus: every distinct word is encoded once.

1. Blocks of documents (BLOCK_CHARS characters or one longer text) are cut into
   pre-tokens. A block keeps its distinct words, numbered by frequency, and each document's
   sequence of numbers: its exploded (position, word) rows, packed. Words are
   dealt by hash into shards; a row holds one block's words of one shard.
2. The shards are shuffled: equal words of all blocks meet in one task, which encodes each
   once and answers every block with the ids, in the order of the words asked.
3. The answers join their block's documents, which wait in a bucketed table, so they
   are not shuffled at all, and the ids are put together by position.

What is shuffled is the distinct words of each block, there and back, not the tokens. A
word that every document holds is one entry a block, however hot. A task holds one block,
or one row of a shard and a bounded memo.

Decoding joins ids with the token-byte table (its size is the vocabulary's).

Defined results: null text is empty and gives no ids; repeated rows are encoded
each; null doc_ids pass through; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidalpanel.llm.shared import bounded_batches, released, shared_dir

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_CHARS = 1 << 23
#: Least number of shards of the words.
SHARDS = 64
#: Distinct words that a shard's task remembers; a word is encoded anew only after so many others.
MEMO_WORDS = 250_000

#: Makes rows of the ids of a block's documents, in their order.
Consumer = Callable[[Iterator[np.ndarray]], pd.DataFrame]
_encoders: dict = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _table(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def _encoder(raw: bytes, pattern: str):
    """The tiktoken encoder of a rank file; one for each worker process."""
    import tiktoken

    key = (zlib.crc32(raw), pattern)
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_table(raw), special_tokens={})
    return _encoders[key]


def pack_arrays(*parts: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(parts), *[p.nbytes for p in parts]], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(p.tobytes() for p in parts))


def unpack_arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", n, 8)
    starts = 8 + 8 * n + np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(data, k, int(s) // np.dtype(k).itemsize, int(at)) for k, s, at in zip(kinds, sizes, starts, strict=False)]


def _blocks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
            text = text or ""
            if texts and size + len(text) > most:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(None if doc_id is None or doc_id != doc_id else int(doc_id))
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts


def _cut(spark: SparkSession, docs: DataFrame, pattern: str, shards: int, buckets: int, block_chars: int) -> str:
    """Step 1. A bucketed table (block, shard, words, doc_id, sequence); shard -1 marks documents. Returns its name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        task = TaskContext.get()
        for k, (ids, texts) in enumerate(_blocks(batches, block_chars)):
            block = (task.partitionId() << 32) + k
            number: dict[str, int] = {}
            cut = [np.fromiter((number.setdefault(w, len(number)) for w in find(t)), np.int32) for t in texts]
            del texts
            words = [w.encode() for w in number]
            del number
            seen = np.zeros(len(words), np.int64)
            for c in cut:
                np.add.at(seen, c, 1)
            shard = np.fromiter((zlib.crc32(w) % shards for w in words), np.int64, len(words))
            # numbers by frequency pack well; a shard's words keep that order
            order = np.argsort(-seen, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            sequences = [pack_arrays(planes(place[c])) for c in cut]
            yield pd.DataFrame({"block": block, "shard": -1, "words": None, "doc_id": pd.array(ids, "Int64"), "sequence": sequences})
            by_shard = order[np.argsort(shard[order], kind="stable")]
            rows = []
            for mine in np.split(by_shard, np.flatnonzero(np.diff(shard[by_shard])) + 1) if words else []:
                chosen = [words[j] for j in mine]
                lengths = np.fromiter(map(len, chosen), np.int64, len(chosen))
                rows.append((block, int(shard[mine[0]]), pack_arrays(planes(lengths), planes(np.diff(place[mine], prepend=0)), np.frombuffer(b"".join(chosen), np.uint8)), None, None))
            yield pd.DataFrame(rows, columns=["block", "shard", "words", "doc_id", "sequence"]).astype({"doc_id": "Int64"})

    name = f"bpe_cut_{uuid.uuid4().hex}"
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(released(run), "block long, shard int, words binary, doc_id long, sequence binary")
    writer = out.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/staged/{name}").option("compression", "uncompressed")
    writer.format("parquet").saveAsTable(name)
    return name


def planes(numbers: np.ndarray) -> np.ndarray:
    """Numbers below 2**32 as four byte planes, low bytes first; planes of zeros pack to nothing."""
    return np.ascontiguousarray(np.asarray(numbers).astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def from_planes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _answer(asked: DataFrame, raw, pattern: str, shards: int) -> DataFrame:
    """Step 2: each row of asked words with their ids; equal words meet in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(raw.value, pattern)._encode_single_piece
        memo: dict[bytes, bytes] = {}
        for batch in batches:
            for block, blob in zip(batch["block"], batch["words"], strict=True):
                lengths, steps, data = unpack_arrays(blob, "u1", "u1", "u1")
                ends, data = np.cumsum(from_planes(lengths)).tolist(), data.tobytes()
                ids = []
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    word = data[a:b]
                    found = memo.get(word)
                    if found is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        found = memo[word] = np.array(encode(word), "<u4").tobytes()
                    ids.append(found)
                counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                flat = np.frombuffer(b"".join(ids), "<u4")
                yield pd.DataFrame({"block": [block], "answer": [pack_arrays(steps, planes(counts), planes(flat))]})

    return asked.select("block", "shard", "words").repartition(shards, "shard").mapInPandas(released(run), "block long, answer binary")


def _assembler(consume: Consumer):
    """Step 3, for one block: its documents' ids by position, handed to consume."""

    def run(key, documents: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        parts = [[from_planes(x) for x in unpack_arrays(b, "u1", "u1", "u1")] for b in answers["answer"]]
        n = sum(len(p[0]) for p in parts)
        counts, starts, base = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for steps, many, flat in parts:
            place = np.cumsum(steps)
            counts[place] = many
            starts[place] = base + np.cumsum(many) - many
            base += len(flat)
        flat = np.concatenate([p[2] for p in parts]).astype("<u4") if parts else np.zeros(0, "<u4")
        del parts

        def ids() -> Iterator[np.ndarray]:
            for blob in documents["sequence"]:
                at = from_planes(unpack_arrays(blob, "u1")[0])
                many = counts[at]
                ends = np.cumsum(many)
                yield flat[np.repeat(starts[at] - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)]

        out = consume(ids())
        out.insert(0, "doc_id", documents["doc_id"].astype("Int64").to_numpy(object))
        return out

    return run


def encode_blocks(docs: DataFrame, consume: Consumer, schema: str, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id with the columns of schema that consume makes of a block's documents, given each one's ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    raw = spark.sparkContext.broadcast(read_ranks(ranks or public_tokenizers.path(RANKS)))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(SHARDS, 2 * buckets)
    cut = spark.table(_cut(spark, docs, pattern, shards, buckets, block_chars))
    answers = _answer(cut.filter("shard >= 0"), raw, pattern, shards)
    documents = cut.filter("shard < 0").select("block", "doc_id", "sequence")
    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_assembler(consume), f"doc_id long, {schema}")


def _ids_column(ids: Iterator[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"ids": [x.tobytes() for x in ids]}, dtype=object)


def encode(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, ids) for every row of docs: ids are little-endian unsigned 32-bit integers, one after another."""
    return encode_blocks(docs, _ids_column, "ids binary", **options)


class TokenBytes:
    """The token-byte table, looked up by id."""

    def __init__(self, raw: bytes):
        table = {i: b for b, i in _table(raw).items()}
        self.token = [table.get(i, b"") for i in range(max(table) + 1)]

    def join(self, ids: np.ndarray) -> bytes:
        return b"".join([self.token[i] for i in ids.tolist()])


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with the decoded bytes as column data."""
    raw = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks or public_tokenizers.path(RANKS)))

    @F.pandas_udf(BinaryType())
    def to_bytes(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = TokenBytes(raw.value)
        for series in ids:
            yield pd.Series([table.join(np.frombuffer(blob, "<u4")) for blob in series], dtype=object)

    return encoded.withColumn("data", to_bytes("ids"))


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, the hash of the ids in decimal and that of the bytes decoded from them; made where the ids are."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(options.get("ranks") or public_tokenizers.path(RANKS)))

    def consume(ids: Iterator[np.ndarray]) -> pd.DataFrame:
        table = TokenBytes(raw.value)
        rows = [(len(x), sha256(" ".join(map(str, x.tolist())).encode()).hexdigest(), sha256(table.join(x)).hexdigest()) for x in ids]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_blocks(docs, consume, "n_tokens long, ids_sha256 string, decoded_sha256 string", **options)


def query(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
