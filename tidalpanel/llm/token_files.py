"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Format. A folder of two Parquet tables, written and committed by Spark:
  vocabulary  (id, rank): ids by falling count over the whole corpus, ties to the smaller id
  blocks      (shard, at, doc_ids, lengths, control, data): a run of documents in ascending order;
              `at` is the number of ids before it in its shard
Ranks are cut into bytes, low byte first, as few as they need (1 to 4). `control` holds two
bits a value (bytes less one; four values a byte, first in the lowest bits) and `data` the
bytes themselves. Decoding looks the four lengths of each control byte up in a table of
256 rows and gathers the bytes with numpy; there is no loop over values.

Steps: encoding where the texts lie, with counts of all ids; ranking (a table of the vocabulary's
size); a range partitioning of the packed ids by doc_id, so shards follow each other in ascending order;
coding. Texts are never shuffled. Every step is a committed table, so a lost executor repeats its
own tasks only. Starts come from the shards' totals: one row a shard.

The tokenizers library encodes each distinct word once per worker and memo. Strings of
added tokens are what the library makes of them (add_special_tokens=False adds none).

Defined results: null text is empty (its end id alone); null doc_ids come first; rows of
one id are ordered by a hash of the text; equal rows are written each; a very long text is one
block; an empty table gives empty files; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import os
import string
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalpanel.llm.shared import bounded_batches, discard, released, shared_dir, stage

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Values of a block, or one longer document.
BLOCK_VALUES = 1 << 20
#: Distinct words that a worker remembers, from task to task, before it starts anew (a bound of its memory; ids do not depend on it), and how many new ones are encoded as one text.
MEMO_PIECES = 800_000
RUN = 64
#: Bytes of rows encoded at a time.
GATHERED = 8 << 20
#: How a byte-level vocabulary writes a space; ASCII letters stand for themselves.
SPACE_MARK = "Ġ"
#: Bytes of the values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1

Consumer = Callable[[Iterator[np.ndarray]], pd.DataFrame]


_VISIBLE = np.array([0x20 < b < 0x7F for b in range(256)])
_PUNCTUATION = np.array([chr(b) in string.punctuation for b in range(256)])


def _ends(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last byte of each word, 0 of an empty one. words is a large_string array without nulls."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.append(np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8), np.uint8(0))
    some = ends[1:] > ends[:-1]
    return np.where(some, data[np.where(some, ends[:-1], 0)], 0), np.where(some, data[np.where(some, ends[1:] - 1, 0)], 0)


class _Rows:
    """Rows of ids that only grow."""

    def __init__(self):
        self.n, self.starts, self.flat = 0, np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)

    def add(self, counts: np.ndarray, flat: np.ndarray) -> None:
        ends = self.starts[self.n] + np.cumsum(counts)
        need = self.n + len(counts) + 1
        if need > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(need, len(self.starts)), np.int64)])
        size = int(self.starts[self.n])
        if size + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(size + len(flat), len(self.flat)), np.uint32)])
        self.flat[size : size + len(flat)] = flat
        self.starts[self.n + 1 : need] = ends
        self.n += len(counts)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each of the rows has, those ids)."""
        first = self.starts[rows]
        many = self.starts[rows + 1] - first
        ends = np.cumsum(many)
        return many, self.flat[np.repeat(first - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)]


class PieceEncoder:
    """The tokenizers library over distinct words.

    The library cuts text before merging, and never across a single space between two characters
    that are not white space; so a text is split there and each distinct part is encoded
    once, with its leading space. Parts that touch other white space stay with their neighbours.
    A part of letters and then ASCII punctuation is cut between the two as well, as the library does.
    A text that holds the string of an added token goes to the library whole, unless those strings are ordinary text."""

    def __init__(self, definition: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.definition, self.ordinary = definition, ordinary
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = ordinary
        self.added = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level vocabularies write each byte as one character
        size = self.tokenizer.get_vocab_size()
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str | tuple, int] = {}
        self.plain = pa.array([], pa.large_string())
        self.new: list[str | tuple] = []
        self.rows, self.pieces = _Rows(), _Rows()
        self.piece: dict[str | tuple, int] = {}
        self.rows.add(np.array([1]), np.array([END_ID], np.uint32))
        self.next = 1

    def _number(self, part: str | tuple) -> int:
        """The number of a part: a word after a space, (text,) at the start, or (text, " ") with white space at its ends."""
        found = self.number.get(part)
        if found is None:
            found = self.number[part] = self.next
            self.next += 1
            self.new.append(part)
        return found

    def _cut(self, text: str) -> list[int]:
        """Numbers of the parts of any text."""
        whole, (joined, *rest) = [], text.split(" ")
        for part in rest:
            if part and joined and not part[0].isspace() and not joined[-1].isspace():
                whole.append(joined)
                joined = part
            else:
                joined += " " + part
        whole.append(joined)
        return [self._number((whole[0],)), *[self._number((x, " ")) for x in whole[1:]]]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encode the pieces of the new parts and put the parts together: plain words first, as they are numbered first."""
        plain, other = self.plain, self.new
        self.plain, self.new = pa.array([], pa.large_string()), []
        if not len(plain) and not other:
            return
        names = np.empty(len(plain) + len(other), object)
        names[: len(plain)] = plain.to_numpy(zero_copy_only=False)
        for k, part in enumerate(other, len(plain)):
            names[k] = part
        marked = np.flatnonzero(_PUNCTUATION[_ends(plain)[1]])
        cores = pc.utf8_rtrim(plain.take(marked), characters=string.punctuation)
        cut = np.flatnonzero(pc.ascii_is_alpha(cores).to_numpy(zero_copy_only=False))
        marked, cores = marked[cut], cores.take(cut).to_numpy(zero_copy_only=False)
        sizes = np.ones(len(names), np.int64)
        sizes[marked] = 2
        first = np.cumsum(sizes) - sizes
        pieces = np.empty(int(sizes.sum()), object)
        pieces[first] = names
        pieces[first[marked]] = cores
        for k, word, core in zip((first[marked] + 1).tolist(), names[marked], cores, strict=True):
            pieces[k] = (word[len(core) :],)
        pieces = pieces.tolist()
        piece, spaced, lone = self.piece, [], []
        used = np.fromiter(map(piece.get, pieces, repeat(-1)), np.int64, len(pieces))
        missed = np.flatnonzero(used < 0)
        for name in map(pieces.__getitem__, missed.tolist()):
            if name not in piece:
                (spaced if name.__class__ is str else lone).append((len(piece), name))
                piece[name] = len(piece)
        used[missed] = np.fromiter(map(piece.__getitem__, map(pieces.__getitem__, missed.tolist())), np.int64, len(missed))
        self._encode_pieces(spaced, lone)
        many, ids = self.pieces.gather(used)
        self.rows.add(np.add.reduceat(many, first), ids)

    def _encode_pieces(self, spaced: list[tuple[int, str]], lone: list[tuple[int, tuple]]) -> None:
        """ASCII letters after a space are one piece for the library's model; of other pieces that start with a space
        many go in one text, as ids never cross the space between two of them; the rest go alone."""
        counts, flats, order = [], [], []
        letters, others = [], []
        for pair in spaced:
            (letters if pair[1].isascii() and pair[1].isalpha() else others).append(pair)
        spaced = others
        if letters:
            tokenize, flat, size = self.tokenizer.model.tokenize, [], []
            for _, name in letters:
                found = tokenize(SPACE_MARK + name)
                size.append(len(found))
                flat += [token.id for token in found]
            counts.append(np.array(size, np.int64))
            flats.append(np.array(flat, np.uint32))
            order += [n for n, _ in letters]
        for k in range(0, len(spaced), RUN * 256):
            names = [name for _, name in spaced[k : k + RUN * 256]]
            texts = [" " + " ".join(names[j : j + RUN]) for j in range(0, len(names), RUN)]
            ids = np.concatenate([np.array(found, np.uint32) for found in self._ids(texts)])
            ends = np.cumsum(np.fromiter((len(name.encode()) + 1 for name in names), np.int64, len(names)))
            last = np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1
            counts.append(np.diff(last, prepend=0))
            flats.append(ids)
            order += [n for n, _ in spaced[k : k + RUN * 256]]
        for k in range(0, len(lone), RUN):
            found = self._ids([" " * (len(name) - 1) + name[0] for _, name in lone[k : k + RUN]])
            counts.append(np.array([len(x) for x in found], np.int64))
            flats += [np.array(x, np.uint32) for x in found]
            order += [n for n, _ in lone[k : k + RUN]]
        if order:
            fresh = _Rows()
            fresh.add(np.concatenate(counts), np.concatenate(flats))
            place = np.empty(len(order), np.int64)
            place[np.array(order) - self.pieces.n] = np.arange(len(order))
            self.pieces.add(*fresh.gather(place))

    def _whole(self, text: str) -> list[int]:
        """The number of a row for this text alone."""
        self._learn()
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self.rows.add(np.array([len(ids)]), np.array(ids, np.uint32))
        self.next += 1
        return [self.next - 1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text with its end, all those ids). Only the distinct words of the texts are looked up one by one."""
        if len(self.number) > MEMO_PIECES:
            self._forget()
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        texts = texts.cast(pa.large_string()).fill_null("")
        split = pc.split_pattern(texts, " ")
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        first = np.append(0, ends[:-1])
        coded = split.flatten().dictionary_encode()
        at, dictionary = coded.indices.to_numpy(), coded.dictionary
        words = dictionary.to_numpy(zero_copy_only=False).tolist()
        follows = np.ones(len(at), bool)
        follows[first] = False
        after_space = np.zeros(len(words), bool)
        after_space[at[follows]] = True
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        # a word between two visible ASCII characters touches no white space; of others Python knows
        head, tail = _ends(dictionary)
        unknown = number < 0
        odd = np.zeros(len(words), bool)
        for k in np.flatnonzero(unknown & ~(_VISIBLE[head] & _VISIBLE[tail])).tolist():
            word = words[k]
            odd[k] = not word or word[0].isspace() or word[-1].isspace()
        new = np.flatnonzero(unknown & after_space & ~odd)
        number[new] = np.arange(self.next, self.next + len(new))
        self.number.update(zip(map(words.__getitem__, new.tolist()), range(self.next, self.next + len(new)), strict=True))
        self.next += len(new)
        self.plain = dictionary.take(new)
        numbers = number[at]
        aside = np.logical_or.reduceat(odd[at], first)
        whole = np.zeros(len(texts), bool)
        for added in self.added:
            whole |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        rows: list = []
        for k in range(len(texts)):
            if whole[k]:
                rows.append(self._whole(texts[k].as_py()))
            elif aside[k]:
                rows.append(self._cut(texts[k].as_py()))
            else:
                numbers[first[k]] = self._number((words[at[first[k]]],))
                rows.append(numbers[first[k] : ends[k]])
            rows.append((0,))
        self._learn()
        sizes = np.fromiter(map(len, rows[::2]), np.int64, len(texts)) + 1
        many, ids = self.rows.gather(np.concatenate(rows).astype(np.int64))
        return np.add.reduceat(many, np.cumsum(sizes) - sizes), ids


@functools.cache
def _zstd():
    """One compressor and one decompressor a process: making them costs more than a short text does."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeeze(ids: np.ndarray) -> bytes:
    """The byte planes of the ids, compressed, as many as the largest id needs (2 or 4), after their number."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    planes = np.ascontiguousarray(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + _zstd()[0].compress(planes)


def _unsqueeze(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(_zstd()[1].decompress(memoryview(blob)[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype("<u4", copy=False)


def code(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = values.astype("<u4")
    widest = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    more = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    for k in range(1, widest):
        more[: len(values)] += values >= 1 << 8 * k
    control = more.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    keep = np.arange(widest, dtype=np.uint8) <= more[: len(values), None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[:, :widest][keep].tobytes()


def uncode(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    first = np.cumsum(lengths, dtype=np.int64) - lengths
    source = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))
    out = source[first].astype(np.uint32)
    for k in range(1, int(lengths.max()) if n else 1):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= source[first[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: The encoder that a worker's last whole task has left, for its next one.
_KEPT: list[PieceEncoder] = []


def _lent(definition: str, ordinary: bool) -> PieceEncoder:
    """The worker's encoder, taken out until its task has ended well, or a new one."""
    found = _KEPT.pop() if _KEPT else None
    return found if found and (found.definition, found.ordinary) == (definition, ordinary) else PieceEncoder(definition, ordinary)


def _kept(encoder: PieceEncoder) -> None:
    _KEPT[:] = [encoder]


def _take(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
    return kept[0] if len(kept) == 1 else pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about GATHERED bytes or one longer batch, so that words of many texts are looked up once."""
    kept, size = [], 0
    for batch in batches:
        if kept and size + batch.nbytes > GATHERED:
            yield _take(kept)
            kept, size = [], 0
        if len(batch):
            kept.append(batch)
            size += batch.nbytes
    if kept:
        yield _take(kept)


def _encoded(docs: DataFrame, definition: str, ordinary: bool) -> DataFrame:
    """Staged (doc_id, tie, n, ids); a row with n null has the counts of a task's ids."""
    text = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = _lent(text.value, ordinary), np.zeros(0, np.int64)
        names = ["doc_id", "tie", "n", "ids"]
        for batch in _gathered(batches):
            n, ids = encoder.encode(batch.column("text"))
            seen = np.bincount(ids, minlength=len(counts))
            seen[: len(counts)] += counts
            counts = seen
            packed = pa.array([_squeeze(i) for i in np.split(ids, np.cumsum(n)[:-1])] if len(n) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(n, pa.int64()), packed], names)
        some = np.flatnonzero(counts)
        _kept(encoder)
        packed = _squeeze(np.concatenate([some, counts[some] & 0xFFFFFFFF, counts[some] >> 32]))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.int64()), pa.array([packed], pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    return stage(rows.mapInArrow(released(run), "doc_id long, tie long, n long, ids binary"), "tokens", "none")


def _ranks(encoded: DataFrame) -> pd.DataFrame:
    """(id, rank) of all ids seen; at most as many rows as the vocabulary has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["ids"]:
                ids, low, high = _unsqueeze(blob).reshape(3, -1).astype(np.int64)
                yield pd.DataFrame({"id": ids, "n": low | high << 32})

    counts = encoded.filter("n is null").select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["n", "id"], ascending=[False, True], ignore_index=True)
    return pd.DataFrame({"id": counts["id"].astype("int64"), "rank": np.arange(len(counts))})


def write(docs: DataFrame, path: str, tokenizer: str | None = None, ordinary: bool = False) -> None:
    """Encode docs and write the files to path (any file system that Spark knows). With ordinary, strings of special tokens are ordinary text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        definition = f.read()
    encoded = _encoded(docs, definition, ordinary)
    ranks = _ranks(encoded)
    spark.createDataFrame(ranks, "id long, rank long").coalesce(1).write.parquet(f"{path}/vocabulary")
    table = np.zeros(int(ranks["id"].max()) + 1 if len(ranks) else 1, "<u4")
    table[ranks["id"]] = ranks["rank"]
    rank_of = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, at, size = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []

        def block() -> pd.DataFrame:
            control, data = code(rank_of.value[np.concatenate(parts)])
            return pd.DataFrame({"shard": [shard], "at": [at], "doc_ids": [doc_ids], "lengths": [lengths], "control": [control], "data": [data]})

        for batch in batches:
            for doc_id, n, blob in zip(batch["doc_id"].astype("Int64"), batch["n"].tolist(), batch["ids"], strict=True):
                if parts and size + n > BLOCK_VALUES:
                    yield block()
                    at += size
                    doc_ids, lengths, parts, size = [], [], [], 0
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                lengths.append(int(n))
                parts.append(_unsqueeze(blob))
                size += int(n)
        if parts:
            yield block()

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("tie"))
    rows = encoded.filter("n is not null").repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    blocks = rows.mapInPandas(released(run), "shard int, at long, doc_ids array<long>, lengths array<long>, control binary, data binary")
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    discard(encoded)


def read_blocks(spark: SparkSession, path: str, consume: Consumer, schema: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the columns that consume makes of the ids."""
    ranks = spark.read.parquet(f"{path}/vocabulary").orderBy("rank").toPandas()
    id_of = spark.sparkContext.broadcast(ranks["id"].to_numpy("<u4") if len(ranks) else np.zeros(1, "<u4"))
    blocks = spark.read.schema("shard int, at long, doc_ids array<long>, lengths array<long>, control binary, data binary").parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, n) -> a + n)")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                lengths = np.asarray(row.lengths, np.int64)
                ids = id_of.value[uncode(row.control, row.data, int(lengths.sum()))]
                ends = np.cumsum(lengths)
                out = consume(ids[b - n : b] for b, n in zip(ends, lengths, strict=True))
                doc_ids = pd.array([None if x is None or x != x else int(x) for x in row.doc_ids], "Int64")
                head = pd.DataFrame({"doc_id": doc_ids, "start": row.shard_start + row.at + ends - lengths, "n_tokens": lengths})
                yield pd.concat([head, out], axis=1)

    return blocks.join(F.broadcast(starts), "shard").mapInPandas(run, f"doc_id long, start long, n_tokens long, {schema}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids); ids are little-endian unsigned 32-bit integers."""
    return read_blocks(spark, path, lambda ids: pd.DataFrame({"ids": [i.astype("<u4").tobytes() for i in ids]}, dtype=object), "ids binary")


def _checksums(ids: Iterator[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"ids_crc32": np.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], np.int64)})


def query(spark, sf_dir):
    path = f"{shared_dir(spark)}/staged/token-files-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_blocks(spark, path, _checksums, "ids_crc32 long")
