"""Nearest neighbours by randomly rotated one-bit codes.

Index: every vector, less a centre fitted on a bounded sample, is turned by seeded random orthogonal
matrices (as many as give CODE_BITS signs); the signs are packed into 64-bit words. Three scalars are kept: how many bits
are set, a factor that corrects the estimate of the inner product, and the width of its error.
Rows lie by cells (centroids of the sample), so neighbours in the table are near each other.

Search: queries come in blocks of QUERY_BLOCK, the only thing that is broadcast; each task
streams its part of the index past the block. A query's turned components are rounded to
QUERY_LEVELS levels and cut into bit planes, so an estimate is a sum of counted bits of (code and plane). A
row is reranked, in double precision, if its estimate plus CONFIDENCE error widths reaches the query's k-th best exact
score so far; only those rows' vectors are gathered. Before that, a tile of rows is skipped for all
queries whose k-th best score its centre and radius cannot reach (an exact bound). A task sends k rows a
query; the k best of those are the answer. No pair leaves its task.

Work is linear in index rows for each query, less the tiles skipped: vectors that form clusters skip most tiles, vectors
spread evenly over the sphere skip none, and no index can for the recall asked. The error bound holds with high probability only, so a
neighbour may be missed; recall is measured against brute force in the tests. Scores that are returned are exact.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, rows without id, and vectors of another length than the commonest take no part; every row
is a candidate of every other row's query, so repeated ids are found and answered row by row; ties go to the
smaller id; an empty table has no neighbours; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalpanel.llm.shared import discard, stage

QUERY_BLOCK = 16_384
#: Signs of a code at least, and bits of a query's components.
CODE_BITS = 256
QUERY_BITS = 4
QUERY_LEVELS = 1 << QUERY_BITS
#: Rows of the index and queries that meet in one matrix.
TILE = 2048
CHUNK = 64
#: Rows behind the centre and the cells.
SAMPLE_ROWS = 20_000
CELLS = 256
ROUNDS = 5
#: Rows that a task searches at least, where there are so many.
TASK_ROWS = 8192
CONFIDENCE = 2.6
SEED = 20240607
#: Candidates reranked at once.
SLICE = 1 << 14


def rotations(dim: int) -> np.ndarray:
    """Orthogonal matrices one under the other, with CODE_BITS rows at least."""
    rng, found = np.random.default_rng(SEED), []
    for _ in range(-(-CODE_BITS // dim)):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        found.append(q * np.sign(np.diag(r)))
    return np.concatenate(found)


def usable(embedding: Column) -> Column:
    whole = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(whole & F.exists(embedding, lambda x: x != 0), F.lit(False))


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    fill = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (bits.ndim - 1) + [(0, fill)])).view("<u8")


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code words, factor, error): <v - centre, q> is about factor * <signs, turn q>, within error * |q|."""
    rest = vectors.astype(np.float64) - centre
    norm = np.linalg.norm(rest, axis=1)
    turned = rest @ turn.T
    positive = turned >= 0
    back = np.where(positive, 1.0, -1.0) @ turn
    # <signs, turn o> for the unit vector o of the rest
    aligned = np.where(norm > 0, np.abs(turned).sum(axis=1) / np.maximum(norm, 1e-300), 1.0)
    spread = np.sqrt(np.maximum(0, (back**2).sum(axis=1) / aligned**2 - 1)) / np.sqrt(max(1, vectors.shape[1] - 1))
    return pack(positive), norm / aligned, norm * spread


def centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """A few rounds of k-means on the sample; at most n cells."""
    found = sample[np.random.default_rng(SEED).permutation(len(sample))[:n]]
    for _ in range(ROUNDS):
        near = _nearest(sample, found)
        size = np.bincount(near, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], found)
    return found


def _nearest(rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return np.argmin((cells**2).sum(axis=1) - 2 * rows @ cells.T, axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column, none of whose rows or elements is null, as a matrix without a copy."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _words(column: pa.Array, n: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u8").reshape(-1, n) if len(column) else np.zeros((0, n), "<u8")


def build(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray] | None:
    """The index (row_key, vec_id, code, ones, factor, error, vector) of all usable rows, and its centre; None without any."""
    rows = embeddings.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return None
    dim, n = sizes["dim"], sizes["count"]
    rows = rows.filter(F.size("vector") == dim)
    sample = rows.filter(F.rand(SEED) < min(1.0, SAMPLE_ROWS / n))
    sample = np.array([r["vector"] for r in sample.select("vector").collect()], np.float64).reshape(-1, dim)
    centre = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    cells = centroids(sample, max(1, min(CELLS, len(sample) // 40))) if len(sample) else np.zeros((1, dim))
    parts = max(1, min(-(-n // TASK_ROWS), int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotations(dim)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector"), dim).astype(np.float64)
                code, factor, error = encode(x, centre, turn)
                ones = np.bitwise_count(code).sum(axis=1, dtype=np.int32)
                columns = [batch.column("vec_id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(ones), pa.array(factor), pa.array(error), pa.array(_nearest(x, cells).astype(np.int32)), batch.column("vector")]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "code", "ones", "factor", "error", "cell", "vector"])

    kind = rows.schema["vector"].dataType.simpleString()
    made = rows.repartition(parts).mapInArrow(run, f"vec_id long, code binary, ones int, factor double, error double, cell int, vector {kind}")
    made = made.sortWithinPartitions("cell").withColumn("row_key", F.monotonically_increasing_id()).drop("cell")
    return stage(made, "ann-index"), centre


class Queries:
    """A chunk of queries: what their estimates need, and the k best (score, smaller id) so far."""

    def __init__(self, q: np.ndarray, own: np.ndarray, k: int, centre: np.ndarray, turn: np.ndarray):
        self.q, self.own, self.k = q, own, k
        turned = q @ turn.T
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (QUERY_LEVELS - 1), 1e-30)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        self.planes = np.stack([pack(level >> b & 1) for b in range(QUERY_BITS)], axis=1)
        # <signs, turned> is about counted * count + ones * set bits + rest
        self.counted, self.ones = 2 * step, 2 * low
        self.rest = -turn.shape[0] * low - step * level.sum(axis=1)
        self.base, self.norm = q @ centre, np.linalg.norm(q, axis=1)
        self.rounding = step * np.sqrt(turn.shape[0] / 12)
        self.query, self.ids, self.keys, self.scores = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64))
        self.least = np.full(len(q), -np.inf)

    def estimates(self, rows: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How many bits of (code and plane) are set, planes weighted by their place; code is (words, index rows)."""
        total = np.zeros((len(rows), code.shape[1]), np.uint16 if code.shape[0] * 64 * QUERY_LEVELS < 1 << 16 else np.uint32)
        both, count = np.empty(total.shape, np.uint64), np.empty(total.shape, np.uint8)
        for b in reversed(range(QUERY_BITS)):
            total <<= 1
            for w in range(code.shape[0]):
                np.bitwise_and(code[w], self.planes[rows, b, w][:, None], out=both)
                np.bitwise_count(both, out=count)
                total += count
        return total

    def scores_of(self, row: np.ndarray, col: np.ndarray, keys: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Exact inner products; a query's own row has none."""
        out = np.empty(len(row))
        for at in range(0, len(row), SLICE):
            part = slice(at, at + SLICE)
            out[part] = np.einsum("ij,ij->i", self.q[row[part]], vectors[col[part]].astype(np.float64))
        return np.where(self.own[row] == keys[col], -np.inf, out)

    def add(self, query: np.ndarray, ids: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        real = scores > -np.inf
        query, ids = np.append(self.query, query[real]), np.append(self.ids, ids[real])
        keys, scores = np.append(self.keys, keys[real]), np.append(self.scores, scores[real])
        order = np.lexsort((keys, ids, -scores, query))
        query = query[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = rank < self.k
        self.query, self.ids, self.keys, self.scores = query[keep], ids[order][keep], keys[order][keep], scores[order][keep]
        last = rank[keep] == self.k - 1
        self.least[self.query[last]] = self.scores[last]

    def meet(self, tile: Tile) -> None:
        rows = np.flatnonzero(self.q @ tile.middle + self.norm * tile.radius >= self.least)
        if not len(rows):
            return
        about = self.estimates(rows, tile.code).astype(np.float64)
        about *= self.counted[rows, None]
        about += self.ones[rows, None] * tile.ones
        about += self.rest[rows, None]
        about *= tile.factor
        about += self.base[rows, None]
        width = CONFIDENCE * (self.norm[rows, None] * tile.error + self.rounding[rows, None] * tile.factor)
        least = self.least[rows]
        chosen = np.zeros(about.shape, bool)
        new = np.flatnonzero(np.isneginf(least))
        n = min(2 * self.k + 1, about.shape[1])
        if len(new) and n > self.k:  # no k-th score yet: the likeliest rows give one
            top = np.argpartition(-about[new], n - 1, axis=1)[:, :n]
            exact = self.scores_of(np.repeat(rows[new], n), top.ravel(), tile.keys, tile.vectors).reshape(-1, n)
            least[new] = np.partition(exact, n - self.k, axis=1)[:, n - self.k]
            chosen[new[:, None], top] = True
        about += width
        chosen |= about >= least[:, None]
        row, col = np.nonzero(chosen)
        row = rows[row]
        self.add(row, tile.ids[col], tile.keys[col], self.scores_of(row, col, tile.keys, tile.vectors))


class Tile:
    """Rows of the index that meet the queries at once."""

    def __init__(self, parts: list[tuple]):
        self.keys, self.ids, code, self.ones, self.factor, self.error, self.vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.code = np.ascontiguousarray(code.T)
        whole = self.vectors.astype(np.float64)
        self.middle = whole.mean(axis=0)
        # a little more than the distance, for rounding
        self.radius = float(np.sqrt(((whole - self.middle) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-12


def _tiles(batches: Iterator[pa.RecordBatch], dim: int, words: int) -> Iterator[Tile]:
    held, size = [], 0
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("row_key", "vec_id")]
        columns += [_words(batch.column("code"), words), *(batch.column(c).to_numpy() for c in ("ones", "factor", "error")), _matrix(batch.column("vector"), dim)]
        for at in range(0, batch.num_rows, TILE):
            held.append(tuple(c[at : at + TILE] for c in columns))
            size += len(held[-1][0])
            if size >= TILE:
                yield Tile(held)
                held, size = [], 0
    if held:
        yield Tile(held)


def search(index: DataFrame, centre: np.ndarray, queries: pd.DataFrame, k: int) -> DataFrame:
    """(query_id, query_key, vec_id, row_key, score): the k best of each task for a block of queries (vec_id, row_key, vector)."""
    block = index.sparkSession.sparkContext.broadcast(
        (queries["vec_id"].to_numpy(np.int64), queries["row_key"].to_numpy(np.int64), np.stack(queries["vector"].to_numpy()))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, q = block.value
        q, turn = q.astype(np.float64), rotations(len(centre))
        chunks = [Queries(q[at : at + CHUNK], own[at : at + CHUNK], k, centre, turn) for at in range(0, len(q), CHUNK)]
        for tile in _tiles(batches, len(centre), -(-len(turn) // 64)):
            for chunk in chunks:
                chunk.meet(tile)
        for at, chunk in zip(range(0, len(q), CHUNK), chunks, strict=True):
            row = chunk.query + at
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(own[row]), pa.array(chunk.ids), pa.array(chunk.keys), pa.array(chunk.scores)], ["query_id", "query_key", "vec_id", "row_key", "score"])

    return index.select("row_key", "vec_id", "code", "ones", "factor", "error", "vector").mapInArrow(run, "query_id long, query_key long, vec_id long, row_key long, score double")


def neighbours(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): rows whose id is divisible by `every` against all others."""
    spark = embeddings.sparkSession
    built = build(embeddings)
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if built is None:
        return nothing
    index, centre = built
    queries = index.filter(F.col("vec_id") % every == 0)
    # a block holds the queries of one residue of a hash, so blocks are about even and bounded
    blocks = max(1, -(-queries.count() // (QUERY_BLOCK * 3 // 4)))
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id", "row_key")
    found = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("row_key"), F.lit(blocks)) == b).select("vec_id", "row_key", "vector").toPandas()
        if not len(rows):
            continue
        part = search(index, centre, rows, k).withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
        # one block at a time is broadcast; its answer is written before the next
        part = stage(part, "ann-found") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        discard(index)
    return nothing if found is None else found


def query(spark, sf_dir):
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
