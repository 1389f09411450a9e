"""Exact nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors in double precision, heaps.

Rows are packed into blocks of vectors; every block of queries meets every block
of candidates in one tile, a row of an ordinary join on the candidate block. In
a tile the cosine of two vectors is first taken from their int8 codes. With
unit vectors u = s c + e (scale, codes, rest), the product of the coded vectors
is off by at most |e_u| + |e_v| + |e_u||e_v|, and the lengths of the rests are
known. Only pairs whose upper bound reaches a query's k-th lower bound, or its
k-th cosine found so far, are computed from the original vectors; they go to the
query's heap of k. The k best of each tile are merged by a ranked window.

Nothing is approximate: bounds only spare work. Copies of one vector tie with
each other for every query, so a block keeps the k + 1 of them with the smallest
identifiers; no other could be among the k nearest.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

#: Bytes of vectors in a block, at most and at least; the queries of a tile; cells of a product held at once; pairs recomputed at once.
MOST_BYTES, LEAST_BYTES, QUERIES, CELLS, PAIRS = 16 << 20, 256 << 10, 4096, 1 << 20, 1 << 16
#: Components whose int8 products a float32 sum holds exactly.
EXACT = 1000
#: For rounding in float32, far above it.
SLACK = 1e-5
_NO_ID = np.iinfo(np.int64).max
_BLOCKS = "block string, dim int, ids binary, known binary, vectors binary, codes binary, scales binary, rests binary, places binary, query_ids binary, query_vectors binary"
_QUERIES = "dim int, homes array<string>, home binary, numbers binary, query_places binary, query_ids binary, query_vectors binary"
_FOUND = "query_home string, query_number int, query_id bigint, vec_id bigint, score double"


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and lengths of the rests of the rows' unit vectors."""
    unit = vectors.astype(np.float64)
    unit /= np.abs(unit).max(axis=1, keepdims=True)
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    scales = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scales[:, None])
    rests = unit - codes * scales[:, None]
    return codes.astype(np.int8), scales.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", rests, rests)).astype(np.float32)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of int8 codes, exact per slice of ``EXACT`` components: float32 holds these whole numbers."""
    out = None
    for at in range(0, left.shape[1], EXACT):
        part = left[:, at : at + EXACT].astype(np.float32) @ right[:, at : at + EXACT].astype(np.float32).T
        out = part if out is None else out + part
    return out


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, summed component by component in double precision."""
    if left.dtype == np.float64:  # squares of what a float32 holds never leave the range of a double
        left, right = (x / np.abs(x).max(axis=1, keepdims=True) for x in (left, right))
    dot, a, b = np.zeros(len(left)), np.zeros(len(left)), np.zeros(len(left))
    for j in range(left.shape[1]):
        x, y = left[:, j].astype(np.float64), right[:, j].astype(np.float64)
        dot += x * y
        a += x * x
        b += y * y
    return np.clip(dot / np.sqrt(a * b), -1.0, 1.0)


# ---------------------------------------------------------------- packing


def _distinct(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that stay: of equal vectors the k + 1 with the smallest identifiers."""
    keys = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    _, group = np.unique(keys, return_inverse=True)
    order = np.lexsort((ids, group))
    group = group[order]
    turn = np.arange(len(order)) - np.searchsorted(group, group)
    return np.sort(order[turn <= k])


def _block(name: str, ids, known, vectors, asked, k: int) -> dict:
    stay = _distinct(vectors, ids, k)
    place = np.full(len(ids), -1, np.int32)
    place[stay] = np.arange(len(stay), dtype=np.int32)
    codes, scales, rests = quantise(vectors[stay])
    return {
        "block": name, "dim": vectors.shape[1], "ids": ids[stay].tobytes(), "known": known[stay].tobytes(), "vectors": vectors[stay].tobytes(), "codes": codes.tobytes(),
        "scales": scales.tobytes(), "rests": rests.tobytes(), "places": place[asked].tobytes(), "query_ids": ids[asked].tobytes(), "query_vectors": vectors[asked].tobytes(),
    }


def _pack(block_bytes: int, k: int):
    """A task's rows to blocks of one dimension each. Vectors without length or with null or non-finite components are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, turn, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def flush(dim):
            nonlocal turn
            turn += 1
            parts = [np.concatenate(x) for x in zip(*held.pop(dim), strict=True)]
            return pa.RecordBatch.from_pylist([_block(f"{task}-{turn}", *parts, k)], pa.schema(_arrow(_BLOCKS)))

        for batch in batches:
            ids, lists, asked = batch.columns
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(_NO_ID).to_numpy()
            asked = asked.fill_null(False).to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            values = lists.flatten().fill_null(math.nan).to_numpy(zero_copy_only=False).astype(np.float64 if pa.types.is_float64(lists.type.value_type) else np.float32)
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == dim)
                vectors = values[(ends[rows] - dim)[:, None] + np.arange(dim)]
                good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
                rows, vectors = rows[good], vectors[good]
                if len(rows):
                    most = max(1, block_bytes // (int(dim) * vectors.itemsize))
                    for at in range(0, len(rows), most):
                        part = rows[at : at + most]
                        held.setdefault(int(dim), []).append((ids[part], known[part], vectors[at : at + most], asked[part]))
                        size += vectors[at : at + most].nbytes
                        if sum(x[2].nbytes for x in held[int(dim)]) >= block_bytes:
                            size -= sum(x[2].nbytes for x in held[int(dim)])
                            yield flush(int(dim))
            while size > 4 * block_bytes:  # many dimensions at once
                dim = max(held, key=lambda d: sum(x[2].nbytes for x in held[d]))
                size -= sum(x[2].nbytes for x in held[dim])
                yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    return run


def _arrow(ddl: str):
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "bigint": pa.int64(), "double": pa.float64()}
    return [pa.field(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))]


def _query_blocks(kind):
    """A task's blocks to blocks of their queries, each with the block and place where it stands as a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(dim):
            homes, parts = [], []
            for name, places, ids, vectors in held.pop(dim):
                parts.append((np.full(len(ids), len(homes), np.int32), np.arange(len(ids), dtype=np.int32), places, ids, vectors))
                homes.append(name)
            names = ("home", "numbers", "query_places", "query_ids", "query_vectors")
            parts = dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True))
            for at in range(0, len(parts["home"]), QUERIES):
                row = {"dim": dim, "homes": homes} | {name: x[at : at + QUERIES].tobytes() for name, x in parts.items()}
                yield pa.RecordBatch.from_pylist([row], pa.schema(_arrow(_QUERIES)))

        for batch in batches:
            for name, dim, places, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, np.int64)
                if len(ids):
                    held.setdefault(dim, []).append((name, np.frombuffer(places, np.int32), ids, np.frombuffer(vectors, kind).reshape(len(ids), dim)))
                    if sum(len(x[2]) for x in held[dim]) >= QUERIES:
                        yield from flush(dim)
        for dim in list(held):
            yield from flush(dim)

    return run


# ---------------------------------------------------------------- tiles


class Tile:
    """One block of queries against one block of candidates."""

    def __init__(self, queries: np.ndarray, candidates: np.ndarray, coded: tuple, ids: np.ndarray, own: np.ndarray, k: int):
        self.queries, self.candidates, self.ids, self.own, self.k = queries, candidates, ids, own, k
        self.codes, self.scales, self.rests = coded
        self.query_codes, self.query_scales, self.query_rests = quantise(queries)
        #: per query a heap of (cosine, -identifier, -place), its least member first
        self.heaps: list[list] = [[] for _ in range(len(queries))]
        #: what a pair's upper bound must reach
        self.least = np.full(len(queries), -np.inf, np.float32)

    def run(self) -> list[list]:
        """The k best candidates of each query: (cosine, -identifier, -place) in falling order."""
        wide = max(self.k + 1, min(len(self.candidates), 8192))
        tall = max(1, CELLS // wide)
        for top in range(0, len(self.queries), tall):
            for left in range(0, len(self.candidates), wide):
                self._part(slice(top, top + tall), slice(left, left + wide), bounds=left == 0)
        return [sorted(h, reverse=True) for h in self.heaps]

    def _part(self, rows: slice, columns: slice, bounds: bool) -> None:
        near = products(self.query_codes[rows], self.codes[columns])
        near *= self.scales[columns]
        near *= self.query_scales[rows][:, None]
        own = self.own[rows]
        mine = np.flatnonzero((own >= columns.start) & (own < columns.stop))
        near[mine, own[mine] - columns.start] = -np.inf
        e, f = self.query_rests[rows], self.rests[columns]
        spread = f * (1 + float(e.max())) + SLACK
        if bounds and near.shape[1] > self.k:
            lower = near - spread
            self.least[rows] = np.partition(lower, -self.k, axis=1)[:, -self.k] - e
            del lower
        near += spread
        near += e[:, None]
        r, c = np.nonzero(near >= self.least[rows][:, None])
        upper = near[r, c]
        for at in range(0, len(r), PAIRS):
            part = slice(at, at + PAIRS)
            still = (upper[part] >= self.least[rows][r[part]]) & np.isfinite(upper[part])
            self._exact(r[part][still] + rows.start, c[part][still] + columns.start)

    def _exact(self, r: np.ndarray, c: np.ndarray) -> None:
        """Original cosines of the surviving pairs; the k best of each query go to its heap."""
        scores = cosines(self.queries[r], self.candidates[c])
        order = np.lexsort((self.ids[c], -scores, r))
        r, c, scores = r[order], c[order], scores[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < self.k
        for q, at, score, name in zip(r[best].tolist(), c[best].tolist(), scores[best].tolist(), self.ids[c[best]].tolist(), strict=True):
            heap, item = self.heaps[q], (score, -name, -at)
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        for q in np.unique(r).tolist():
            if len(self.heaps[q]) == self.k:
                self.least[q] = max(self.least[q], np.float32(self.heaps[q][0][0] - SLACK))


def _tiles(kind, k: int):
    """Rows of joined blocks to the k best candidates of each query in the tile."""
    read = np.frombuffer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                x = {f.name: v[row].as_buffer() if pa.types.is_binary(f.type) else v[row].as_py() for f, v in zip(batch.schema, batch.columns, strict=True)}
                dim, homes, home = x["dim"], x["homes"], read(x["home"], np.int32)
                ids, known = read(x["ids"], np.int64), read(x["known"], bool)
                places = read(x["query_places"], np.int32)
                own = np.where(home == (homes.index(x["block"]) if x["block"] in homes else -1), places, -1)
                coded = read(x["codes"], np.int8).reshape(-1, dim), read(x["scales"], np.float32), read(x["rests"], np.float32)
                best = Tile(read(x["query_vectors"], kind).reshape(-1, dim), read(x["vectors"], kind).reshape(-1, dim), coded, ids, own, k).run()
                at = np.repeat(np.arange(len(best)), [len(b) for b in best])
                place = np.array([-item[2] for b in best for item in b], np.int64)
                columns = [
                    pa.array(homes, pa.string()).take(pa.array(home[at])), pa.array(read(x["numbers"], np.int32)[at]), pa.array(read(x["query_ids"], np.int64)[at]),
                    pa.array(ids[place], mask=~known[place]), pa.array([item[0] for b in best for item in b], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(_arrow(_FOUND)))

    return run


# ---------------------------------------------------------------- the join


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, queries, k: int = 5) -> DataFrame:
    """For every row that the condition ``queries`` selects, its k nearest other rows by cosine.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    identifier. A row is never its own neighbour, but a repeated row is another
    row, also one with the same identifier, and each repeated query has its own
    result. Vectors that are null, empty, zero or hold a null or non-finite
    component take no part; vectors of different lengths never meet. Rows
    without identifier are candidates, after all others of the same score. Fewer
    candidates than k are all returned. Other columns are ignored.

    Candidates stay where their group puts them; every block of queries goes to
    every group, of which there are eight per core, whatever the size of the table.
    """
    spark = df.sparkSession
    small_batches(spark)
    element = df.schema[vector_col].dataType.elementType
    kind, size = (np.float64, 8) if element.simpleString() == "double" else (np.float32, 4)
    vector = F.col(vector_col) if size == 8 else F.col(vector_col).cast("array<float>")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    cores = spark.sparkContext.defaultParallelism
    total = (rows.agg(F.sum(F.greatest(F.size("v"), F.lit(0)).cast("bigint")).alias("n")).first()["n"] or 0) * size
    block_bytes = min(MOST_BYTES, max(LEAST_BYTES, total // (2 * cores)))
    blocks = materialize(rows.mapInArrow(_pack(block_bytes, k), _BLOCKS), "blocks")
    asked = blocks.select("block", "dim", "places", "query_ids", "query_vectors")
    asked = materialize(asked.mapInArrow(_query_blocks(kind), _QUERIES), "queries")
    groups = 8 * cores
    left = blocks.drop("places", "query_ids", "query_vectors").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    right = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # co-partitioned by number, so that small tables with much to compute are not put into one task
    tiles = left.repartition(groups, "part").join(right.repartition(groups, "part").hint("merge"), ["part", "dim"])
    found = tiles.drop("part").mapInArrow(_tiles(kind, k), _FOUND)
    order = Window.partitionBy("query_home", "query_number").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_vector_search(spark, sf_dir):
    """Contract: the 5 nearest of every row whose vec_id is divisible by 50, against all rows."""
    return nearest(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0, k=5)


def oracle() -> str:
    """The contract as DuckDB SQL: every query against every row."""
    return """
with good as (
  select turn_ r, vec_id, cast(embedding as double[]) v
  from (select *, row_number() over () turn_ from embeddings)
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.r, q.vec_id query_id, c.vec_id, list_cosine_similarity(q.v, c.v) score
  from good q join good c on q.r <> c.r and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, cast(rank as int) rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id nulls last) rank from pairs) where rank <= 5"""
