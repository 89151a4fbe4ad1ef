"""Exact top-k search by inner product (operator 12).

Vectors are grouped by length: the table is dealt by ranges of falling length and written once, sorted, so that a
bucket is a run of vectors of similar length. Queries, a stated set, are counted and come in blocks of bounded
bytes; a block is broadcast and searched against all buckets, one job a block.

A task keeps the k best so far of every query, so each query has a least score that still counts. In a bucket this
gives a local cosine threshold: that score, over the query's length times the bucket's longest. Above 1 the bucket is
skipped. Each bucket then has a switch, set where few of its vectors would be left at the queries' own thresholds:

* from there on, coordinates prune: a cosine of at least t bounds how far a vector's normalised entry can be from
  the query's in any one coordinate. Of the query's largest coordinates, the one with the narrowest range in the
  bucket's sorted entries gives the candidates, the others thin them out;
* below it, length prunes: the bucket's vectors are in order of length, and only those long enough are multiplied.

What is left is verified by its product in whole numbers. The longest vectors of the table, a bounded number, give
the first thresholds, so that tasks with short vectors skip most buckets. Pruning never changes the result.

Entries are floor(scale * x). Vectors that are null, empty or hold null or non-finite entries take no part, neither as
queries nor as candidates; only vectors of one length are compared. Candidates with a query's id are its own and are left
out; repeated candidates all count, and each repeated query row is answered. Equal scores go by id, null ids last. A null id
is nobody's own. Fewer than k candidates give all; no queries or no candidates give no rows. Scores that may not fit
a long are an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import read, stored

SCALE = 256
K = 5

#: Vectors of a bucket at most, and of a task about.
BUCKET, TASK = 4096, 1 << 17
#: Bytes of the queries that are broadcast at once (8 a number), and of the vectors that give the first thresholds.
BLOCK_BYTES, FIRST_BYTES = 8 << 20, 2 << 20
#: Products that a task holds at once.
CELLS = 1 << 20
#: Coordinates of a query that prune; share of a bucket that they may leave for coordinates to be chosen; what a bucket's switch is set by.
FOCUS, FEW, TRIED_QUERIES, TRIED_ROWS = 6, 0.25, 16, 256
_SLACK = 1e-9


def _counts(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows.astype(float), rows.astype(float)))


def _units(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return rows / np.maximum(lengths, 1e-300)[:, None]


class Search:
    """The k best of each query, all of one dimension, among the buckets shown so far; scores below ``least`` are not needed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.lengths = _lengths(vectors)
        self.units = _units(vectors, self.lengths)
        self.focus = np.argsort(-np.abs(self.units), axis=1)[:, :FOCUS]
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.most = int(np.abs(vectors).max(initial=0))
        none = np.zeros(0, np.int64)
        self.best = (none, none, none.astype(bool), none)  # query, score, whether the id is null, id
        self.by_coordinates = self.by_length = 0  # (query, bucket) pairs of each kind

    def bucket(self, ids: np.ndarray, null: np.ndarray, vectors: np.ndarray) -> None:
        lengths = _lengths(vectors)
        order = np.argsort(-lengths, kind="stable")
        ids, null, vectors, lengths = ids[order], null[order], vectors[order], lengths[order]
        bound = self.most * int(np.abs(vectors).max(initial=0)) * vectors.shape[1]
        if bound >= 1 << 63:
            raise ValueError("scores of these vectors may not fit a long")
        kind = np.float64 if bound < 1 << 53 else np.int64
        reach = self.lengths * lengths[0] * (1 + _SLACK)
        queries = np.flatnonzero(reach >= self.least)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.least[queries] > 0, self.least[queries] / reach[queries], -1.0)
        units = _units(vectors, lengths)
        near = local >= self._switch(queries, local, units)
        found = [*self._coordinates(queries[near], local[near], ids, null, vectors.astype(kind), units), *self._by_length(queries[~near], ids, null, vectors.astype(kind), lengths)]
        self.by_coordinates += int(near.sum())
        self.by_length += int((~near).sum())
        if found:
            self._keep([np.concatenate(x) for x in zip(self.best, *found)])

    def _ranges(self, queries: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query and focus coordinate, what a normalised entry can be if the cosine is at least the threshold."""
        own = np.arccos(np.clip(np.take_along_axis(self.units[queries], self.focus[queries], axis=1), -1, 1))
        turn = np.arccos(np.clip(local, -1, 1))[:, None]
        return np.cos(np.minimum(np.pi, own + turn)) - _SLACK, np.cos(np.maximum(0.0, own - turn)) + _SLACK

    def _switch(self, queries: np.ndarray, local: np.ndarray, units: np.ndarray) -> float:
        """The least threshold of the tried queries from which on coordinates leave, on average, few of the bucket's vectors."""
        if not len(queries) or len(units) < 2 * self.k:
            return np.inf
        tried = np.argsort(-local)[:: max(1, len(local) // TRIED_QUERIES)]
        low, high = self._ranges(queries[tried], local[tried])
        rows = units[:: max(1, len(units) // TRIED_ROWS)]
        left = np.array([((e >= lo) & (e <= hi)).mean(axis=0).min() for e, lo, hi in zip((rows[:, self.focus[q]] for q in queries[tried]), low, high)])
        left[local[tried] <= 0] = 1.0
        good = np.flatnonzero(np.cumsum(left) <= FEW * np.arange(1, len(left) + 1))
        return local[tried[good[-1]]] if len(good) else np.inf

    def _coordinates(self, queries, local, ids, null, vectors, units) -> Iterator[tuple]:
        if not len(queries):
            return
        low, high = self._ranges(queries, local)
        lists = {c: np.argsort(units[:, c], kind="stable") for c in np.unique(self.focus[queries]).tolist()}
        entries = {c: units[rows, c] for c, rows in lists.items()}
        for q, lo, hi in zip(queries.tolist(), low, high):
            own = self.focus[q].tolist()
            spans = [(int(np.searchsorted(entries[c], a, "left")), int(np.searchsorted(entries[c], b, "right"))) for c, a, b in zip(own, lo, hi)]
            first = min(range(len(own)), key=lambda i: spans[i][1] - spans[i][0])
            rows = lists[own[first]][slice(*spans[first])]
            for i, c in enumerate(own):
                if i != first and len(rows):
                    rows = rows[(units[rows, c] >= lo[i]) & (units[rows, c] <= hi[i])]
            rows = rows[null[rows] | (ids[rows] != self.ids[q])]
            score = vectors[rows] @ self.vectors[q].astype(vectors.dtype)
            good = self._enough(score, self.least[q])
            rows, score = rows[good], score[good]
            yield np.full(len(rows), q), score.astype(np.int64), null[rows], ids[rows]

    def _by_length(self, queries, ids, null, vectors, lengths) -> Iterator[tuple]:
        if not len(queries):
            return
        need = np.where(self.least[queries] > 0, self.least[queries] / np.maximum(self.lengths[queries], 1e-300) * (1 - _SLACK), -1.0)
        long = np.searchsorted(-lengths, -need, "right")  # so many vectors are long enough
        order = np.argsort(-long, kind="stable")
        queries, long = queries[order], long[order]
        at = 0
        while at < len(queries) and long[at]:
            own = queries[at : at + max(1, CELLS // int(long[at]))]
            at, m = at + len(own), int(long[at])
            score = self.vectors[own].astype(vectors.dtype) @ vectors[:m].T
            good = self._enough(score, self.least[own][:, None]) & (null[:m] | (ids[:m] != self.ids[own][:, None]))
            if good.sum() > 8 * self.k * len(own) and m > self.k:  # no more than the k best of each, and what ties with them
                own_score = np.where(good, score, -np.inf)
                good &= score >= np.partition(own_score, m - self.k, axis=1)[:, m - self.k][:, None]
            q, row = np.nonzero(good)
            yield own[q], score[q, row].astype(np.int64), null[row], ids[row]

    @staticmethod
    def _enough(score: np.ndarray, least) -> np.ndarray:
        return score >= least if score.dtype == np.float64 else score >= least - np.abs(least) * 1e-15

    def _keep(self, rows: list[np.ndarray]) -> None:
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        q = rows[0]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        full = rank == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], rows[1][full])
        self.best = tuple(x[rank < self.k] for x in rows)


def _vectors(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole numbers) of vectors of one length, at most BUCKET at once."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        for at in range(0, len(rows), BUCKET):
            own = rows[at : at + BUCKET]
            x = np.floor(scale * column.take(pa.array(own)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
            if np.abs(x).max() >= 2.0**62:
                raise ValueError("scores of these vectors may not fit a long")
            yield own, x.astype(np.int64).reshape(len(own), d)


def _searched(block: dict, least: dict | None, k: int, scale: int, batches: Iterator[pa.RecordBatch]) -> dict[int, Search]:
    """Searches by dimension; a batch's vectors are of similar length, and each run of BUCKET of them is a bucket."""
    found = {d: Search(ids, x, k, least and least[d]) for d, (_, ids, x) in block.items()}
    for batch in batches:
        ids = batch.column(0)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        for rows, x in _vectors(batch.column(1), scale):
            if x.shape[1] in found:
                found[x.shape[1]].bucket(ids[rows], null[rows], x)
    return found


def _block(rows: list, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, ids, whole numbers) by dimension of collected (number, id, vector) rows; a null id is nobody's."""
    out = {}
    for own, x in _vectors(pa.array([r[2] for r in rows], pa.list_(pa.float64())), scale):
        more = (np.array([rows[i][0] for i in own], np.int64), np.array([-(2**63) if rows[i][1] is None else rows[i][1] for i in own], np.int64), x)
        out[x.shape[1]] = tuple(np.concatenate(both) for both in zip(out[x.shape[1]], more)) if x.shape[1] in out else more
    return out


def top_k(table: DataFrame, queries: DataFrame, k: int = K, id_: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding", scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k candidates of highest inner product for each query, exactly."""
    spark = table.sparkSession
    v = F.col(vector)
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + whole(x) * whole(x)))
    rows = table.where(_counts(v)).select(F.col(id_).cast("long").alias("id"), v.alias("v"), length.alias("length"))
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK))
    by = [F.col("length").desc(), F.xxhash64("id", "v")]
    # most of a table may be of one length, or even one vector repeated
    grouped = stored(rows.repartitionByRange(parts, *by, F.rand(7)).sortWithinPartitions(*by), "lengths")
    asked = queries.where(_counts(F.col(query_vector))).select(F.monotonically_increasing_id().alias("number"), F.col(query_id).cast("long").alias("id"), F.col(query_vector).alias("v"))
    asked = stored(asked, "queries")
    numbers, widest = asked.agg(F.sum(F.size("v").cast("long")), F.max(F.size("v"))).first()
    blocks = max(1, -(-8 * (numbers or 0) // block_bytes))
    first = grouped.select("id", "v", "length").orderBy(F.col("length").desc(), "id").limit(max(1, FIRST_BYTES // (8 * (widest or 1)))).select("id", "v").toArrow().combine_chunks()
    parts = []
    for b in range(blocks):
        block = _block(asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).collect(), scale)
        if not block:
            continue
        least = {d: s.least for d, s in _searched(block, None, k, scale, first.to_batches()).items()}
        shared = spark.sparkContext.broadcast((block, least))
        found = _ranked(grouped, shared, k, scale)
        if blocks > 1:
            found = stored(found, "found")
            shared.destroy()
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], f"{query_id} long, rank int, {id_} long, score long")
    return reduce(DataFrame.unionByName, parts).select(F.col("query").alias(query_id), "rank", F.col("id").alias(id_), "score")


def _ranked(grouped: DataFrame, shared, k: int, scale: int) -> DataFrame:
    """(query, rank, id, score) of the queries of one block: tasks hand on k rows a query at most."""

    def run(batches):
        block, least = shared.value
        for d, search in _searched(block, least, k, scale, batches).items():
            numbers, ids, _ = block[d]
            q, score, null, id_ = search.best
            own = pa.array(ids[q], mask=ids[q] == -(2**63))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), own, pa.array(id_, mask=null), pa.array(score)], names=["number", "query", "id", "score"])

    found = grouped.select("id", "v").mapInArrow(run, "number long, query long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def op12_top_products(spark, sf_dir) -> DataFrame:
    """Of every vector whose id is divisible by 50: the five others of highest integer inner product."""
    table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = table.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return top_k(table, queries)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""
