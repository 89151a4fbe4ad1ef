"""Text composition, embedding and vector search (VEC-1 to VEC-12)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ohmlake.functions.columns import keep_first

# Dimensions of component vectors, and of net and group vectors.
COMPONENT_DIM, NET_DIM = 1536, 3072

#: Distances that a task holds at once.
CELLS = 1 << 20


def _text(*parts) -> Column:
    return F.trim(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]))


def _listed(array: Column) -> Column:
    return F.when(F.coalesce(F.size(array), F.lit(0)) > 0, F.array_join(array, ", ")).otherwise("none")


def component_text(x: str = "x", y: str = "y") -> Column:
    """VEC-1: one line about a component; its position only if it has one."""
    c = F.col
    place = F.when(c(x).isNull() & c(y).isNull(), "").otherwise(_text("x=", c(x), ", y=", c(y)))
    return _text("Component ", c("reference"), ": ", c("value"), ". ", c("description"), ". Rating: ", c("rating"), ". MPN: ", c("mpn"), ". Footprint: ", c("footprint"), ". Library: ", c("library_id"), ". Datasheet: ", c("datasheet"), ". Position: ", place, ".")


def net_text() -> Column:
    """VEC-1: one line about a net."""
    c = F.col
    return _text("Net ", c("name"), ". Type: ", c("net_type"), ". Connected components: ", _listed(c("connected_components")), ". Connection points: ", F.coalesce(F.size("connection_points"), F.lit(0)), ".")


def group_text() -> Column:
    """VEC-1: one line about a functional group."""
    c = F.col
    return _text("Functional group ", c("name"), ". Function: ", c("function"), ". Description: ", c("description"), ". Components: ", _listed(c("components")), ".")


def hashed(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """The default model: signed feature hashing of words, of unit length; no network, the same everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out

    return embed


def embedded(df: DataFrame, text: str, out: str = "embedding", model: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 64, batch: int = 64) -> DataFrame:
    """VEC-2: df with the vectors of its texts, ``batch`` texts a call of the model."""
    model = model or hashed(dim)

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        own, found = texts.tolist(), []
        for at in range(0, len(own), batch):
            found += model(own[at : at + batch])
        return pd.Series(found, dtype=object)

    return df.withColumn(out, vectors(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(v: Column) -> Column:
    """VEC-6: of unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine distance (NaN for a zero vector) or squared L2 distance, in double."""
    if metric == "cosine":
        n = norm(a) * norm(b)
        return F.when(n == 0, F.lit(float("nan"))).otherwise(1.0 - dot(a, b) / n)
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"unknown metric {metric}")


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", query_vector: str = "query_vector", metric: str = "cosine", most_queries: int = 1000) -> DataFrame:
    """VEC-3: (query_id, id, distance, rank) of the k rows nearest to each query; ties by id, NaN last.

    Queries are a stated, bounded set: they are counted, and broadcast in blocks of ``most_queries``, so that the
    table is scanned once a block and never shuffled. A task multiplies its rows with the block as matrices and hands
    on what may still be among the k best of a query; only for these exact distances are computed and ranked.
    Rows without a vector of the query's length, or with a null in it, have no distance and are left out.
    """
    own = _blocks(queries.select(query_id, query_vector), query_id, most_queries)
    return reduce(DataFrame.unionByName, [_best_of_block(table, q, k, id_, query_id, vector, query_vector, metric) for q in own])


def _blocks(queries: DataFrame, query_id: str, most: int) -> list[DataFrame]:
    """Counted queries in blocks of about ``most``."""
    blocks = max(1, -(-queries.count() // most))
    return [queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i) for i in range(blocks)]


def _best_of_block(table: DataFrame, queries: DataFrame, k: int, id_: str, query_id: str, vector: str, query_vector: str, metric: str, centers: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """The k best of table's rows for each of a block of queries. With centers, of the rows whose list is one of the ``probes``
    nearest to the query; a row's list is its column ``list`` if it has one, else that of its nearest center."""
    spark = table.sparkSession
    numbered = [(i, *r) for i, r in enumerate(queries.collect()) if r[1] is not None and None not in r[1]]  # a block at most
    by_length: dict[int, list[tuple[int, list[float]]]] = {}
    for i, _, v in numbered:
        by_length.setdefault(len(v), []).append((i, v))
    matrices = {m: (np.array([i for i, _ in own], np.int32), np.array([v for _, v in own], float).reshape(len(own), m)) for m, own in by_length.items()}
    asking: dict[int, dict[int, np.ndarray]] = {}  # the places of the queries that probe a list, by length
    if centers is not None:
        probed = {m: _near(q, centers, probes) for m, (_, q) in matrices.items()}
        asking = {m: {int(i): np.flatnonzero((p == i).any(axis=1)) for i in np.unique(p)} for m, p in probed.items()}
    shared = spark.sparkContext.broadcast((matrices, asking))
    stored = centers is not None and "list" in table.columns
    if stored:
        some = sorted({i for own in asking.values() for i in own})
        lists = spark.range(len(centers)).where(F.col("id").isin(some)).select(F.col("id").cast("int").alias("list"))
        table = table.join(F.broadcast(lists), "list", "left_semi")

    def run(batches):
        matrices, asking = shared.value
        top = {m: np.full((k, len(numbers)), np.inf) for m, (numbers, _) in matrices.items()}
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            for m, (numbers, q) in matrices.items():
                some = np.flatnonzero(sizes == m)
                for at in range(0, len(some), max(1, CELLS // max(len(q), 1))):
                    part = vectors.take(pa.array(some[at : at + max(1, CELLS // max(len(q), 1))]))
                    flat = part.flatten()
                    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(part), m)
                    whole = np.arange(len(part))
                    if flat.null_count:
                        whole = np.flatnonzero(~pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(len(part), m).any(axis=1))
                    own = _first_ids(x[whole], ids.take(pa.array(some[at + whole])), whole, k)
                    if centers is None:
                        parts = [(own, slice(None))]
                    else:
                        of = batch.column(2).to_numpy(zero_copy_only=False)[some[at + own]] if stored else _near(x[own], centers, 1)[:, 0]
                        parts = [(own[of == i], asking[m][i]) for i in np.unique(of) if i in asking[m]]
                    for mine, these in parts:
                        by_id = pc.sort_indices(ids.take(pa.array(some[at + mine])), null_placement="at_start").to_numpy()
                        best = top[m][:, these].copy()
                        row, col = _may_be_best(x[mine], q[these], k, metric, best[-1].copy(), by_id, best)
                        top[m][:, these] = best
                        take = pa.array(some[at + mine[row]])
                        yield pa.RecordBatch.from_arrays([pa.array(numbers[these][col]), ids.take(take), vectors.take(take)], names=["number", "id", "v"])

    kinds = [table.schema[c].dataType.simpleString() for c in (id_, vector)]
    found = table.select(id_, vector, *["list"] * stored).mapInArrow(run, f"number int, id {kinds[0]}, v {kinds[1]}")
    asked = spark.createDataFrame(numbered, StructType([StructField("number", IntegerType()), queries.schema[query_id], queries.schema[query_vector]]))
    pairs = found.join(F.broadcast(asked), "number").select(query_id, F.col("id").alias(id_), distance(F.col("v"), F.col(query_vector), metric).alias("distance"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("distance").asc(), F.col(id_).asc()))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _first_ids(x: np.ndarray, ids: pa.Array, rows: np.ndarray, k: int) -> np.ndarray:
    """The rows without those that k rows of the same vector and lesser ids are before: equal vectors tie."""
    seen: dict[bytes, int] = {}
    keep = []
    for i in pc.sort_indices(ids, null_placement="at_start").to_pylist():
        key = x[i].tobytes()
        seen[key] = n = seen.get(key, 0) + 1
        if n <= k:
            keep.append(i)
    return rows[np.sort(np.array(keep, np.int64))]


def _may_be_best(x: np.ndarray, q: np.ndarray, k: int, metric: str, least: np.ndarray, by_id: np.ndarray, top: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries) whose distance is, but for rounding, not above the k-th least so far, which is kept up in ``least``; ``top`` keeps the k least of each query, in k rows, where calls follow each other.

    Rows without a distance (of a zero vector, or to one) come last and by id, so the first k of them will do, and only for
    queries that have fewer than k others so far.
    """
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        if metric == "cosine":
            a, b = np.sqrt((x * x).sum(axis=1))[:, None], np.sqrt((q * q).sum(axis=1))[:, None]
            if all(n.min() > 1e-100 and n.max() < 1e100 for n in (a, b)):
                d = 1.0 - (x / a) @ (q / b).T
            else:
                n = a * b.T
                d = np.where(n == 0, np.inf, 1.0 - (x @ q.T) / n)
            slack = 1e-9
        else:
            a, b = (x * x).sum(axis=1)[:, None], (q * q).sum(axis=1)[None, :]
            d = np.maximum(a + b - 2.0 * (x @ q.T), 0.0)
            slack = 1e-9 * (b[0] + a.max() + 1.0)
    d[np.isnan(d)] = np.inf
    less = np.flatnonzero(d.min(axis=0) < least)
    if len(less):
        before = np.full((k, len(less)), np.inf) if top is None else top[:, less]
        now = np.partition(np.concatenate([before, d[:, less]]), k - 1, axis=0)[:k]
        least[less] = np.minimum(least[less], now[-1])
        if top is not None:
            top[:, less] = now
    good = d <= (least + slack)[None, :]
    if np.isinf(least).any():
        none = np.isinf(d)
        good &= ~none
        short = np.flatnonzero(np.isinf(least) & none.any(axis=0))
        first = none[by_id][:, short]
        good[np.ix_(by_id, short)] |= first & (np.cumsum(first, axis=0) <= k)
    return np.nonzero(good)


def nearest_where(table: DataFrame, queries: DataFrame, equal: dict[str, object], k: int = 10, metric: str = "l2", **names) -> DataFrame:
    """VEC-4: VEC-3 over the rows whose columns equal the given values; the store's own metric by default."""
    for name, value in equal.items():
        table = table.where(F.col(name) == F.lit(value))
    return nearest(table, queries, k, metric=metric, **names)


def by_id(chunks: DataFrame, ids: DataFrame, id_: str = "id") -> DataFrame:
    """VEC-5: the chunks with one of the ids."""
    return chunks.join(ids.select(id_).distinct(), id_, "left_semi")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """VEC-7: old with the rows of new put in or over it by key. Of rows of new with one key, the last by all columns."""
    both = old.select(*old.columns, F.lit(0).alias("_new")).unionByName(new.select(*old.columns, F.lit(1).alias("_new")))
    order = [F.col("_new").desc(), *[F.col(c).desc() for c in old.columns if old.schema[c].dataType.typeName() not in ("map", "variant")]]
    return keep_first(both, keys, order).drop("_new")


def natural_id(*keys: str) -> Column:
    """The id of a row by its natural key, so that a second run puts rows over themselves."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]), 256)


def residual(df: DataFrame, promoted: list[str], out: str = "metadata") -> DataFrame:
    """VEC-8: the promoted columns, and all others as one JSON text."""
    rest = [c for c in df.columns if c not in promoted]
    return df.select(*promoted, (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias(out))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """VEC-9: (id, document, embedding, metadata): flat metadata with "" for null, a chunk's own metadata winning."""
    flat = ["chunk_type", "source_file", "section", "component_name", "manufacturer", "chunk_index"]
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    base = F.create_map(*[x for c in flat for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))])
    base = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return chunks.select("id", F.col("text").alias("document"), "embedding", F.map_concat(base, own).alias("metadata"))


def embedded_chunks(texts: DataFrame, chunker: Callable[[DataFrame], DataFrame], model=None, dim: int = 64, batch: int = 32) -> DataFrame:
    """VEC-10: texts to chunks to vectors to rows of the store, with the source file as the key."""
    return chunk_rows(embedded(chunker(texts), "text", model=model, dim=dim, batch=batch))


def nearly_nearest(table: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", query_vector: str = "query_vector", lists: int = 64, probes: int = 40, sample: int = 4096, seed: int = 7, most_queries: int = 1000) -> DataFrame:
    """VEC-11: nearest by cosine among the rows of the ``probes`` lists whose centers are nearest to the query; exact distances.

    Centers are fitted by a few rounds of spherical k-means on a bounded sample (``sample`` rows, those of the
    least hashes of ids); every row is in the list of its nearest center. Queries, a stated and bounded set, are broadcast
    with their lists in blocks of ``most_queries``; a task multiplies the rows of a list with the queries that probe it as
    matrices, and hands on what VEC-3 does, so rows are neither copied nor shuffled before. Recall is measured against VEC-3 in the tests; vectors that form clusters need fewer probes.
    """
    centers = _fitted(table, id_, vector, lists, sample, seed)
    return _in_lists(table.select(id_, vector), centers, queries, k, id_, query_id, vector, query_vector, probes, most_queries)


def store_lists(table: DataFrame, folder: str, id_: str = "vec_id", vector: str = "embedding", lists: int = 64, sample: int = 4096, seed: int = 7) -> None:
    """VEC-11: fit and assign once: folder/rows holds all rows, a directory a list, and folder/centers the lists' centers.

    Rows are dealt over tasks before they are written, so that a list that holds most rows has several files.
    """
    centers = _fitted(table, id_, vector, lists, sample, seed)
    own = table.withColumn("list", F.get(_lists_of(centers, 1)(vector), F.lit(0)))
    own.write.partitionBy("list").parquet(f"{folder}/rows")
    table.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, center array<double>").write.parquet(f"{folder}/centers")


def nearest_in_lists(table_schema: StructType, folder: str, queries: DataFrame, k: int = 10, id_: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", query_vector: str = "query_vector", probes: int = 40, most_queries: int = 1000) -> DataFrame:
    """VEC-11 over stored lists, whose rows have this schema: only directories of lists that some query of a block probes are read.

    That is dynamic partition pruning on the broadcast queries. Nothing is fitted or assigned again.
    """
    spark = queries.sparkSession
    kept = spark.read.parquet(f"{folder}/centers").orderBy("list").collect()  # as many rows as there are lists
    centers = np.array([r["center"] for r in kept], float)
    own = spark.read.schema(StructType([*table_schema.fields, StructField("list", IntegerType())])).parquet(f"{folder}/rows").select(id_, vector, "list")
    return _in_lists(own, centers, queries, k, id_, query_id, vector, query_vector, probes, most_queries)


def _fitted(table: DataFrame, id_: str, vector: str, lists: int, sample: int, seed: int) -> np.ndarray:
    rows = table.select(vector).where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_), id_).limit(sample).collect()
    return _centers([r[0] for r in rows], lists, seed)


def _lists_of(centers: np.ndarray, n: int) -> Callable:
    """A pandas UDF: the n lists whose centers are nearest to a vector, nearest first; the first lists for other lengths."""

    @F.pandas_udf("array<int>")
    def found(v: pd.Series) -> pd.Series:
        dim = centers.shape[1]
        x = np.array([np.zeros(dim) if a is None or len(a) != dim else a for a in v], float).reshape(len(v), dim)
        return pd.Series(list(_near(x, centers, n)), dtype=object)

    return found


def _near(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n lists of each row of x, as ``_lists_of`` gives them."""
    if x.shape[1] != centers.shape[1]:
        x = np.zeros((len(x), centers.shape[1]))
    return np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :n].astype("int32")


def _in_lists(own: DataFrame, centers: np.ndarray, queries: DataFrame, k: int, id_: str, query_id: str, vector: str, query_vector: str, probes: int, most_queries: int) -> DataFrame:
    """The k nearest among rows (id, vector), with the list where it is stored, of the lists that queries probe."""
    blocks = _blocks(queries.select(query_id, query_vector), query_id, most_queries)
    return reduce(DataFrame.unionByName, [_best_of_block(own, q, k, id_, query_id, vector, query_vector, "cosine", centers, probes) for q in blocks])


def _centers(vectors: list[list[float]], lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centers of at most ``lists`` lists by spherical k-means."""
    x = np.array([v for v in vectors if v and None not in v and len(v) == len(vectors[0])], float)
    if not len(x):
        return np.zeros((1, len(vectors[0]) if vectors else 0))
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    centers = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds):
        of = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.maximum(norms, 1e-30), centers)
    return centers


def checked(df: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """VEC-12: rows whose vector has dim numbers and no null, and the rejected others with a reason."""
    v = F.col(vector)
    reason = (
        F.when(v.isNull() | (F.size(v) == 0), "empty")
        .when(F.size(v) != dim, "dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "not numeric")
    )
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
