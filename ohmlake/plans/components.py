"""Connected components: forests of blocks of edges, then alternating large-star and small-star steps on what links them.

Nodes that are near each other in order are often linked, as ids of one thing have one prefix. So the edges are dealt by ranges and
each task makes blocks of them into stars, of which only the roots that share a node go into the steps. Where order says
nothing, a block is a forest of its own and the steps have no more edges than there were. As soon as what is left fits one
block, that block ends it; what does not fit goes on by steps.

Every step is an aggregation of the least neighbour and a join back, so no node's neighbourhood is
ever gathered, and the edges never leave the executors. A step's result is a table in the shared
folder, which cuts the lineage. Joins are by sort and merge: files of equal and growing keys are far smaller than
their rows, and the planner would broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from .storage import stored

#: Bytes of edges that are made into stars at a time.
BLOCK = 32 << 20


def _stars(edges: list[pa.RecordBatch]) -> pa.Table:
    """(node, root) for every node of edges (hi, lo); root is the least node that it reaches by them."""
    table = pa.Table.from_batches(edges)
    coded = pa.concat_arrays([*table["hi"].chunks, *table["lo"].chunks]).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    names, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    u, v = np.split(rank[coded.indices.to_numpy()], 2)
    up = np.arange(len(order))
    while len(u):
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while (further := up[up]).tobytes() != up.tobytes():
            up = further
        u, v = up[u], up[v]
        u, v = u[u != v], v[u != v]
    return pa.table({"node": names, "root": names.take(pa.array(up))})


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BLOCK:
            yield from _stars(held).to_batches(100_000)
            held = []
    if held:
        yield from _stars(held).to_batches(100_000)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node of its component.

    edges: two columns of one orderable type that Arrow sorts as Spark does, such as whole numbers or strings. Null ends and loops make
    no edge; repeated edges count once. Nodes without an edge to another node are not in the result.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    kind = e.schema["lo"].dataType
    stars = e.repartitionByRange("lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(_rooted, StructType([StructField("node", kind), StructField("root", kind)]))
    # a node has a row for each block that it is in, the least root first; each further root is linked to the one before
    stars = stored(stars.withColumn("before", F.lag("root").over(Window.partitionBy("node").orderBy("root"))), "stars")
    first = stars.where("before is null").select("node", "root")
    e = stored(stars.where("before <> root").select(F.col("root").alias("hi"), F.col("before").alias("lo")).distinct(), "edges")
    before = None
    width = F.octet_length(F.col("hi").cast("string")) + F.octet_length(F.col("lo").cast("string")) + 32  # in Arrow no more
    while True:  # ends after a number of rounds that grows with the square of the nodes' logarithm at most
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(width)).first()
        if now[0] == 0 or now == before:
            break
        before = now
        if now[2] <= BLOCK:
            e = stored(e.coalesce(1).mapInArrow(_rooted, stars.select("node", "root").schema).where("node <> root").toDF("hi", "lo"), "edges")
            break
        both = e.union(e.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low.hint("merge"), "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low)
        e = stored(small.distinct(), "edges")
    if before is None:
        return first.withColumnRenamed("root", "component")
    roots = e.select(F.col("hi").alias("root"), F.col("lo").alias("component"))
    return first.join(roots.hint("merge"), "root", "left").select("node", F.coalesce("component", "root").alias("component"))
