"""N-gram Jaccard join by a blocked sparse product (operator 8).

Documents that have the same set of word shingles are one class; only classes are joined. The
incidence matrix of classes by shingles is multiplied by its transpose, block by block:

1. Size-derived columns. A class of n shingles that links to any other shares at least
   ceil(t * n) of them, so of any fixed order of shingles its first n - ceil(t * n) + 1 must meet
   the other's. Only these entries are multiplied, each with its place in that order. The order is by how
   often shingles occur, counted in ``CELLS`` cells over all texts: rare ones first, so columns are thin.
2. Each column (its pieces of about ``PIECE`` entries, and then those pieces' pivots) links its
   classes to one of them, its pivot, not to one another: one pair an entry, whatever the size of a
   group of near copies. The pivot is the class with the most common shingles (the mean of their logarithms): the middle
   of a group of near copies, to which most of them link.
3. A pair goes at once if its overlap cannot reach the bound that the two sizes give: if the column
   is the first that it shares, no more than the places behind are left. Every pair that links
   passes this at its first column.
4. The overlaps of the pairs that remain are accumulated by blocks of the product, a block being one class (the
   pivot) against a piece of its partners: first over the size-derived columns, after which a pair goes if the
   places behind the last shared one cannot reach the bound; then over all columns, as sorted arrays,
   which gives the exact count. For that, sets are made again from the texts for classes in such pairs (a Bloom
   filter picks them), rather than kept.
5. Columns whose classes are not in one component by then are multiplied in full, but only between
   components and under the same bound, and their pairs go through step 4 as well. So no link is
   lost, and no pairs are made within a group of near copies beyond those with pivots.

The counts steer order and pivots only; results do not depend on them. Shingles are told apart by 64
bits of a hash (by 48 in the sets of step 4), sets by 128 and, as nodes of the graph of links, by 63 of these.

A document without words links to nothing. Null ids are never a component's id unless no member has
one; documents that share an id but not a set stay different documents.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ohmlake.plans.components import connected_components
from ohmlake.plans.joins import lookup

from .common import forget, read, stored
from .shingles import Powers, sets

#: Cells in which the occurrences of shingles are counted, and the cells of one part of them. All counts together are
#: 4 bytes a cell, on the driver and in a task, whatever the size of the corpus; they stop at MOST.
CELLS = 1 << 22
PART = 1 << 16
MOST = (1 << 32) - 1
#: Entries of a column, and partners of a pivot, that one piece has (about).
PIECE = 1 << 16
PARTNERS = 1 << 8
#: Bits of the Bloom filter of wanted classes: 16 a class within these bounds (32 MB at most). With more
#: classes than the largest is for, more sets are made and then dropped; results are the same.
BLOOM = (16, 28)
REMEMBERED = 300_000
#: Bits of a class's number in the graph of links.
NODE_BITS = 63
#: Bytes of a shingle's hash in the sets that are sent to be compared. No link is lost by it, as counts can only rise: for two sets of
#: m shingles each, by one with a chance of m * m / 2^48, which matters where they are one short of the bound.
SET_BYTES = 6


def keys(hashes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int] | None]:
    """128 bits for each set; None for an empty one."""
    raw = memoryview(np.ascontiguousarray(hashes)).cast("B") if len(hashes) else memoryview(b"")
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if a == b:
            out.append(None)
            continue
        d = blake2b(raw[8 * a : 8 * b], digest_size=16).digest()
        out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
    return out


def node_of(k0: str) -> Column:
    """A class's number from its key."""
    return F.shiftrightunsigned(k0, 64 - NODE_BITS)


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def signatures(df: DataFrame, id_: str, text: str, k: int) -> DataFrame:
    """A row for each text: id, t (a hash of the text), n, k0, k1; and rows (part, counts): the task's counts of a part of the cells."""

    def run(batches):
        powers, count, kind = Powers(), np.zeros(CELLS, np.uint32), None  # a task has fewer shingles than that holds
        for batch in batches:
            kind = batch.column(0).type
            at = 0
            for hashes, offsets in sets(batch.column(2), k, powers):
                n = len(offsets) - 1
                own = keys(hashes, offsets)
                sizes = [pa.array(np.diff(offsets).astype(np.int64)), pa.array([x and x[0] for x in own], pa.int64()), pa.array([x and x[1] for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), *sizes, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
                at += n
                if len(hashes) > CELLS >> 4:
                    count += np.bincount(cells(hashes), minlength=CELLS).astype(np.uint32)
                else:
                    np.add.at(count, cells(hashes), np.uint32(1))
        if kind is None:
            return
        for part in range(CELLS // PART):
            own = count[part * PART : (part + 1) * PART]
            if own.any():
                data = own.astype(np.uint8 if own.max() < 256 else np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 4, pa.array([part], pa.int64()), pa.array([data], pa.binary())], names=names)

    names = ["id", "t", "n", "k0", "k1", "part", "counts"]
    id_kind = df.select(id_).schema[0].dataType.simpleString()
    rows = df.select(F.col(id_).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {id_kind}, t long, n long, k0 long, k1 long, part long, counts binary")


def occurrences(counts: DataFrame) -> np.ndarray:
    """All cells' counts from the tasks' (part, counts)."""

    def run(batches):
        part, total = None, None
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != part:
                    if part is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.clip(max=MOST).astype(np.uint32).tobytes()], pa.binary())], names=["part", "counts"])
                    part, total = at, np.zeros(PART, np.int64)
                total += np.frombuffer(data, np.uint8 if len(data) == PART else np.uint32)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.clip(max=MOST).astype(np.uint32).tobytes()], pa.binary())], names=["part", "counts"])

    summed = counts.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part long, counts binary").collect()
    out = np.zeros(CELLS, np.uint32)
    for r in summed:  # CELLS / PART rows
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], np.uint32)
    return out


def columns(df: DataFrame, text: str, k: int, percent: int, counts) -> DataFrame:
    """ENTRY: the size-derived entries of each class, once a task; counts: of the cells, broadcast.

    pos is the entry's place in the class's order of shingles, from 1; central is the mean logarithm of its shingles'
    counts; piece is 0, or from 1 where the column is so large that it has several.
    """
    most_entries = PIECE

    def run(batches):
        table = counts.value
        usual = 2 * int(table.mean())  # what a cell has by chance
        powers, seen = Powers(), set()
        for batch in batches:
            for hashes, offsets in sets(batch.column(0), k, powers):
                weight = table[cells(hashes)]
                logs = np.concatenate([[0.0], np.cumsum(np.log2(weight.astype(float) + 1.0))])
                out, heavy, nodes, means, sizes, ns = [], [], [], [], [], []
                for key, a, b in zip(keys(hashes, offsets), offsets[:-1].tolist(), offsets[1:].tolist()):
                    if key is None or key in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    n = b - a
                    most = n + (-percent * n // 100) + 1
                    own = weight[a:b]
                    first = np.argsort(own, kind="stable")[:most]  # sorted by hash already, so this is by (count, hash)
                    out.append(hashes[a:b][first])
                    heavy.append(own[first])
                    nodes.append((key[0] & (1 << 64) - 1) >> 64 - NODE_BITS)
                    means.append((logs[b] - logs[a]) / n)
                    sizes.append(most)
                    ns.append(n)
                if not out:
                    continue
                sizes, node = np.array(sizes), np.array(nodes, np.int64)
                pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                pieces = np.maximum(np.concatenate(heavy).astype(np.int64) - usual, 0) // most_entries + 1
                piece = np.where(pieces > 1, np.repeat(node >> 20, sizes) % pieces + 1, 0)
                central = np.repeat((np.array(means) * 512).astype(np.int16), sizes)
                made = [np.concatenate(out).view(np.int64), piece.astype(np.int32), central, np.repeat(node, sizes), pos.astype(np.int32), np.repeat(np.array(ns), sizes).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=[x.split()[0] for x in ENTRY.split(", ")])

    return df.select(text).mapInArrow(run, ENTRY)


ENTRY = "shingle long, piece int, central short, node long, pos int, n int"
MEMBER = ENTRY + ", p long, pos_p int, n_p int"


def members(entries: DataFrame) -> DataFrame:
    """MEMBER: the entries of columns with two classes or more, and of all pieces of columns, each beside its column's
    or piece's pivot, which is the most central class. A pivot's own entry is beside itself."""

    def run(batches):
        last = None  # the pivot of the column that the last batch ended in, and whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            again = False
            if last is not None:
                cols = [np.concatenate([x, c]) for x, c in zip(last[0], cols)]
                again = last[1]
            same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
            once = np.concatenate([[True], ~(same & (cols[3][1:] == cols[3][:-1]))])  # several tasks may have seen a class
            cols = [c[once] for c in cols]
            same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            sizes = np.diff(np.append(starts, len(cols[0])))
            pivot = np.repeat(starts, sizes)
            give = (np.repeat(sizes, sizes) > 1) | (cols[1] > 0)
            if again:
                give[0] = False
            first = starts[-1]
            last = [c[first : first + 1].copy() for c in cols], bool(sizes[-1] > 1 or cols[1][first] > 0 or again and first == 0)
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[give]) for c in cols] + [pa.array(cols[i][pivot[give]]) for i in (3, 4, 5)], names=[x.split()[0] for x in MEMBER.split(", ")])

    dealt = entries.repartition("shingle", "piece").sortWithinPartitions("shingle", "piece", F.desc("central"), "node")
    return dealt.mapInArrow(run, MEMBER)


def reach(percent: int, pos: str = "pos", n: str = "n", pos_b: str = "pos_p", n_b: str = "n_p") -> Column:
    """Whether two classes can link if this is the first column that they share."""
    left = F.least(F.col(n) - F.col(pos), F.col(n_b) - F.col(pos_b)).cast("long") + 1
    return left * (100 + percent) >= (F.col(n).cast("long") + F.col(n_b)) * percent


def chosen_sets(df: DataFrame, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(node, items): the sorted sets, packed, of the wanted nodes and of few others; a set may come once a task."""
    least, most = BLOOM
    bits = min(most, max(least, (wanted.count() * 16).bit_length()))
    mask = (1 << bits) - 1
    bit = F.explode(F.array(F.col("node").bitwiseAND(mask), F.shiftright("node", NODE_BITS - bits).bitwiseAND(mask)))
    filled = wanted.select(bit.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[filled["w"].to_numpy()] = filled["x"].to_numpy()  # as many rows as the filter has words, at most
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table, powers, seen = shared.value, Powers(), set()
        has = lambda p: (table[p >> 6] >> (p & 63)) & 1 == 1
        for batch in batches:
            for hashes, offsets in sets(batch.column(0), k, powers):
                own = keys(hashes, offsets)
                some = np.array([i for i, x in enumerate(own) if x is not None and x not in seen], np.int64)
                if not len(some):
                    continue
                node = (np.array([own[i][0] for i in some], np.int64).view(np.uint64) >> np.uint64(64 - NODE_BITS)).astype(np.int64)
                ok = np.flatnonzero(has(node & mask) & has(node >> (NODE_BITS - bits) & mask))
                if not len(ok):
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.update(own[some[i]] for i in ok)
                sizes = np.diff(offsets)[some[ok]]
                at = np.repeat(offsets[some[ok]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(node[ok]), packed(hashes[at], sizes)], names=["node", "items"])

    return df.select(text).mapInArrow(run, "node long, items binary")


def packed(hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Sorted hashes of consecutive sets, each set as bytes: the highest SET_BYTES bytes of every hash, which keep the order."""
    data = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - SET_BYTES :])
    ends = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes) * SET_BYTES]).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, ends, pa.py_buffer(data)]).cast(pa.binary())


def unpacked(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, with nothing in the lower bytes; where each set ends, from 0)."""
    _, ends, data = items.buffers()
    ends = np.frombuffer(ends, np.int32)[items.offset : items.offset + len(items) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    wide = np.zeros((len(raw) // SET_BYTES, 8), np.uint8)
    wide[:, 8 - SET_BYTES :] = raw.reshape(-1, SET_BYTES)
    return wide.view("<u8").ravel(), (ends - ends[0]) // SET_BYTES


def blocks_of(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, piece) for each pair and (b, piece) for each block: b's partners in pieces of about PARTNERS."""
    count = pairs.groupBy("b").agg(F.count("*").alias("m")).withColumn("pieces", F.ceil(F.col("m") / PARTNERS))
    count = stored(count, "blocks")
    many = count.where("pieces > 1").select("b", "pieces")  # fewer than one in PARTNERS pairs
    dealt = pairs.join(many, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("pieces", F.lit(1))).alias("piece"))
    return dealt, count.select("b", F.explode(F.expr("sequence(0L, pieces - 1)")).alias("piece"))


def bounded(entries: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that can still link by the overlap that their size-derived columns accumulate.

    entries: (node, shingle, pos, n), all columns that two nodes share. Behind the last column that a pair shares
    no more than the places left can be common.
    """
    dealt, blocks = blocks_of(pairs)
    a = dealt.join(entries.hint("merge"), F.col("a") == F.col("node")).select("a", "b", "piece", "shingle", "pos", "n")
    b = blocks.join(entries.hint("merge"), F.col("b") == F.col("node")).select("b", "piece", "shingle", F.col("pos").alias("pos_b"), F.col("n").alias("n_b"))
    both = a.join(b.hint("merge"), ["b", "piece", "shingle"]).groupBy("a", "b").agg(F.count("*").alias("common"), *[F.max(x).cast("long").alias(x) for x in ("pos", "pos_b", "n", "n_b")])
    most = F.col("common") + F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b"))
    return both.where(most * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent).select("a", "b")


def overlaps(df: DataFrame, text: str, k: int, pairs: DataFrame) -> DataFrame:
    """(a, b, overlap, size_a, size_b): the pairs (a, b) of nodes with the exact counts of their shingles.

    Each block of the product is the row of one b times the columns of a piece of its partners.
    """
    wanted = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    dealt, blocks = blocks_of(pairs)
    heads = blocks.select(F.col("b").alias("node"), F.col("b").alias("block"), "piece", F.lit(0).alias("side"))
    places = stored(heads.union(dealt.select("a", "b", "piece", F.lit(1))), "places")

    def run(batches):
        at, base = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, piece, side, node = (batch.column(i).to_numpy() for i in range(4))
            values, ends = unpacked(batch.column(4))
            turns = np.flatnonzero((block[1:] != block[:-1]) | (piece[1:] != piece[:-1]) | (side[1:] != side[:-1])) + 1
            out = [[], [], [], [], []]
            for i, j in zip([0, *turns.tolist()], [*turns.tolist(), len(block)]):
                if side[i] == 0:
                    at, base = (block[i], piece[i]), values[ends[i] : ends[i + 1]].copy()
                    continue
                if at != (block[i], piece[i]):
                    raise ValueError("a block without its own set")
                own = values[ends[i] : ends[j]]
                place = np.minimum(np.searchsorted(base, own), len(base) - 1)
                count = np.add.reduceat((base[place] == own).astype(np.int64), ends[i:j] - ends[i])
                for x, y in zip(out, (node[i:j], block[i:j], count, np.diff(ends[i : j + 1]), np.full(j - i, len(base)))):
                    x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["a", "b", "overlap", "size_a", "size_b"])

    made = places.hint("shuffle_hash").join(chosen_sets(df, text, k, wanted), "node").select("block", "piece", "side", "node", "items")
    made = made.repartition("block", "piece").sortWithinPartitions("block", "piece", "side")
    out = stored(made.mapInArrow(run, "a long, b long, overlap long, size_a long, size_b long").distinct(), "overlaps")
    forget(wanted, places)
    return out


def linked(df: DataFrame, text: str, k: int, percent: int, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that link."""
    return overlaps(df, text, k, pairs).where(F.col("overlap") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("overlap")) * percent).select("a", "b")


def classes_and_components(df: DataFrame, id_: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: id, t, n, k0, k1) and (classes: k0, k1, rows, component, component_id), stored tables."""
    spark = df.sparkSession
    made = stored(signatures(df, id_, text, k), "signatures")
    rows = made.where("n is not null").select("id", "t", "n", "k0", "k1")
    classes = stored(made.where("k0 is not null").groupBy("k0", "k1").agg(F.count("*").alias("rows"), F.min("id").alias("first")).withColumn("node", node_of("k0")), "classes")
    counts = spark.sparkContext.broadcast(occurrences(made.where("part is not null").select("part", "counts")))

    thick = stored(members(columns(df, text, k, percent, counts)), "members")
    tops = stored(members(thick.where("piece > 0 and node = p").select("shingle", F.lit(0).alias("piece"), "central", "node", "pos", "n")), "tops")
    spokes = thick.union(tops).where(F.col("node") != F.col("p")).where(reach(percent))
    first = stored(spokes.select(F.col("node").alias("a"), F.col("p").alias("b")).distinct(), "pairs")
    entries = thick.select("node", "shingle", "pos", "n")
    pairs = stored(bounded(entries, first, percent), "pairs")
    edges = linked(df, text, k, percent, pairs)
    parts = connected_components(edges)

    placed = entries.join(parts, "node", "left")
    placed = placed.select("shingle", "node", "pos", "n", F.coalesce("component", "node").alias("c"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("shingle").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("m")).where("x < y and m > 2").select("shingle")
    open_ = stored(placed.join(mixed.hint("merge"), "shingle", "left_semi"), "open")
    forget(placed, tops)
    other = open_.toDF("shingle_b", "node_b", "pos_p", "n_p", "c_b")
    more = open_.join(other.hint("merge"), (F.col("shingle") == F.col("shingle_b")) & (F.col("c") < F.col("c_b")) & reach(percent))
    more = more.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    tried = first.union(first.select("b", "a"))
    more = stored(more.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = stored(bounded(entries, more, percent), "pairs")
    forget(open_, thick)
    if not more.isEmpty():
        parts = connected_components(edges.union(linked(df, text, k, percent, more)))
    grouped = stored(classes.join(parts, "node"), "grouped")
    least = stored(grouped.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("rows")), "least")
    found = lookup(grouped.select("k0", "k1", F.col("rows").alias("n_rows"), "component"), least, ["component"]).select("k0", "k1", "n_rows", "component", "component_id")
    alone = classes.join(parts, "node", "left_anti").select("k0", "k1", F.col("rows").alias("n_rows"), F.col("node").alias("component"), F.col("first").alias("component_id"))
    return rows, stored(found.union(alone).withColumnRenamed("n_rows", "rows"), "components")


def components(df: DataFrame, id_: str, text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) for each row of df; other columns are not kept.

    component_id: the least id that links lead to, the row's own included.
    """
    rows, classes = classes_and_components(df, id_, text, k, percent)
    found = lookup(rows.where("k0 is not null").select("id", "n", "k0", "k1"), classes.select("k0", "k1", "rows", "component_id"), ["k0", "k1"])
    found = found.select("id", "n", "component_id").union(rows.where("k0 is null").select("id", "n", "id"))
    return found.toDF(id_, "n_shingles", "component_id")


def one_of_each(df: DataFrame, id_: str, text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df without near duplicates: of each component the row with the least id stays.

    Rows without words stay. If several texts have the least id, the one with the least hash stays; of
    rows that repeat in id and text, one. Components in which no row has an id keep one row.
    """
    rows, classes = classes_and_components(df, id_, text, k, percent)
    worded = rows.where("k0 is not null")
    row_key = [F.col("id").isNull().alias("x"), F.coalesce(F.col("id"), F.lit(0)).alias("y"), F.col("t")]
    placed = stored(lookup(worded.select("id", "t", "k0", "k1"), classes.select("k0", "k1", "rows", "component"), ["k0", "k1"]).select("component", *row_key), "placed")
    best = placed.groupBy("component").agg(F.min(F.struct("x", "y", "t")).alias("s")).select("s.*")
    counted = placed.groupBy("x", "y", "t").agg(F.count("*").alias("rows"))
    best = stored(counted.join(best, ["x", "y", "t"]), "best").select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("t").alias("_t"), F.col("rows").alias("_rows"))
    forget(placed)
    names = df.columns
    docs = df.select(F.struct(*names).alias("_row"), F.col(id_).isNull().alias("_x"), F.coalesce(F.col(id_), F.lit(0)).alias("_y"), F.xxhash64(text).alias("_t"), (F.trim(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")) == "").alias("_empty"))
    on = ["_x", "_y", "_t"]
    wordless = docs.where("_empty").select("_row.*")
    found = docs.where("not _empty").join(best, on)
    once = found.where("_rows = 1").select("_row.*")
    again = found.where("_rows > 1").dropDuplicates(on).select("_row.*")
    return wordless.unionByName(once).unionByName(again)


def op8_jaccard_components(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return components(docs, "doc_id", k=3, percent=90)


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id
"""
