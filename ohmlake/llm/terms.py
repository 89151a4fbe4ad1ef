"""Sums over the terms of each text of a value that is computed once for each distinct term.

The distinct terms of a corpus grow with it, so their table is never broadcast. Only its head is:
at most ``HOT`` terms, those with the highest counts, which a histogram of the counts picks. A term
outside it stands for no more than about 1.2 / HOT of all occurrences, so the shuffled join that
serves the rest has no hot key. Both ways give the same sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import steps, texts

#: Terms that are broadcast at most.
HOT = 1 << 18
#: Distinct terms that a task counts before it hands them on.
FLUSH = 400_000


def count_terms(df: DataFrame, text: str, split: Callable[[str], list[str]], flag: Column | None = None) -> DataFrame:
    """(term, n, n_flag): how often each term stands in the texts, and in those where flag is true."""
    flag = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))

    def run(batches):
        all_, own = Counter(), Counter()

        def rows():
            get = own.get
            batch = pa.RecordBatch.from_pydict({"term": pa.array(all_.keys(), pa.string()), "n": pa.array([n + get(t, 0) for t, n in all_.items()], pa.int64()), "m": pa.array([get(t, 0) for t in all_], pa.int64())})
            rest = [t for t in own if t not in all_]
            counts = pa.array([own[t] for t in rest], pa.int64())
            yield batch
            yield pa.RecordBatch.from_pydict({"term": pa.array(rest, pa.string()), "n": counts, "m": counts})
            all_.clear()
            own.clear()

        for batch in (step for whole in batches for step in steps(whole, 0)):
            for t, x in zip(texts(batch.column(0)).to_pylist(), batch.column(1).to_pylist()):
                (own if x else all_).update(split(t))
                if len(all_) + len(own) > FLUSH:
                    yield from rows()
        yield from rows()

    counted = df.select(text, flag.alias("f")).mapInArrow(run, "term string, n long, m long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("m").alias("n_flag"))


def head(values: DataFrame, most: int = HOT) -> int:
    """The least n such that not more than about ``most`` terms have as many."""
    step = F.floor(F.log2("n") * 4)
    sizes = sorted((r[0], r[1]) for r in values.groupBy(step.alias("step")).count().collect())
    total, least = 0, None
    for k, size in reversed(sizes):  # 256 at most
        if total + size > most:
            break
        total, least = total + size, k
    return least if least is not None else 1 << 20


def term_sums(df: DataFrame, ids: list[str], text: str, split: Callable[[str], list[str]], values: DataFrame, columns: list[str], kinds: list[str], more: Callable[[list[str], str], list] | None = None, more_fields: list[tuple[str, str]] = (), hot: int = HOT) -> DataFrame:
    """One row for each row of df: ids, more_fields of its text, and the sums of columns over its terms.

    values: (term, n, *columns), a stored table with every term. Columns other than ids are not kept,
    so none can clash. Rows that repeat in ids and text each get a row.
    """
    step = F.floor(F.log2("n") * 4)
    least = head(values, hot)
    known = {r[0]: tuple(r[1:]) for r in values.where(step >= least).select("term", *columns).collect()}
    shared = df.sparkSession.sparkContext.broadcast(known)
    id_fields = [df.select(x).schema[0] for x in ids]
    n_ids, n_values = len(ids), len(columns)
    names = [f"id{i}" for i in range(n_ids)]
    base = df.select(*[F.col(x).alias(y) for x, y in zip(ids, names)], F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64(*names, "text"))
    fields = ["heads", *[n for n, _ in more_fields], *[f"s{i}" for i in range(n_values)], "term", "times"]
    numbers = [pa.float64() if k == "double" else pa.int64() for k in kinds]
    more_kinds = [pa.float64() if k == "double" else pa.int64() for _, k in more_fields]
    ddl = ", ".join([*[f"{n} {f.dataType.simpleString()}" for n, f in zip(names, id_fields)], "mark long, heads long", *[f"{n} {k}" for n, k in more_fields], *[f"s{i} {k}" for i, k in enumerate(kinds)], "term string, times long"])

    def run(batches):
        get, zero = shared.value.get, [0.0 if k == "double" else 0 for k in kinds]
        for batch in (step for whole in batches for step in steps(whole, n_ids)):
            n = batch.num_rows
            sums, extra, at, term, times = [[] for _ in kinds], [[] for _ in more_fields], [], [], []
            for i, t in enumerate(texts(batch.column(n_ids)).to_pylist()):
                own = split(t)
                total = list(zero)
                if n_values == 1:
                    one = zero[0]
                    for x, k in Counter(own).items():
                        v = get(x)
                        if v is None:
                            at.append(i)
                            term.append(x)
                            times.append(k)
                        else:
                            one += k * v[0]
                    total[0] = one
                else:
                    for x, k in Counter(own).items():
                        v = get(x)
                        if v is None:
                            at.append(i)
                            term.append(x)
                            times.append(k)
                        else:
                            for j, y in enumerate(v):
                                total[j] += k * y
                for s, y in zip(sums, total):
                    s.append(y)
                for s, y in zip(extra, more(own, t) if more else ()):
                    s.append(y)
            keys = batch.columns[:n_ids] + [batch.column(n_ids + 1)]
            row = lambda cols, heads, ex, sm, tm, ti: pa.RecordBatch.from_arrays([*cols, heads, *ex, *sm, tm, ti], names=[*names, "mark", *fields])
            yield row(keys, pa.array([1] * n, pa.int64()), [pa.array(x, k) for x, k in zip(extra, more_kinds)], [pa.array(x, k) for x, k in zip(sums, numbers)], pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()))
            if at:
                m = len(at)
                where = pa.array(at, pa.int64())
                yield row([c.take(where) for c in keys], pa.array([0] * m, pa.int64()), [pa.nulls(m, k) for k in more_kinds], [pa.nulls(m, k) for k in numbers], pa.array(term, pa.string()), pa.array(times, pa.int64()))

    rows = base.mapInArrow(run, ddl)
    rest = values.where(step < least).select(F.concat(F.lit("t"), "term").alias("key"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    # a row that stands for its text's hot terms has no term; a key of its own keeps those rows from meeting in one task
    key = F.coalesce(F.concat(F.lit("t"), "term"), F.concat(F.lit("h"), F.col("mark").cast("string")))
    joined = rows.withColumn("key", key).drop("term").join(rest.hint("merge"), "key", "left")
    part = [F.sum(F.coalesce(F.col(f"s{i}"), F.col(f"v{i}") * F.col("times"))).alias(f"t{i}") for i in range(n_values)]
    whole = joined.groupBy(*names, "mark").agg(F.sum("heads").alias("copies"), *[F.max(n).alias(n) for n, _ in more_fields], *part)
    # rows that repeat have added their rest once each, to sums that stand for all of them
    one = [(F.col(f"t{i}") / F.col("copies")).cast(k).alias(c) if k == "double" else F.expr(f"t{i} div copies").alias(c) for i, (c, k) in enumerate(zip(columns, kinds))]
    return whole.select(*[F.col(y).alias(x) for x, y in zip(ids, names)], *[n for n, _ in more_fields], *one, F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy")
