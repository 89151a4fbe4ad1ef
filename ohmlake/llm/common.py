"""Helpers that the training-data operators share.

Rules that hold for every operator of this folder, unless its docstring says otherwise:

* a null text is an empty text;
* rows are never merged or dropped because they repeat, and row order does not matter;
* columns that an operator adds replace columns of the same name, as ``withColumn`` does;
  all other columns pass through;
* an empty table gives an empty table of the same schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from ohmlake.plans.storage import forget, fresh_folder, stored  # noqa: F401

#: Text that one step of numpy work takes at once; a longer single text makes a step of its own.
SLICE_BYTES = 1 << 18
#: Text whose rows one step of a batch takes: what Python makes of it is handed on before the next step.
STEP_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(column: pa.Array) -> pa.Array:
    """A string column with 64-bit offsets and no nulls."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of consecutive runs of texts, each of about ``most`` bytes; offsets start at 0."""
    column = texts(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def steps(batch: pa.RecordBatch, place: int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts or bytes have about ``most`` bytes; a longer single one makes a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        done = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def with_columns(df: DataFrame, text: str, fields: list[tuple[str, str]], make: Callable[[], Callable[[pa.Array], list]], drop_text: bool = False) -> DataFrame:
    """df with columns computed from its text (or binary) column, step by step, in Arrow; no shuffle.

    make() runs once a task and returns a function from a text column to one array per field. A column that
    is added replaces one of its name, the text column included.
    """
    names = [n for n, _ in fields]
    added = [StructField(n, _parse_datatype_string(t)) for n, t in fields]
    kinds = [arrow_type(f.dataType) for f in added]
    taken = {n.lower() for n in names}
    base = df.drop(*[n for n in names if n.lower() != text.lower()])
    place = [f.name.lower() for f in base.schema.fields].index(text.lower())
    if drop_text or text.lower() in taken:
        keep = [i for i in range(len(base.columns)) if i != place]
    else:
        keep = list(range(len(base.columns)))
    kept = [base.schema.fields[i] for i in keep]

    def run(batches):
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            for step in steps(batch, place):
                out = work(step.column(place))
                new = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([step.column(i) for i in keep] + new, names=[f.name for f in kept] + names)
        del work
        pa.default_memory_pool().release_unused()  # the worker may idle for long

    return base.mapInArrow(run, StructType(kept + added))


def arrow_type(kind: DataType) -> pa.DataType:
    return to_arrow_type(kind)


def crc_mod(column: str, n: int):
    """crc32 of an id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def per_doc(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive runs whose lengths are counts."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
