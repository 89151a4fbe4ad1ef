"""Importance resampling towards a target distribution (operator 13).

A text's features are its runs of 1 to ``most`` consecutive words, joined by one space, repeats counted; a
feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. Counts of the buckets over all source
and over all target texts give each bucket a gain in log-likelihood (target against source), smoothed by one
a bucket. A document's weight is the mean gain of its features; a Gumbel draw added to it and a cut by rank
sample documents without replacement in proportion to exp(weight).

Features are never built. Each text, its words joined by one space, is scanned once, and the running CRC at
every word's end is stored. The CRC of any run of words follows from two of them: the one at its end, and the
one at its beginning shifted over the run's length, a linear map over GF(2) that cancels what stands before:

    crc(run) = crc(prefix to its end) xor shift(crc(prefix to its beginning), bytes of the run)

Shifts over up to 255 bytes are four table look-ups; longer ones add a look-up for each power of two.

Words: A-Z in lower case, then runs of letters, digits and non-ASCII characters. A null or empty text has
no words and no features, and weight 0. A null id draws as an empty id does. Repeated ids have the same draw;
their order is that of their weights and feature counts. Empty tables: no source rows give no rows; no target
rows leave every bucket its smoothing. Columns that are added replace columns of the same name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import per_doc, read, slices, stored, with_columns

BUCKETS = 10_000
MOST_WORDS = 2
SCALE = 1000

# Fixed value: the reflected polynomial of CRC-32.
_POLY = 0xEDB88320

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _times_byte(crc: np.ndarray) -> np.ndarray:
    """Registers shifted over one zero byte."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(_POLY) * (crc & np.uint32(1)))
    return crc


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(by length 0 to 255, by power of two from 256 on): each [place of the byte, its value] to its shifted register."""
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = [one]
    for _ in range(256):
        short.append(_times_byte(short[-1]))
    powers = [short.pop()]
    while len(powers) < 24:  # 2^31 bytes and more
        powers.append(_through(powers[-1], powers[-1]))
    return np.stack(short).reshape(256, 1024), np.stack(powers)


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return table[0][crc & byte] ^ table[1][(crc >> np.uint32(8)) & byte] ^ table[2][(crc >> np.uint32(16)) & byte] ^ table[3][crc >> np.uint32(24)]


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers (uint32) shifted over so many bytes each."""
    short, powers = _tables()
    low = lengths & 255
    byte = np.uint32(255)
    out = short[low, crc & byte] ^ short[low, 256 + ((crc >> np.uint32(8)) & byte)] ^ short[low, 512 + ((crc >> np.uint32(16)) & byte)] ^ short[low, 768 + (crc >> np.uint32(24))]
    high = lengths >> 8
    for bit in range(int(high.max(initial=0)).bit_length()):
        some = np.flatnonzero((high >> bit) & 1)
        out[some] = _through(powers[bit], out[some])
    return out


def running(words: list[bytes]) -> np.ndarray:
    """CRC-32 of the words' line, joined by one space, up to the end of each word: one pass over the line."""
    if not words:
        return np.zeros(0, np.uint32)
    line = iter(words)
    ends = accumulate(line, lambda crc, word: zlib.crc32(word, zlib.crc32(b" ", crc)), initial=zlib.crc32(next(line)))
    return np.fromiter(ends, np.uint32, len(words))


def crcs(data: np.ndarray, offsets: np.ndarray, most: int = MOST_WORDS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a slice of texts: words a text, and for each run length the CRCs of all runs and how many each text has."""
    plain = data.tobytes().translate(_TABLE)
    at = offsets.tolist()
    lines = [plain[a:b].split() for a, b in zip(at, at[1:])]
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.concatenate([np.zeros(0, np.uint32), *map(running, lines)])
    sizes = np.fromiter((len(w) for line in lines for w in line), np.int64, len(ends))
    first = np.cumsum(counts) - counts
    # the register at a word's beginning: a space after the end before it, and nothing before a text's first word
    before = np.empty_like(ends)
    before[1:] = _step(ends[:-1], 32)
    before[first[counts > 0]] = 0
    stop = np.cumsum(sizes + 1)
    start = stop - sizes - 1
    last = np.repeat(first + counts, counts)  # one past the last word of a word's text
    found = []
    for n in range(1, most + 1):
        own = np.flatnonzero(np.arange(len(ends)) + n <= last)
        to = own + n - 1
        found.append((ends[to] ^ shifted(before[own], stop[to] - 1 - start[own]), np.maximum(counts - n + 1, 0)))
    return counts, found


def _step(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRC-32 of what crc is of, and one byte more."""
    full, table = np.uint32(0xFFFFFFFF), _tables()[0][1]
    crc = crc ^ full
    return (crc >> np.uint32(8)) ^ table[(crc ^ np.uint32(byte)) & np.uint32(255)] ^ full


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, most: int = MOST_WORDS) -> DataFrame:
    """(bucket long, features long) over all texts, buckets without features left out; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, offsets in slices(batch.column(0)):
                for crc, _ in crcs(data, offsets, most)[1]:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "features"])

    return df.select(text).mapInArrow(run, "bucket long, features long").groupBy("bucket").agg(F.sum("features").alias("features"))


def _dense(counts: DataFrame, buckets: int) -> list[int]:
    """At most one row a bucket comes to the driver."""
    found = dict(map(tuple, counts.collect()))
    return [found.get(i, 0) for i in range(buckets)]


def gains(source: list[int], target: list[int], scale: int = SCALE) -> np.ndarray:
    """Of each bucket: floor(scale * ln of its smoothed share of the target's features over that of the source's)."""
    n, s, t = len(source), sum(source), sum(target)
    return np.array([math.floor(scale * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source, target)], np.int64)


def weighted(df: DataFrame, gain: np.ndarray, text: str = "text", most: int = MOST_WORDS, drop_text: bool = False) -> DataFrame:
    """df with n_words, n_features and weight, the floored mean gain of the text's features (0 without features)."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def make():
        own = shared.value

        def work(column: pa.Array) -> list:
            words, features, sums = [], [], []
            for data, offsets in slices(column):
                n, runs = crcs(data, offsets, most)
                words.append(n)
                features.append(sum(c for _, c in runs))
                sums.append(sum(per_doc(own[crc % np.uint32(len(own))], c) for crc, c in runs))
            n, total = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (features, sums))
            return [pa.array(np.concatenate([np.zeros(0, np.int64), *words])), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))]

        return work

    return with_columns(df, text, [("n_words", "bigint"), ("n_features", "bigint"), ("weight", "bigint")], make, drop_text)


def gumbel(id_: str, seed: int, scale: int = SCALE) -> Column:
    """floor(scale * a Gumbel draw) that follows from the seed and the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-F.lit(float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(df: DataFrame, id_: str, percent: int, least_words: int, name: str = "drawn") -> DataFrame:
    """df (id, n_words, n_features, weight, score) with rank: 1 for the highest score among the drawn, null for the rest.

    Scores are whole numbers of a bounded range, so how many documents have a higher one is a small table,
    whatever the number of rows; within a score documents are numbered by id. As ids draw by themselves, no
    score has more than a 2700th (1 / (e * scale)) of the rows, but for rows that repeat an id.
    """
    rows = stored(df, name)
    may = rows.where(F.col("n_words") >= least_words)
    per_score = {r[0]: r[1] for r in may.groupBy("score").count().collect()}  # as many as there are scores
    drawn, above, start = percent * sum(per_score.values()) // 100, 0, []
    for score in sorted(per_score, reverse=True):
        if above >= drawn:
            break
        start.append((score, above))
        above += per_score[score]
    starts = df.sparkSession.createDataFrame(start, "score long, above long")
    order = Window.partitionBy("score").orderBy(F.col(id_).asc_nulls_last(), F.col("weight").desc(), "n_features")
    rank = F.col("above") + F.row_number().over(order)
    top = may.join(F.broadcast(starts), "score").withColumn("rank", F.when(rank <= drawn, rank)).select(*df.columns, "rank")
    fits = (F.col("n_words") >= least_words) & (F.col("score") >= start[-1][0] if start else F.lit(False))
    return top.unionByName(rows.where(~fits).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, id_: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, most: int = MOST_WORDS, scale: int = SCALE, seed: int = 7) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; rank counts the drawn ``percent`` of those with ``least_words`` or more."""
    gain = gains(_dense(bucket_counts(docs, text, buckets, most), buckets), _dense(bucket_counts(target, target_text, buckets, most), buckets), scale)
    own = weighted(docs.select(F.col(id_), F.col(text).alias("_text")), gain, "_text", most, drop_text=True)
    scored = own.withColumn("score", F.col("weight") + gumbel(id_, seed, scale))
    return ranked(scored, id_, percent, least_words)


def op13_importance_resampling(spark, sf_dir) -> DataFrame:
    """Per document: features, weight, score, and rank among a quarter of the documents with 20 words or more."""
    found = resampled(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
