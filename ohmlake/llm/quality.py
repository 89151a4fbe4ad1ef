"""Quality rules by repetition coverage (operator 3).

Words are runs of anything but ASCII white space. For each of several lengths n, the hash of every
n words is rolled along all texts of a slice at once in numpy; a sort of the hashes brings equal
windows together, and equal hashes are compared word by word, so that a collision cannot count.
Coverage is the share of a text's word characters inside windows that stand in the text twice or
more (the first included). Lines that equal an earlier line of their text count likewise.

A null or empty text has no words; all its counts are 0 and it fails the base rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import per_doc, read, slices, with_columns

SYMBOLS = b"#*$%&|<>"
BASE_WINDOW = 8

FIELDS = [
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("repeat_coverage", "array<double>"), ("dup_line_chars", "bigint"),
]


@dataclass(frozen=True)
class Limits:
    """A text is rejected above any of these."""

    min_words: int = 20
    #: Percent of words in repeated windows of BASE_WINDOW words.
    max_repeat_percent: int = 30
    #: Window length: most of the word characters inside repeated windows.
    coverage: dict[int, float] = field(default_factory=lambda: {4: 0.5, 8: 0.35, 16: 0.3})
    max_dup_line_share: float = 0.4
    max_symbols_per_word: float = 1.0


class Ids(dict):
    """Numbers for words in order of appearance, and their code points."""

    def __init__(self):
        super().__init__()
        self.chars: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.chars)
        self.chars.append(len(word.decode()))
        return i


def spread(x: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits for each number."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated(ids: np.ndarray, doc: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length, which words are inside a window of that many words found twice or more in its text."""
    out, total = {}, len(ids)
    for seed in range(8):  # another try only after a collision
        base = np.uint64(0x5851F42D4C957F2D + 2 * seed)
        word, own = spread(ids, seed), spread(doc, seed + 100)
        rolled, n, done = word.copy(), 1, True
        for length in lengths:
            while n < length:
                rolled = rolled[: max(0, total - n)] * base + word[n:]
                n += 1
            if length in out:
                continue
            starts = np.flatnonzero(doc[: len(rolled)] == doc[length - 1 :]) if total >= length else np.zeros(0, np.int64)
            keys = rolled[starts] ^ own[starts]
            order = np.argsort(keys)
            keys, starts = keys[order], starts[order]
            same = np.flatnonzero(keys[1:] == keys[:-1])
            a, b = starts[same], starts[same + 1]
            if any(not np.array_equal(ids[a + j], ids[b + j]) for j in range(length)) or not np.array_equal(doc[a], doc[b]):
                done = False
                continue
            edge = np.zeros(total + 1, np.int32)
            found = np.zeros(len(starts), bool)
            found[same] = found[same + 1] = True
            edge[: total] += np.bincount(starts[found], minlength=total)[:total].astype(np.int32)
            edge -= np.bincount(starts[found] + length, minlength=total + 1).astype(np.int32)
            out[length] = np.cumsum(edge)[:total] > 0
        if done:
            return out
    raise ArithmeticError("equal hashes of different windows under eight multipliers")


def measure(data: np.ndarray, offsets: np.ndarray, limits: Limits) -> list:
    """The columns of FIELDS for the texts of a slice."""
    docs = len(offsets) - 1
    raw = data.tobytes()
    names, counts = Ids(), np.zeros(docs, np.int64)
    dup_lines, dup_chars, parts = np.zeros(docs, np.int64), np.zeros(docs, np.int64), []
    for i in range(docs):
        text = raw[offsets[i] : offsets[i + 1]]
        words = text.split()
        counts[i] = len(words)
        parts.append(np.fromiter(map(names.__getitem__, words), np.int64, len(words)))
        if b"\n" in text:
            lines = text.split(b"\n")
            if len(set(lines)) < len(lines):
                seen: set[bytes] = set()
                for line in lines:
                    if line in seen:
                        if own := line.split():
                            dup_lines[i] += 1
                            dup_chars[i] += sum(len(w.decode()) for w in own)
                    else:
                        seen.add(line)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(docs), counts)
    chars = np.asarray(names.chars, np.int64)[ids] if len(ids) else np.zeros(0, np.int64)
    lengths = sorted({BASE_WINDOW, *limits.coverage})
    inside = repeated(ids, doc, lengths)
    word_chars = per_doc(chars, counts)
    table = np.zeros(256, np.int64)
    table[list(SYMBOLS)] = 1
    symbols = per_doc(table[data], np.diff(offsets))
    repeat_words = per_doc(inside[BASE_WINDOW].astype(np.int64), counts)
    most = np.maximum(word_chars, 1)
    shares = {n: per_doc(np.where(inside[n], chars, 0), counts) / most for n in limits.coverage}
    failed = (counts < limits.min_words) | (100 * repeat_words > limits.max_repeat_percent * counts)
    kept = ~failed & (dup_chars / most <= limits.max_dup_line_share) & (symbols <= limits.max_symbols_per_word * counts)
    for n, share in shares.items():
        kept &= share <= limits.coverage[n]
    coverage = np.column_stack([shares[n] for n in sorted(shares)]) if shares else np.zeros((docs, 0))
    return [counts, word_chars, symbols, dup_lines, repeat_words, failed, kept, coverage.tolist(), dup_chars]


def quality(df: DataFrame, text: str = "text", limits: Limits = Limits(), drop_text: bool = False) -> DataFrame:
    """df with the columns of FIELDS; kept is false where a limit is passed."""

    def make() -> Callable:
        def work(column):
            found = [measure(data, offsets, limits) for data, offsets in slices(column)]
            return [[x for part in col for x in part] if i == 7 else np.concatenate(col) for i, col in enumerate(zip(*found))] if found else [[] for _ in FIELDS]

        return work

    return with_columns(df, text, FIELDS, make, drop_text)


def op3_repetition_quality(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, drop_text=True).select("doc_id", *[n for n, _ in FIELDS[:7]])


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
    [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
g AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([4, 8, 16]) AS n) WHERE len(w) >= n)),
r AS (SELECT k, n, i FROM (SELECT *, count(*) OVER (PARTITION BY k, n, win) AS c FROM g) WHERE c > 1),
c AS (SELECT DISTINCT k, n, unnest(range(i, i + n)) AS i FROM r),
l AS (SELECT k, unnest(range(1, len(w) + 1)) AS i, unnest([length(x) FOR x IN w]) AS chars FROM d),
v AS (SELECT c.k, c.n, count(*) AS words, sum(chars) AS chars FROM c JOIN l ON l.k = c.k AND l.i = c.i GROUP BY c.k, c.n),
s AS (SELECT k, unnest(range(len(string_split(t, chr(10))))) AS pos, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (
  SELECT k, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars
  FROM (SELECT *, row_number() OVER (PARTITION BY k, line ORDER BY pos) AS nth FROM s) WHERE nth > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(b.words, 0)::BIGINT AS n_repeat_words,
    coalesce(u.chars, 0) AS dup_chars, coalesce(a.chars, 0) AS c4, coalesce(b.chars, 0) AS c8, coalesce(e.chars, 0) AS c16
  FROM d LEFT JOIN u ON u.k = d.k LEFT JOIN v a ON a.k = d.k AND a.n = 4 LEFT JOIN v b ON b.k = d.k AND b.n = 8 LEFT JOIN v e ON e.k = d.k AND e.n = 16),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(word_chars, 1) AS most FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND dup_chars / most <= 0.4::DOUBLE AND n_symbols <= n_words AND c4 / most <= 0.5::DOUBLE AND c8 / most <= 0.35::DOUBLE AND c16 / most <= 0.3::DOUBLE AS kept FROM f
"""
