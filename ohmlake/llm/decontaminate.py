"""Benchmark decontamination (operator 5).

All windows of the normalised benchmark items (ten consecutive words, or the whole of a shorter
item) go into one Aho-Corasick automaton. Every text is normalised once, scanned once, and the
matches are mapped back to word numbers and to code points of the original text.

The automaton is broadcast, so its items are bounded: beyond ``BLOCK_BYTES`` of item text the items
are dealt to several blocks by a hash of the item id. The blocks scan the texts one after the other,
each with an automaton of its own, so that neither a task nor the driver holds two; only the hits are
written, once for each text that has some, and are then united and joined to the rows by text hash and length.

Normalised: A-Z in lower case, words are runs of letters, digits and non-ASCII characters. A null
text or item has no words; a null item id stands as an empty string; repeated item ids count once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import read, stored, texts, with_columns

WINDOW = 10
#: Item text that one automaton takes; about 60 times as many bytes of memory.
BLOCK_BYTES = 4 << 20

_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FIELDS = [("n_words", "bigint"), ("hit_words", "array<struct<start:int,end:int>>"), ("hit_chars", "array<struct<start:int,end:int>>"), ("items", "array<string>")]


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def automaton(items: list[tuple[str, str]], window: int = WINDOW) -> ahocorasick.Automaton | None:
    """Of all windows of (item id, text); None if no item has a word. A value is (words, item ids)."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        own = words(text or "")
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            found.setdefault((b" " + b" ".join(own[i : i + n]) + b" ").decode("latin-1"), (n, set()))[1].add(item or "")
    if not found:
        return None
    machine = ahocorasick.Automaton()
    for key, value in found.items():
        machine.add_word(key, value)
    machine.make_automaton()
    return machine


def scan(machine, text: str) -> tuple[int, list, list, list]:
    """Number of words, runs of hit words, the same runs as code points of text, items: one pass over the text."""
    own = words(text)
    if machine is None or not own:
        return len(own), [], [], []
    line = " " + b" ".join(own).decode("latin-1") + " "
    matches = list(machine.iter(line))
    if not matches:
        return len(own), [], [], []
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    edge, items = np.zeros(len(own) + 1, np.int64), set()
    ends = np.searchsorted(spaces, [m[0] for m in matches])  # words before the closing space
    for to, (_, (n, names)) in zip(ends.tolist(), matches):
        edge[to - n] += 1
        edge[to] -= 1
        items |= names
    hit = np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]]).astype(np.int8)
    turns = np.flatnonzero(np.diff(hit))
    runs = list(zip(turns[::2].tolist(), turns[1::2].tolist()))
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.concatenate([[0], np.frombuffer(raw.tobytes().translate(_TABLE), np.uint8) != 32, [0]]).astype(np.int8)
    turns = np.flatnonzero(np.diff(inside))
    code = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = [(int(code[turns[2 * a]]), int(code[turns[2 * b - 1]])) for a, b in runs]
    return len(own), runs, chars, sorted(items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, drop_text: bool = False) -> DataFrame:
    """docs with n_words, the runs of words and of code points that benchmark windows cover, and the items hit."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    size = items.agg(F.sum(F.length(F.encode("t", "utf-8")))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    if blocks == 1:
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])
        return with_columns(docs, text, FIELDS, _scanner(shared, window), drop_text)
    own_text = docs.select(F.col(text).alias("_text"))
    key = lambda c: [F.xxhash64(c).alias("_h"), F.length(c).alias("_l")]
    parts = []
    for block in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect()])
        hits = with_columns(own_text, "_text", FIELDS, _scanner(shared, window)).where(F.size("hit_words") > 0)
        parts.append(stored(hits.select(*key("_text"), *[n for n, _ in FIELDS[1:]]).dropDuplicates(["_h", "_l"]), "hits"))
        shared.unpersist()
    every = lambda n: F.flatten(F.collect_list(n)).alias(n)  # noqa: E731  one list a block
    found = reduce(DataFrame.unionByName, parts).groupBy("_h", "_l").agg(*[every(n) for n, _ in FIELDS[1:]])
    found = found.select("_h", "_l", united(F.col("hit_words")).alias("hit_words"), united(F.col("hit_chars")).alias("hit_chars"), F.array_sort(F.array_distinct("items")).alias("items"))
    added = [n for n, _ in FIELDS]
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in added and not (drop_text and c == text)]).alias("_row"), *key(F.col(text)), F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _BREAK), "")).cast("long").alias("n_words"))
    none = {n: F.coalesce(F.col(n), F.array().cast(k)).alias(n) for n, k in FIELDS[1:]}
    return rows.join(found, ["_h", "_l"], "left").select("_row.*", "n_words", *none.values())


def _scanner(shared, window: int) -> Callable:
    def make() -> Callable:
        machine = automaton(shared.value, window)

        def work(column):
            found = [scan(machine, t) for t in texts(column).to_pylist()]
            runs = lambda rows: [[{"start": a, "end": b} for a, b in x] for x in rows]
            n, hit, chars, names = zip(*found) if found else ((), (), (), ())
            return [list(n), runs(hit), runs(chars), list(names)]

        return work

    return make


def united(runs):
    """Runs that meet or overlap made one, in order."""
    add = lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
        F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(runs), F.array().cast("array<struct<start:int,end:int>>"), add)


def op5_decontaminate(spark, sf_dir) -> DataFrame:
    """Per document: its words, those inside benchmark windows, the items hit and a digest of their ids."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate(docs, read(spark, sf_dir, "benchmark"), drop_text=True)
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k,
    [x FOR x IN regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (
  SELECT item_id::VARCHAR AS item_id,
    [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT k, dw.n, i, item_id FROM dw JOIN bw ON bw.win = dw.win AND bw.n = dw.n),
pos AS (SELECT DISTINCT k, unnest(range(i, i + n)) AS p FROM hit),
a AS (SELECT k, count(*) AS n_hit FROM pos GROUP BY k),
c AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, item_id FROM hit) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN a USING (k) LEFT JOIN c USING (k)
"""
