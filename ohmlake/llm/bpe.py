"""Byte-level BPE encoding and decoding (operator 1).

Every match of the split pattern is encoded by itself. A segment tree over its byte positions
holds, for each live position, the rank of the pair made with its live right neighbour; the root
is the leftmost pair of the least rank. A merge updates three leaves: the position itself, its
left neighbour, and the one that died. A match of n bytes takes O(n log n), so texts without any
break stay affordable.

The distinct matches of a step of texts that are not remembered are merged together: their trees are rows of
one array, and each round does one merge in every row that still has a pair. Matches longer than ``ROW``
bytes have a tree of their own.

Ids are bytes: unsigned 32-bit little-endian numbers, four for a token. A null or empty text has no ids.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import read, texts, with_columns

#: Distinct matches in a generation of a task's memory. When the younger of two is full, the elder is forgotten.
REMEMBERED = 100_000
#: Bytes of the longest match that is a row of an array, and of a match that is remembered.
ROW = 64
#: Bytes of all rows of one array.
ROWS = 1 << 19
NEVER = 1 << 62
SHIFT = 32
LOW = (1 << SHIFT) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks of parts, the rank of each pair of parts that make one, and the parts' bytes one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        get = ranks.get
        pairs = [(x, y, rank) for part, rank in ranks.items() for i in range(1, len(part)) if (x := get(part[:i])) is not None and (y := get(part[i:])) is not None]
        x, y, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.bits = max(4, int(2 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int64)
        key = x << SHIFT | y
        slot = self._slot(key)
        while len(key):  # the next free place for each that finds its own taken
            free = self.keys[slot] == -1
            self.keys[slot[free]], self.values[slot[free]] = key[free], rank[free]
            rest = self.keys[slot] != key
            key, rank, slot = key[rest], rank[rest], slot[rest] + 1 & len(self.keys) - 1
        parts = [b""] * (max(ranks.values(), default=-1) + 1)
        for part, i in ranks.items():
            parts[i] = part
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ranks of what the parts x and y make together; NEVER where that is no part."""
        key = x << SHIFT | y
        slot = self._slot(key)
        there = self.keys[slot]
        out = self.values[slot]
        other = np.flatnonzero(there != key)
        while len(other):
            out[other] = NEVER
            other = other[there[other] != -1]
            slot[other] = slot[other] + 1 & len(self.keys) - 1
            there[other] = self.keys[slot[other]]
            out[other] = self.values[slot[other]]
            other = other[there[other] != key[other]]
        return out

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids one after another, and how many each has."""
        sizes = self.starts[ids + 1] - self.starts[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.bytes[at], sizes


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Of a .tiktoken file, read once a worker process."""
    return Vocabulary(load_ranks(path))


def merge_rows(pieces: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Ids of matches of at most ROW bytes, each by repeated merging of its leftmost pair of the least rank."""
    out: list[bytes] = [b""] * len(pieces)
    lengths = np.array([len(x) for x in pieces], np.int64)
    for size in (2 << i for i in range(ROW.bit_length() - 1)):
        of_size = np.flatnonzero((lengths <= size) & (lengths > size // 2 if size > 2 else lengths > 0))
        for at in range(0, len(of_size), ROWS // size):
            own = of_size[at : at + ROWS // size]
            for i, ids in zip(own.tolist(), _merged([pieces[i] for i in own.tolist()], lengths[own], size, vocab)):
                out[i] = ids
    return out


def _merged(pieces: list[bytes], n: np.ndarray, size: int, vocab: Vocabulary) -> list[bytes]:
    m, width = len(pieces), size + 1  # the last place of a row stands for its end
    data = np.zeros((m, size), np.uint8)
    inside = np.arange(size) < n[:, None]
    data[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    ids = np.zeros((m, width), np.int64)
    ids[:, :size] = vocab.single[data]
    tree = np.full((m, 2 * size), NEVER, np.int64)
    paired = inside[:, 1:]
    rank = vocab.pair(ids[:, : size - 1][paired], ids[:, 1:size][paired])
    place = np.broadcast_to(np.arange(size - 1), paired.shape)[paired]
    tree[:, size : 2 * size - 1][paired] = np.where(rank == NEVER, NEVER, rank << SHIFT | place)
    level = size
    while level > 1:
        np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
        level //= 2
    after = np.minimum(np.arange(1, width + 1), size) + np.zeros((m, 1), np.int64)
    after[np.arange(m), n - 1] = size
    before = np.arange(-1, size) + np.zeros((m, 1), np.int64)
    alive = np.zeros((m, width), bool)
    alive[:, :size] = inside
    tree, ids, after, before, alive = (x.reshape(-1) for x in (tree, ids, after, before, alive))
    rows = np.arange(m)

    def put(leaf: np.ndarray, value: np.ndarray | int, base: np.ndarray) -> None:
        x = leaf + size
        tree[base + x] = value
        while x[0] > 1:
            x = x >> 1
            both = base + 2 * x
            tree[base + x] = np.minimum(tree[both], tree[both + 1])

    while len(rows):
        root = tree[rows * (2 * size) + 1]
        left = root != NEVER
        rows, root = rows[left], root[left]
        if not len(rows):
            break
        base, row = rows * (2 * size), rows * width
        i = root & LOW
        ids[row + i] = root >> SHIFT
        j = after[row + i]
        k = after[row + j]
        alive[row + j] = False
        after[row + i] = k
        before[row + k] = i
        p = before[row + i]
        rank = np.where(k < size, vocab.pair(ids[row + i], ids[row + k]), NEVER)
        put(j, NEVER, base)
        put(i, np.where(rank == NEVER, NEVER, rank << SHIFT | i), base)
        some = np.flatnonzero(p >= 0)
        if len(some):
            p, row = p[some], row[some]
            rank = vocab.pair(ids[row + p], ids[row + i[some]])
            put(p, np.where(rank == NEVER, NEVER, rank << SHIFT | p), base[some])
    found = ids[alive].astype("<u4").tobytes()
    ends = np.cumsum(alive.reshape(m, width).sum(axis=1)).tolist()
    return [found[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]


def merge_one(piece: bytes, ranks: dict[bytes, int]) -> bytes:
    """Ids of one match of any length, with a tree of its own."""
    n = len(piece)
    get = ranks.get
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))  # start of the part to the left
    size = 1 << (n - 1).bit_length()
    tree = [NEVER] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << SHIFT | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    def pair(i: int) -> int:
        """Rank and place of the pair that the part at i makes with the next."""
        j = end[i]
        rank = get(piece[i : end[j]]) if j < n else None
        return NEVER if rank is None else rank << SHIFT | i

    while tree[1] != NEVER:
        i = tree[1] & LOW
        j = end[i]
        put(j, NEVER)
        end[i] = k = end[j]
        if k < n:
            before[k] = i
        put(i, pair(i))
        if i:
            put(before[i], pair(before[i]))
    ids, i = array("I"), 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids.tobytes()


class Memory:
    """Ids of matches. What was used lately is remembered in two generations."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, matches: Iterable[str]) -> dict[str, bytes]:
        """Ids of the given distinct matches."""
        found, new = {}, []
        young, old, ranks = self.young.get, self.old.get, self.vocab.ranks
        for x in matches:
            ids = young(x)
            if ids is None:
                ids = old(x)
                if ids is None:
                    new.append(x)
                    continue
                self.young[x] = ids
            found[x] = ids
        rows, raw = [], []
        for x in new:
            piece = x.encode()
            rank = ranks.get(piece)
            if rank is not None:
                found[x] = rank.to_bytes(4, "little")
            elif len(piece) > ROW:
                found[x] = merge_one(piece, ranks)
                continue
            else:
                rows.append(x)
                raw.append(piece)
                continue
            self.young[x] = found[x]
        made = dict(zip(rows, merge_rows(raw, self.vocab)))
        found |= made
        self.young |= made
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        return found


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it, which is what the library's engine takes."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _encoder(path: str, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """From texts to their ids."""
    memory, find = Memory(vocabulary(path)), splitter(pattern).findall

    def encoded(texts: list[str]) -> list[bytes]:
        matches = [find(t) for t in texts]
        one = memory.learn(set().union(*matches)).__getitem__
        return [b"".join(map(one, own)) for own in matches]

    return encoded


def _decoder(path: str) -> Callable[[list[bytes]], pa.Array]:
    """From ids to the bytes that they stand for."""
    vocab = vocabulary(path)

    def decoded(ids: list[bytes]) -> pa.Array:
        data, sizes = vocab.decoded(np.frombuffer(b"".join(ids), "<u4").astype(np.int64))
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = total[np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)]
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())

    return decoded


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", drop_text: bool = False) -> DataFrame:
    """df with a binary column of ids."""

    def make() -> Callable:
        encoded = _encoder(path, pattern)
        return lambda column: [encoded(texts(column).to_pylist())]

    return with_columns(df, text, [(ids, "binary")], make, drop_text)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", drop_ids: bool = False) -> DataFrame:
    """df with the bytes that its ids stand for, as a binary column; null ids are no ids."""

    def make() -> Callable:
        decoded = _decoder(path)
        return lambda column: [decoded([x or b"" for x in column.to_pylist()])]

    return with_columns(df, ids, [(out, "binary")], make, drop_ids)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded", drop_text: bool = False) -> DataFrame:
    """df with its ids and with the bytes that these decode to: encode and decode in one pass and one worker."""

    def make() -> Callable:
        encoded, decoded = _encoder(path, pattern), _decoder(path)

        def work(column):
            found = encoded(texts(column).to_pylist())
            return [found, decoded(found)]

        return work

    return with_columns(df, text, [(ids, "binary"), (out, "binary")], make, drop_text)


def op1_byte_bpe(spark, sf_dir) -> DataFrame:
    """Per document: number of tokens, digest of the ids, digest of the decoded bytes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = round_trip(docs, path, public_tokenizers.PATTERN, drop_text=True)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
