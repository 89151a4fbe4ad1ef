"""Language-model scores by the likelihood of the subword lattice (operator 10).

The vocabulary is an existing one; its own scores (ranks) give every piece a prior weight, and the
pieces counted in the training words, as the library splits them, give the rest:
p = (count + PRIOR * q) / (all + PRIOR), q falling with the rank; the end of a text is one more piece.
A word is scored by the sum over ALL its segmentations: forward recursion in log space over the
positions of the word, every piece that ends at a position adding the mass of the position where it
began. Pieces never cross words, so the probability of a text is the product over its words and the
end. Characters outside the vocabulary stand as their bytes.

Each distinct word is counted and scored once; texts get their sums by a join on words (``terms``).
A null or empty text is its end alone. A null id is neither learned from nor held out.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_mod, read, stored
from .terms import HOT, count_terms, term_sums
from .token_counts import SPACE, model

#: Pseudo-counts that the vocabulary's own scores are worth in all.
PRIOR = 32_000.0

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str) -> list[str]:
    """Words of a text with A-Z in lower case; only ASCII white space parts them."""
    return _WORD.findall(text.encode().lower().decode())


def pieces_of(path: str) -> dict[str, int]:
    """Ordinary pieces and their ids."""
    m = model(path)
    return {m.id_to_piece(i): i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}


def priors(path: str) -> np.ndarray:
    """Weights of all pieces by their scores, which are ranks below 0; bytes rank last."""
    m = model(path)
    size = m.get_piece_size()
    rank = np.array([size if m.is_byte(i) else min(size, max(0.0, -m.get_score(i))) for i in range(size)])
    q = 1.0 / (rank + 10.0)
    q[[i for i in range(size) if m.is_control(i) or m.is_unknown(i)]] = 0.0
    return q / q.sum()


class Lattice:
    """Natural log probabilities of pieces, and of words over all segmentations."""

    def __init__(self, path: str, log_p: np.ndarray):
        known = pieces_of(path)
        self.log_p = {p: float(log_p[i]) for p, i in known.items()}
        m = model(path)
        self.bytes = [float(log_p[m.piece_to_id(f"<0x{b:02X}>")]) for b in range(256)]
        self.longest = max(map(len, known), default=1)

    def log_word(self, word: str) -> float:
        get, exp, log, longest = self.log_p.get, math.exp, math.log, self.longest
        text = SPACE + word.replace(" ", SPACE)
        n = len(text)
        mass = [0.0] * (n + 1)
        for j in range(1, n + 1):
            found = []
            for i in range(max(0, j - longest), j):
                p = get(text[i:j])
                if p is not None:
                    found.append(mass[i] + p)
            if text[j - 1] not in self.log_p:
                found.append(mass[j - 1] + sum(self.bytes[b] for b in text[j - 1].encode()))
            if len(found) == 1:
                mass[j] = found[0]
            else:
                top = max(found)
                mass[j] = top + log(sum([exp(x - top) for x in found]))
        return mass[n]


def piece_counts(counted: DataFrame, path: str, size: int) -> np.ndarray:
    """How often the library's splitting of the training words has each piece."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            m = model(path)
            terms, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for at in range(0, len(terms), 20_000):
                own = m.encode(terms[at : at + 20_000], num_threads=1)
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                flat = np.fromiter((x for ids in own for x in ids), np.int64, int(sizes.sum()))
                total += np.bincount(flat, np.repeat(times[at : at + 20_000], sizes), minlength=size).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["piece", "n"])

    out = np.zeros(size, np.int64)
    for r in counted.where("n_flag > 0").select("term", "n_flag").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r.piece] = r.n  # one row a piece of the vocabulary
    return out


def score(df: DataFrame, path: str, ids: list[str], learn: Column, text: str = "text", hot: int = HOT) -> DataFrame:
    """(ids, n_tokens, n_known, train_tokens, base_score, score), a row for each row of df.

    learn: where to learn from. base_score: add-one unigram score of words; score: log10 of the
    probability that the lattice gives to the text.
    """
    spark = df.sparkSession
    counted = stored(count_terms(df, text, words, learn), "words")
    n_words, n_kinds = counted.agg(F.sum("n_flag"), F.sum(F.when(F.col("n_flag") > 0, 1))).first()
    ends = df.where(F.coalesce(learn, F.lit(False))).count()
    n = (n_words or 0) + ends
    v = (n_kinds or 0) + (ends > 0)
    size = model(path).get_piece_size()
    pieces = piece_counts(counted, path, size)
    weight = pieces + PRIOR * priors(path)
    total = weight.sum() + ends + 1.0
    with np.errstate(divide="ignore"):
        shared = spark.sparkContext.broadcast(np.log(weight / total))
    base = lambda c: math.log10((c + 1) / (n + 1 * (v + 1)))

    def judge(batches):
        lattice = Lattice(path, shared.value)
        for batch in batches:
            c = batch.column(2).to_pylist()
            out = [batch.column(0), batch.column(1), pa.array([int(x > 0) for x in c], pa.int64()), pa.array([base(x) for x in c], pa.float64()), pa.array([lattice.log_word(w) / math.log(10) for w in batch.column(0).to_pylist()], pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=["term", "n", "n_known", "base_score", "score"])

    values = stored(counted.mapInArrow(judge, "term string, n long, n_known long, base_score double, score double"), "scores")
    found = term_sums(df, ids, text, words, values, ["n_known", "base_score", "score"], ["long", "double", "double"], lambda w, _: [len(w) + 1], [("n_tokens", "long")], hot)
    end = math.log10((ends + 1.0) / total)
    return found.select(
        *ids,
        "n_tokens",
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + base(ends)).alias("base_score"),
        (F.col("score") + end).alias("score"),
    )


def op10_lattice_scores(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    part = crc_mod("doc_id", 7)
    found = score(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], part != 2)
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
