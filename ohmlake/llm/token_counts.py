"""Token counts from the counts of distinct pre-tokens (operator 4).

A pre-token is a run of spaces with the run of other characters behind it, or a line break. No piece
of the vocabulary crosses from a character to a space, and none holds a line break, so merges never
cross pre-tokens and the number of tokens of a text is the sum over its pre-tokens. The library
counts each distinct pre-token once; texts are then joined to those counts by pre-token frequencies
and no ids of a text are ever made. ``splits_safely`` checks the two conditions for a model.

A null or empty text has no tokens.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import read, stored
from .terms import HOT, count_terms, term_sums

LIMIT = 4096
#: The sign that a piece has for a space; texts with the sign itself are split as if it were one.
SPACE = "▁"

_PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text with the space that the library puts first."""
    return _PRE_TOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


@lru_cache(maxsize=2)
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_safely(path: str) -> bool:
    m = model(path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
    return not any(re.search(f"[^{SPACE}]{SPACE}|[ \n]", p) for p in pieces)


def count_pieces(terms: list[str], path: str) -> list[int]:
    """Tokens of each pre-token; the line break put first keeps the library's own space away."""
    m = model(path)
    own = len(m.encode("\n"))
    return [len(x) - own for x in m.encode(["\n" + t for t in terms], num_threads=1)]


def token_counts(df: DataFrame, path: str, ids: list[str], text: str = "text", hot: int = HOT) -> DataFrame:
    """(ids, n_bytes, n_tokens), a row for each row of df."""

    def count(batches):
        for batch in batches:
            terms = batch.column(0).to_pylist()
            for at in range(0, len(terms), 20_000):
                own = terms[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(own)) for c in batch.columns], pa.array(count_pieces(own, path), pa.int64())], names=["term", "n", "n_tokens"])

    if not splits_safely(path):
        raise ValueError("a piece of this model crosses pre-tokens")
    counted = count_terms(df, text, pre_tokens).select("term", "n").mapInArrow(count, "term string, n long, n_tokens long")
    return term_sums(df, ids, text, pre_tokens, stored(counted, "pre-tokens"), ["n_tokens"], ["long"], lambda _, t: [len(t.encode())], [("n_bytes", "long")], hot)


def op4_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
