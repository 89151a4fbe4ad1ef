"""From raw documents to token ids in five stages, each of which calls one operator of ``ohmlake.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs, rows unchanged:

language            rejects texts without letters and those whose language is less sure than LEAST_SURE
quality             rejects what the quality rules reject
near_duplicates     keeps one document of each group (five-word shingles, similarity 0.8 or more)
decontamination     rejects documents that hold a window of a benchmark item
tokens              ids of the whole texts, with digests of the ids and of what they decode to
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ohmlake.llm import bpe, decontaminate, jaccard, language, quality
from ohmlake.llm.common import read, stored

LEAST_SURE = 0.5


def _judged(docs: DataFrame) -> DataFrame:
    """docs as the text beside one column of all others, so that none of them clashes with an operator's."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), "text")


def _back(judged: DataFrame, docs: DataFrame) -> DataFrame:
    return judged.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train_on(docs)
    found = language.predict(_judged(docs), model)
    return _back(found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SURE)), docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _back(quality.quality(_judged(docs)).where("kept"), docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, "doc_id", k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(_judged(docs), read(spark, sf_dir, "benchmark"))
    return _back(hits.where(F.size("hit_words") == 0), docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, drop_text=True)
    return coded.select(
        "doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: SQL expresses neither the learned language model nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
