"""Language ID by sparse multinomial logistic regression (operator 2).

Features are character n-grams (letters in lower case; runs of anything else are one space), hashed
into BUCKETS. A value is TF-IDF: the share of the n-gram among the n-grams of the text, times the
inverse document frequency over ALL labelled training texts. Weights are learned by
follow-the-regularised-leader with elastic-net penalties on a bounded sample (``Plan.sample``
texts are expected, and ``LEAST`` of each label besides; all, if there are no more), dealt over ``Plan.shards`` tasks whose weights are
averaged. A part of the sample is kept from training and gives the temperature. More than MOST_LABELS
labels are an error.

A text is predicted whole: the logit of a language is the mean of idf x weight over its n-grams,
which is a table lookup for each n-gram. A null text or one without a letter is ``und`` with score 0;
so is every text if nothing could be learned. Ties go to the label that sorts first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_mod, per_doc, read, slices, with_columns

BITS = 15
BUCKETS = 1 << BITS
SIZES = (1, 2, 3)
UNKNOWN = "und"
#: Features are shares, so small; this brings them to about 1.
SCALE = 100.0

#: Texts of each label that the sample has at least (expected; all, if there are no more).
LEAST = 50
#: Labels that can be learned: a weight table is BUCKETS numbers for each.
MOST_LABELS = 1000

FIELDS = [("lang_pred", "string"), ("score", "double")]


@dataclass(frozen=True)
class Plan:
    """Bounds and constants of training."""

    sample: int = 12_000
    shards: int = 6
    epochs: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    #: One of so many sampled texts calibrates the temperature.
    calibrate: int = 8


@dataclass(frozen=True)
class Model:
    labels: list[str]
    #: idf x weight, by bucket and label, and a bias by label.
    table: np.ndarray
    bias: np.ndarray
    temperature: float


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Letters of each text of a slice; for each n-gram size the buckets and the texts they are of."""
    code = letters()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    letter = code != 32
    n_letters = per_doc(letter.astype(np.int64), np.diff(starts))
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])  # of a run of spaces the first stays
    code, doc = code[keep], doc[keep]
    out, rolled = [], np.zeros(len(code), np.uint32)
    for n in range(1, max(SIZES) + 1):
        rolled = rolled[: max(0, len(code) - n + 1)] * np.uint32(0x01000193) + code[n - 1 :]
        if n in SIZES:
            bucket = (((rolled ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
            own = doc[: len(rolled)]
            whole = own == doc[n - 1 :]
            out.append((bucket[whole], own[whole]))
    return n_letters, out


def frequencies(train: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Number of training texts, and of those with each bucket."""

    def run(batches):
        n, df, seen = 0, np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool)
        for batch in batches:
            for data, offsets in slices(batch.column(0)):
                docs = len(offsets) - 1
                n += docs
                found = [(b, np.searchsorted(d, np.arange(docs + 1))) for b, d in grams(data, offsets)[1]]
                for i in range(docs):
                    seen[:] = False
                    for bucket, at in found:
                        seen[bucket[at[i] : at[i + 1]]] = True
                    df += seen
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], n), pa.int64())], names=["bucket", "n"])

    rows = train.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(BUCKETS, np.int64), 0
    for r in rows:  # BUCKETS + 1 at most
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return n, df


def features(train: DataFrame, text: str, label: str, idf) -> DataFrame:
    """(label, key, buckets, values) of each text, values being TF-IDF."""

    def run(batches):
        for batch in batches:
            at, labels, keys = 0, batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for data, offsets in slices(batch.column(0)):
                docs = len(offsets) - 1
                n_letters, found = grams(data, offsets)
                found = [(b, np.searchsorted(d, np.arange(docs + 1))) for b, d in found]
                rows = {"label": [], "key": [], "buckets": [], "vals": []}
                for i in range(docs):
                    if n_letters[i]:
                        counts = np.bincount(np.concatenate([b[o[i] : o[i + 1]] for b, o in found]), minlength=BUCKETS)
                        some = np.flatnonzero(counts)
                        rows["label"].append(labels[at + i])
                        rows["key"].append(keys[at + i])
                        rows["buckets"].append(some.astype(np.int32))
                        rows["vals"].append((SCALE / counts.sum() * counts[some] * idf.value[some]).astype(np.float32))
                at += docs
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("label", pa.string()), ("key", pa.int64()), ("buckets", pa.list_(pa.int32())), ("vals", pa.list_(pa.float32()))]))

    return train.select(text, label, "key").mapInArrow(run, "label string, key long, buckets array<int>, vals array<float>")


def ftrl(rows: pd.DataFrame, labels: list[str], plan: Plan) -> np.ndarray:
    """Weights by bucket (the last is the bias) and label, by FTRL-proximal over the rows in order of key."""
    rows = rows.sort_values(["key", "label"], kind="stable")
    place = {x: i for i, x in enumerate(labels)}
    xs = [(np.append(b, BUCKETS), np.append(v, 1.0), place[y]) for b, v, y in zip(rows["buckets"], rows["vals"], rows["label"])]
    z, n = np.zeros((BUCKETS + 1, len(labels))), np.zeros((BUCKETS + 1, len(labels)))
    for _ in range(plan.epochs):
        for at, x, y in xs:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= plan.l1, 0.0, (np.sign(zi) * plan.l1 - zi) / ((plan.beta + root) / plan.alpha + plan.l2))
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - root) / plan.alpha * w
            n[at] = more
    return np.where(np.abs(z) <= plan.l1, 0.0, (np.sign(z) * plan.l1 - z) / ((plan.beta + np.sqrt(n)) / plan.alpha + plan.l2))


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, on a grid of powers; 1 without rows."""
    if not len(truth):
        return 1.0

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(truth)), truth]))

    return min((2.0 ** (k / 8) for k in range(-32, 33)), key=loss)


def fit(df: DataFrame, text: str, label: str, key: Column, plan: Plan = Plan()) -> Model | None:
    """A model of df's texts with a label; key: what deals rows to the sample and to shards. None without rows.

    To the driver go the labels, BUCKETS document frequencies, a weight table a shard and the
    calibration logits, all of bounded size.
    """
    spark = df.sparkSession
    train = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, label, F.xxhash64(key).alias("key"))
    n, seen = frequencies(train, text)
    if not n:
        return None
    idf = np.log((1.0 + n) / (1.0 + seen)) + 1.0
    shared = spark.sparkContext.broadcast(idf)
    share = plan.sample / n
    sizes = {r[0]: r[1] for r in train.groupBy(label).count().limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"column {label} has more than {MOST_LABELS} values")
    labels = sorted(sizes)
    rate = lambda m: 1 << 20 if m <= LEAST else int(min(1.0, max(share, LEAST / m)) * (1 << 20))
    rates = F.create_map(*[F.lit(v) for x, m in sizes.items() for v in (x, rate(m))])
    sample = train if share >= 1 else train.where(F.pmod(F.shiftright("key", 20), F.lit(1 << 20)) < F.element_at(rates, F.col(label)))
    rows = features(sample, text, label, shared)
    rare = [x for x, m in sizes.items() if m <= plan.calibrate]  # too few to be kept from training
    held = F.pmod("key", F.lit(plan.calibrate)) == 0
    of = lambda c: held & ~F.col(c).isin(rare) if rare else held

    def learn(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(own)], "w": [ftrl(own, labels, plan).astype(np.float32).tobytes()]})

    found = rows.where(~of("label")).groupBy(F.pmod(F.shiftright("key", 10), F.lit(plan.shards)).alias("shard")).applyInPandas(learn, "n long, w binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.n, bytes(r.w)))
    total = sum(r.n for r in found)
    w = sum(np.frombuffer(r.w, np.float32).reshape(BUCKETS + 1, -1).astype(float) * (r.n / total) for r in found)
    model = Model(labels, (w[:-1] * idf[:, None] * SCALE).astype(np.float32), w[-1], 1.0)
    check = logits(sample.where(of(label)).select(text, label), text, model, drop_text=True).collect()
    check = [r for r in check if r.n_letters]
    place = {x: i for i, x in enumerate(labels)}
    t = temperature(np.array([r.logits for r in check]), np.array([place[r[label]] for r in check], np.int64))
    return Model(labels, model.table, model.bias, t)


def logits(df: DataFrame, text: str, model: Model, drop_text: bool = False) -> DataFrame:
    """df with the number of letters and the logits of its texts."""
    shared = df.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def make() -> Callable:
        table, bias = shared.value

        def work(column):
            letters_, out = [], []
            for data, offsets in slices(column):
                n_letters, found = grams(data, offsets)
                docs = len(n_letters)
                total, count = np.zeros((docs, table.shape[1])), np.zeros(docs, np.int64)
                for bucket, doc in found:
                    own = np.bincount(doc, minlength=docs)
                    count += own
                    some = np.flatnonzero(own)
                    if len(some):
                        total[some] += np.add.reduceat(table[bucket], (np.cumsum(own) - own)[some], axis=0, dtype=np.float64)
                letters_.append(n_letters)
                out += (total / np.maximum(count, 1)[:, None] + bias).tolist()
            return [np.concatenate(letters_) if letters_ else [], out]

        return work

    return with_columns(df, text, [("n_letters", "bigint"), ("logits", "array<double>")], make, drop_text)


def predict(df: DataFrame, model: Model | None, text: str = "text", drop_text: bool = False) -> DataFrame:
    """df with the language of each text and its calibrated probability."""
    if model is None:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)}).drop(*[text] * drop_text)
    found = logits(df, text, model, drop_text)
    top = F.array_max("logits")
    soft = F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp((x - top) / model.temperature))
    none = F.col("n_letters") == 0
    best = F.element_at(F.array(*[F.lit(x) for x in model.labels]), F.array_position("logits", top).cast("int"))
    return found.withColumns({"lang_pred": F.when(none, UNKNOWN).otherwise(best), "score": F.when(none, 0.0).otherwise(1.0 / soft)}).drop("logits", "n_letters")


def train_on(docs: DataFrame) -> Model | None:
    """The model of the documents table: learned where crc32 of the id modulo 5 is not 0."""
    return fit(docs.where(crc_mod("doc_id", 5) != 0), "text", "lang", F.col("doc_id"))


def op2_language_id(spark, sf_dir) -> DataFrame:
    """Per document: whether its label was held out (false for a null id, which is never trained on), language, probability."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), train_on(docs), drop_text=True).select("doc_id", "held_out", "lang_pred", "score")
