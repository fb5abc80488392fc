"""Operator 4, language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters of the lower-cased text are hashed into BUCKETS features; tf is 1 + log(count), idf comes
from all texts that may be learned from, rows have length 1. Weights are trained with follow-the-regularised-leader (McMahan et
al. 2013), whose L1 penalty leaves most at zero and whose L2 penalty shrinks the others, on a bounded sample of labelled texts; a part of the
sample is kept back to fit the temperature of the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold_of, table, tidy

BUCKETS, GRAMS = 1 << 14, (1, 2, 3)
#: Labelled texts that weights are trained on at most, those of the least hashes, and the bytes they may have; one in HELD of them fits the
#: temperature.
FIT, FIT_BYTES, HELD = 6_000, 64 << 20, 5
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"

_plain = np.arange(128, dtype=np.uint32)
_plain[[c for c in range(128) if not chr(c).isalpha()]] = 32
_CODES = 1 << 16
_factors = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each occurs. Signs and digits count as blanks."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    codes = np.where(codes < 128, _plain[np.minimum(codes, 127)], codes)
    codes = np.concatenate(([np.uint32(32)], codes, [np.uint32(32)]))
    counts = np.zeros(BUCKETS, np.int64)
    part = np.zeros(len(codes), np.uint32)
    for n in range(max(GRAMS)):
        if len(codes) <= n:
            break
        part = part[: len(codes) - n] + codes[n:] * _factors[n]
        if n + 1 in GRAMS:
            mixed = (part ^ part >> np.uint32(15)) * np.uint32(0x2C1B3C6D + 2 * n)
            counts += np.bincount(mixed >> np.uint32(32 - 14), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS + 1 rows, the last for the bias
    temperature: float = 1.0

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, counts = features(text)
        value = (1 + np.log(counts)) * self.idf[at]
        size = np.sqrt((value * value).sum())
        return np.append(at, BUCKETS), np.append(value / size if size else value, 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, value = self.row(text)
        p = softmax((value @ self.weights[at]) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], idf: np.ndarray) -> Model:
    """FTRL-proximal with L1 and L2 penalties, one text at a time, then the temperature by golden section on texts kept back."""
    names = sorted(set(langs))
    model = Model(names, idf, np.zeros((BUCKETS + 1, len(names))))
    if len(names) < 2:
        return model
    rows = [model.row(t) for t in texts]
    y = np.array([names.index(x) for x in langs])
    held = np.arange(len(rows)) % HELD == HELD - 1
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(np.flatnonzero(~held)):
            at, value = rows[i]
            w = weights(at)
            p = softmax(value @ w)
            p[y[i]] -= 1
            g = value[:, None] * p[None, :]
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[at] = new
    model.weights = weights(np.arange(BUCKETS + 1))
    if held.any():
        logits = np.array([rows[i][1] @ model.weights[rows[i][0]] for i in np.flatnonzero(held)])
        truth = y[held]

        def loss(log_t: float) -> float:
            p = softmax(logits / np.exp(log_t))[np.arange(len(truth)), truth]
            return float(-np.log(np.maximum(p, 1e-300)).mean())

        low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, texts = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            df[features(text.as_py())[0]] += 1
            texts += 1
    if texts:
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BUCKETS)), pa.array(np.append(df[at], texts))], ["bucket", "n"])


def fit(docs: DataFrame, most: int = FIT, most_bytes: int = FIT_BYTES) -> Model:
    """A model from docs (text, lang), whose rows without text or lang count for nothing. idf is over all other rows;
    weights come from at most `most` of them and most_bytes of text, those of the least hashes; repeated rows are one there."""
    docs = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    got = docs.mapInArrow(tidy(_frequencies), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    df, total = np.zeros(BUCKETS), 0
    for r in got:
        if r["bucket"] == BUCKETS:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    hashed = docs.withColumn("h", F.xxhash64("text", "lang"))
    cut = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(cut)).dropDuplicates(["h"]) if cut is not None else hashed.limit(0)
    rows = bounded_sample(chosen, most, most_bytes)
    return train(rows["text"], rows["lang"], idf)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["row", "text", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """row (the columns of docs but text, under any names), text, lang_pred, score (calibrated probability of lang_pred).
    Null texts and texts without a letter: und, 0. So are all texts if nothing was learned. Texts of any length count as a whole. Each row comes out, repeated ones too.
    Empty table: empty result."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_predict(model)), rows.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from three of four folds; und for null texts and those without a letter."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold_of(F.col("doc_id"), 4) != 2).select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", (fold_of(F.col("row.doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
