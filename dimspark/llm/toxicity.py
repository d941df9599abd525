"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams of 4 to 6 characters of its lower-case
form, hashed to 2**20 numbers. Each feature's value is the log ratio of its smoothed
frequencies in toxic and other labelled texts; the `n_features` that tell the classes
apart best (by their standard score) enter a logistic regression with an L2 penalty.

The classifier is fitted on a bounded sample: at most `sample_rows` labelled documents, the
first by a hash of their ids. Every document is scored, by its whole text and nothing else.

Defined results: a null text is an empty one, whose score is that of the intercept; without
labels of both classes every score is the share of toxic labels (0 without any); of several
labels of a document the highest counts; null labels and ids are not learnt from; repeated
rows get the same score; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from dimspark.llm.common import read_table, settle

BITS = 20
ORDERS = (4, 5, 6)
SAMPLE_ROWS, N_FEATURES, LEAST_TEXTS = 12_000, 4_000, 3


def hashes(text: str, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """The hashed n-grams of a text, as they come, repeats included."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(orders) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in orders:
            mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            found.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Classifier:
    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def scorer(self):
        place = np.zeros(1 << BITS, np.int32)
        place[self.features] = np.arange(1, len(self.features) + 1)

        def score(text: str | None) -> float:
            at = place[hashes(text or "")]
            z = float(self.weights[np.unique(at[at > 0]) - 1].sum()) + self.intercept
            return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def log_count_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, smooth: float = 1.0) -> np.ndarray:
    return np.log((pos + smooth) / (n_pos + 2 * smooth)) - np.log((neg + smooth) / (n_neg + 2 * smooth))


def fit_weights(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, penalty: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled features by adaptive gradient steps; weights come with the ratios in them."""
    n, k = len(rows), len(ratios)
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    share = y.mean()
    w, b = np.zeros(k), math.log(share / (1 - share))
    seen_w, seen_b = np.zeros(k), 0.0
    for _ in range(steps):
        z = np.bincount(row, (w * ratios)[at], n) + b
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        gw, gb = np.bincount(at, error[row], k) * ratios / n + penalty * w, float(error.mean())
        seen_w, seen_b = seen_w + gw * gw, seen_b + gb * gb
        w, b = w - 0.3 * gw / np.sqrt(seen_w + 1e-12), b - 0.3 * gb / math.sqrt(seen_b + 1e-12)
    return w * ratios, b


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = N_FEATURES, doc_id: str = "doc_id", text: str = "text") -> Classifier:
    """labels: doc_id and toxic (0 or 1), those that may be learnt from."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64(doc_id), doc_id).limit(sample_rows)
    texts = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("body")).join(F.broadcast(chosen), doc_id)
    one = texts.groupBy(doc_id, "toxic").agg(F.min(F.struct(F.xxhash64("body").alias("h"), "body"))["body"].alias("body"))
    sample = settle(one.select("body", "toxic").repartition(24))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    none = np.zeros(0, np.int64)
    if not n_pos or not n_neg:
        share = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.0
        return Classifier(none, none.astype(float), 500.0 if share == 1 else -500.0)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((2, 1 << BITS), np.int32)
        for part in parts:
            for body, toxic in zip(part["body"], part["toxic"]):
                held[toxic, np.unique(hashes(body))] += 1
        at = np.flatnonzero(held.any(0))
        yield pd.DataFrame({"feature": at, "neg": held[0, at], "pos": held[1, at]})

    counts = sample.mapInPandas(count, "feature int, neg int, pos int").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    share = n_pos / (n_pos + n_neg)
    expected = (F.col("pos") + F.col("neg")) * F.lit(share)
    strength = F.abs(F.col("pos") - expected) / F.sqrt(expected * F.lit(1 - share))
    best = counts.where(F.col("pos") + F.col("neg") >= LEAST_TEXTS).orderBy(strength.desc(), "feature").limit(n_features).toPandas()
    features = best["feature"].to_numpy()
    ratios = log_count_ratios(best["pos"].to_numpy(float), best["neg"].to_numpy(float), n_pos, n_neg)

    def present(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.zeros(1 << BITS, np.int32)
        place[features] = np.arange(1, len(features) + 1)
        for part in parts:
            held = []
            for body in part["body"]:
                at = place[hashes(body)]
                held.append((np.unique(at[at > 0]) - 1).astype("<i4").tobytes())
            yield pd.DataFrame({"toxic": part["toxic"].astype("int32"), "at": held})

    rows = sample.mapInPandas(present, "toxic int, at binary").collect()
    rows.sort(key=lambda r: (r["toxic"], bytes(r["at"])))
    weights, intercept = fit_weights([np.frombuffer(bytes(r["at"]), "<i4").astype(np.int64) for r in rows], np.array([r["toxic"] for r in rows], float), ratios)
    return Classifier(features, weights, intercept)


def score(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted of each row."""
    held = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = held.value.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    scored = docs.select(doc_id, pandas_udf(run, "double")(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id"):
    """Whether a row's labels are kept for testing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out())
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
