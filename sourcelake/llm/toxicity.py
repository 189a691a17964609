"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes.

A text's features are the distinct hashed character 4- to 7-grams of its
lower-cased words, each worth the log-count ratio of its bucket between toxic
and other labelled texts, scaled to unit length.  A logistic regression is fit
on them by full gradient steps: each step is a Spark job in which every
partition of the sample adds up its part of the gradient.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.common import cut, id_text, in_batches, in_parts, keep_rows, map_texts

BITS = 19
GRAMS = (4, 5, 6, 7)
#: Labelled rows that a fit uses: about so many, chosen by a hash of the key (all, if there are fewer).
SAMPLE_ROWS = 8_000
#: A bucket is a feature if its log-count ratio times the root of its count reaches this
#: (few labelled rows: if it is among the FEWEST highest).
LEAST_WEIGHT = 7.0
FEWEST = 2_000
STEPS = 40
SHRINK = 1e-4
PARTS = 6
U64 = np.uint64


def buckets(text: str) -> np.ndarray:
    """The distinct buckets of a text, ascending."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le"), dtype=np.uint32).astype(U64)
    if len(b) < min(GRAMS):
        return np.zeros(0, dtype=np.int32)
    seen = np.zeros(1 << BITS, dtype=bool)
    code = b
    for n in range(2, max(GRAMS) + 1):
        if len(b) < n:
            break
        code = code[:-1] * U64(1_000_003) + b[n - 1 :]
        if n in GRAMS:
            seen[((code + U64(n)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


class Model:
    """ratio: log-count ratio of each bucket, 0 if it is no feature; weight, bias: of the regression."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float):
        self.ratio, self.weight, self.bias = ratio, weight, bias

    def score(self, text: str) -> float:
        found = buckets(text)
        r = self.ratio[found].astype(float)
        z = float(r @ self.weight[found]) / (np.sqrt(float(r @ r)) + 1e-9) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_parts: int = 4, held_part: int = 2) -> Model:
    """Fit on rows with a label 0 or 1 that are not held out.

    A key with several labels counts as toxic if one of them is 1.  Without a row
    of both classes all scores are alike: the share of toxic rows, 0 if there is
    none.
    """
    spark = df.sparkSession
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~in_parts(F.col("doc_id"), held_parts, held_part))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    there = known.count()
    if there > SAMPLE_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * SAMPLE_ROWS / there))
    # about SAMPLE_ROWS keys at most, so a broadcast; texts stay where they are
    texts = in_batches(id_text(df, id_col, text_col)).join(F.broadcast(known), "doc_id").select("y", "text")
    # the sample is bounded, so it is dealt to few tasks, each with one count of buckets
    texts = cut(texts.repartition(PARTS))
    # a row for each bucket at most; bucket -1 counts the texts
    counts = texts.mapInArrow(counted, "b int, n long, pos long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toArrow()
    b, n_of, pos_of = (counts.column(k).to_numpy() for k in range(3))
    n1 = int(pos_of[b < 0].sum())
    n0 = int(n_of[b < 0].sum()) - n1
    size = 1 << BITS
    ratio, weight = np.zeros(size), np.zeros(size)
    share = n1 / (n0 + n1) if n0 + n1 else 0.0
    bias = float(np.log((share + 1e-12) / (1 - share + 1e-12)))
    if not n0 or not n1:
        return Model(ratio, weight, bias)
    n, pos = np.zeros(size), np.zeros(size)
    n[b[b >= 0]], pos[b[b >= 0]] = n_of[b >= 0], pos_of[b >= 0]
    del counts, b, n_of, pos_of
    ratio = np.log((pos + 1) / (n1 + 1)) - np.log((n - pos + 1) / (n0 + 1))
    strength = np.abs(ratio) * np.sqrt(n)
    ratio[strength < min(LEAST_WEIGHT, np.partition(strength, -FEWEST)[-FEWEST])] = 0
    used = np.flatnonzero(ratio)
    place = np.full(size, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    # the sample's features as positions among those in use
    sample = cut(texts.mapInArrow(lambda batches: narrowed(batches, place), "y int, found array<int>"))
    w, b, m, v = np.zeros(len(used)), bias, np.zeros(len(used)), np.zeros(len(used))
    scale = ratio[used]
    for step in range(1, STEPS + 1):
        parts = sample.mapInArrow(gradient_of(scale, w, b), "g binary, gb double").collect()  # one row a partition
        g = sum((np.frombuffer(r[0]) for r in parts), np.zeros(len(used))) / (n0 + n1) + SHRINK * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= 0.3 * sum(r[1] for r in parts) / (n0 + n1)
    weight[used] = w
    return Model(ratio.astype(np.float32), weight.astype(np.float32), b)


def counted(batches):
    """Labelled texts, and toxic ones, that have each bucket, summed over a partition."""
    n, pos, rows, toxic = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64), 0, 0
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = buckets(text)
            n[found] += 1
            pos[found] += y
            rows, toxic = rows + 1, toxic + y
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[rows, n[at]]), pa.array(np.r_[toxic, pos[at]])], names=["b", "n", "pos"])


def narrowed(batches, place: np.ndarray):
    for batch in batches:
        found = []
        for text in batch.column(1).to_pylist():
            at = place[buckets(text)]
            found.append(at[at >= 0])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["y", "found"])


def gradient_of(scale: np.ndarray, w: np.ndarray, b: float):
    """The sum of a partition's gradients, a batch at a time."""

    def run(batches):
        g, gb = np.zeros(len(scale)), 0.0
        for batch in batches:
            y = batch.column(0).to_numpy().astype(float)
            at, col = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            col = col[at[0] : at[-1]]
            row = np.repeat(np.arange(len(y)), np.diff(at))
            x = scale[col]
            x = x / (np.sqrt(np.bincount(row, weights=x * x, minlength=len(y))) + 1e-9)[row]
            z = np.bincount(row, weights=x * w[col], minlength=len(y)) + b
            off = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
            g += np.bincount(col, weights=x * off[row], minlength=len(scale))
            gb += off.sum()
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([gb])], names=["g", "gb"])

    return run


def score(df: DataFrame, model: Model, threshold: float = 0.3, held_parts: int = 4, held_part: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``df``.

    The score sees the text alone.  A null or empty text gets the score of a text
    without features; a null id is not held out.  Rows map one to one.
    """

    def make():
        return lambda texts: [pa.array([model.score(t) for t in texts], pa.float64())]

    scored = map_texts(id_text(df, id_col, text_col), make, "score double")
    return scored.select("doc_id", in_parts(F.col("doc_id"), held_parts, held_part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, with a score under the threshold."""
    return keep_rows(df, text_col, lambda: lambda texts: [model.score(t) < threshold for t in texts])
