"""Operator 2: quality classifier: naive Bayes support vectors.

Indicators of n-grams (bytes, and word shapes that mark a word equal to the one before) are hashed into 2**18 buckets and
scaled by the log ratio of their smoothed class counts; a linear hinge-loss model on the scaled, length-normalised
indicators is fitted by dual coordinate descent. Training uses at most `SAMPLE` different labelled rows of each class, those
of the smallest hash of their key, and of these as many as have `SAMPLE_BUCKETS` indicators in all; every row of the table
is scored, whole, and so is every training text read.

Only the text is an input of a score. Null and empty texts have no n-grams: their score is that of the model's bias. Very
long texts are read in blocks whose edges lose no n-gram. Null labels and labels without a document are ignored; a document
with both labels counts for both; with one class only, every score is that class. Rows that repeat a doc_id and a text
count once in the fit and get equal scores; an empty table gives no rows; extra columns are kept by score().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.llm.common import mix, read_table, word_blocks, word_edges, word_hashes

BITS, BYTE_GRAMS, SHAPE_GRAMS = 18, 3, 3
SAMPLE = 3_000
#: Indicators that the sample has at most, all rows together: 4 bytes each come to the driver.
SAMPLE_BUCKETS = 20_000_000
COST, EPOCHS, SMOOTHING = 1.0, 15, 1.0
THRESHOLD = 0.3
#: score = logistic(SLOPE * (margin - MIDDLE)): kinds of bad texts are many, so those unlike the rest lie near margin 0,
#: while good texts lie near 1.
SLOPE, MIDDLE = 4.0, 0.4
#: Class of a byte: each ASCII character but letters and digits for itself, then lower, upper, digit, other.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 128


def _grams(codes: np.ndarray, orders: int, salt: int) -> list[np.ndarray]:
    """Bucket numbers of the runs of 1 to `orders` codes."""
    out, run = [], codes.astype(np.uint64) + np.uint64(salt)
    for n in range(1, orders + 1):
        if n > 1:
            run = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if not len(run):
            break
        out.append((mix(run + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def indicators(text: str | None, stamps: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Distinct buckets of a text's n-grams; stamps is scratch space of 2**BITS numbers.

    Blocks of bytes overlap by what an n-gram may reach over their edge; words are shaped block by block, but their
    n-grams are those of the whole text.
    """
    data = (text or "").encode()
    found = np.zeros(0, np.int64)

    def add(parts: list[np.ndarray]) -> None:
        nonlocal found
        every = np.concatenate([found, *parts])
        order = np.arange(len(every))
        stamps[every] = order
        found = every[stamps[every] == order]

    shapes = []
    for at, end in word_blocks(data, block):
        raw = np.frombuffer(data, np.uint8, end - at, at)
        more = np.frombuffer(data, np.uint8, min(len(data), end + BYTE_GRAMS - 1) - at, at)
        add(_grams(more.astype(np.uint64), BYTE_GRAMS, 0))
        start, stop = word_edges(raw)
        shapes.append(_CLASS[raw[start]] << np.uint64(24) | _CLASS[raw[np.minimum(start + 1, stop - 1)]] << np.uint64(16) | _CLASS[raw[stop - 1]] << np.uint64(8))
    shape = np.concatenate(shapes) if shapes else np.zeros(0, np.uint64)
    if len(shape):
        h = word_hashes(data, block)
        shape[1:] |= h[1:] == h[:-1]
        for at in range(0, len(shape), block):
            add(_grams(shape[at : at + block + SHAPE_GRAMS - 1], SHAPE_GRAMS, 1 << 40))
    return found


class Model:
    """Weights by bucket (log-count ratios times the linear model's) and a bias."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float):
        self.weights, self.bias, self.slope = weights, bias, slope

    def score(self, text: str | None, stamps: np.ndarray) -> float:
        found = indicators(text, stamps)
        margin = self.bias + (float(self.weights[found].sum()) / math.sqrt(len(found)) if len(found) else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * (margin - MIDDLE)))))


def train(rows: list[tuple[int, np.ndarray]], cost: float = COST, epochs: int = EPOCHS) -> Model:
    """Fit on (label, distinct buckets) rows: log-count ratios, then dual coordinate descent for the hinge loss."""
    size = 1 << BITS
    counts = np.full((2, size), SMOOTHING)
    for y, x in rows:
        counts[y][x] += 1
    sides = {y for y, _ in rows}
    if len(sides) < 2:
        return Model(np.zeros(size, np.float32), (1.0 if 1 in sides else -1.0) if sides else MIDDLE, 10.0)
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # Scaled indicators are made anew where a row is visited, so that the sample is held as bucket numbers only.
    scales = [1 / math.sqrt(max(1, len(x))) for _, x in rows]
    norm = [float(np.square(ratio[x]).sum()) * scale * scale + 1.0 for (_, x), scale in zip(rows, scales)]
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, y = rows[i][1], 1.0 if rows[i][0] else -1.0
            v = ratio[x] * scales[i]
            slope = y * (float(w[x] @ v) + bias) - 1
            after = min(cost, max(0.0, alpha[i] - slope / norm[i]))
            if after != alpha[i]:
                step = (after - alpha[i]) * y
                w[x] += step * v
                bias += step
                alpha[i] = after
    return Model((w * ratio).astype(np.float32), bias, SLOPE)


def learnable(key: Column) -> Column:
    """Whether a row's label may be learned: crc32 of its key as text is no multiple of 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_buckets: int = SAMPLE_BUCKETS) -> Model:
    """Train on labelled rows whose labels may be learned.

    The sampled keys are at most 2 * sample, so they are broadcast to the documents' scan; at most as many rows, of at most
    sample_buckets numbers in all, come to the driver, however often a key or a row repeats.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & learnable(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))

    def smallest(rows: DataFrame, *more: str) -> DataFrame:
        sides = [rows.where(F.col("quality") == side).orderBy(*order, *more).limit(sample) for side in (0, 1)]
        return sides[0].unionByName(sides[1])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_sum", F.md5(F.col("text").cast("binary")))
    known = texts.join(F.broadcast(smallest(usable)), "doc_id")
    chosen = smallest(known.select("doc_id", "quality", "_sum").distinct(), "_sum")
    taken = texts.join(F.broadcast(chosen), ["doc_id", "_sum"]).groupBy("doc_id", "quality", "_sum").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamps = np.zeros(1 << BITS, np.int64)
        for b in batches:
            found = [np.sort(indicators(x, stamps)).astype(np.int32) for x in b.column(3).to_pylist()]
            made = [pa.array([x.tobytes() for x in found], pa.binary()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *made], names=["doc_id", "quality", "_sum", "x", "n"])

    made = taken.select("doc_id", "quality", "_sum", "text").mapInArrow(run, "doc_id long, quality int, _sum string, x binary, n long")
    # At most 2 * sample rows, taken in turn from both classes.
    turn = F.row_number().over(Window.partitionBy("quality").orderBy(*order, "_sum"))
    before = F.sum("n").over(Window.orderBy("_turn", "quality").rowsBetween(Window.unboundedPreceding, -1))
    few = made.withColumn("_turn", turn).withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") + F.col("n") <= sample_buckets)
    got = few.select("doc_id", "quality", "_sum", "x").toArrow().combine_chunks().sort_by([(c, "ascending") for c in ("doc_id", "quality", "_sum")])
    return train([(y, np.frombuffer(x.as_buffer(), np.int32)) for y, x in zip(got["quality"].to_pylist(), got["x"])])


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with a double column `out`. Row-local; the model is 2**BITS numbers of 4 bytes, sent once per executor."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stamps = Model(*sent.value), np.zeros(1 << BITS, np.int64)
        for b in batches:
            scores = [own.score(x, stamps) for x in b.column(keep.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*keep, out])

    return df.select(*keep).mapInArrow(run, schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; columns stay as they are."""
    out = "_score"
    while out in docs.columns:
        out += "_"
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")), out=out).where(F.col(out) >= THRESHOLD).select(*docs.columns)
