"""Text quality by a factorisation machine.

Features of a text: hashed words (log frequency, unit length), structure statistics cut into bins, and
metadata that the text itself gives (its length class). A second-order machine scores them as
w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), linear in the number
of features, and a logistic gives the score. Labels, language, source and ids are never features.

Training takes the labelled rows that are not held out, at most ``max_rows`` of them, those with the
least hashes of their ids: a bound on the driver's work that does not depend on the input's size.
Scoring reads every row. Null and empty texts have structure features only and are scored like any other. A null
id is never held out and never labelled. Repeated rows are scored each. Without usable labels every
score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.session import table

WORDS = 1 << 15
BINS = 12
LINES = b"\n"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def structure(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Shares in [0, 1] and log sizes scaled to about that."""
    size, n = max(1, len(raw)), max(1, len(words))
    letters = sum(map(len, words)) or 1
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = len(raw) - len(raw.translate(None, PUNCTUATION))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>{}[]=\\^~_@"))
    stops = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    lines = [x for x in raw.split(LINES) if x.strip()]
    again = len(lines) - len(set(lines))
    top = counts.most_common(1)[0][1] if counts else 0
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        upper / (upper + lower + 1), digits / size, marks / size, symbols / size, min(1.0, 10 * stops / n), raw.count(b"|") / n,
        again / max(1, len(lines)), top / n, len(counts) / n, pairs / n, min(1.0, letters / n / 16), min(1.0, np.log1p(n) / 12),
        min(1.0, np.log1p(n / max(1, len(lines))) / 8), raw.count(b"!") / n, raw.count(b",") / n, (size - len(raw.decode(errors="ignore"))) / size,
    ]


N_STRUCTURE = 16
SIZE = WORDS + N_STRUCTURE * (BINS + 1)


def features(text: str | None, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values); ``known`` keeps the bucket of a word."""
    raw = (text or "").encode()
    words = raw.split()
    counts = Counter(words)
    if len(known) > 1_000_000:
        known.clear()
    index = []
    for word in counts:
        bucket = known.get(word)
        if bucket is None:
            bucket = known[word] = zlib.crc32(word) % WORDS
        index.append(bucket)
    value = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    value /= np.sqrt((value**2).sum()) or 1
    shape = np.array(structure(raw, words, counts), np.float32)
    place = WORDS + np.arange(N_STRUCTURE) * (BINS + 1)
    binned = place + 1 + np.minimum((np.sqrt(shape) * BINS).astype(int), BINS - 1)
    at = np.concatenate((np.array(index, np.int32), place.astype(np.int32), binned.astype(np.int32)))
    return at, np.concatenate((value, shape, np.full(N_STRUCTURE, 0.25, np.float32)))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # (SIZE,)
    factors: np.ndarray  # (SIZE, rank)

    def margins(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows follow each other in at and value, each from its start; no row is empty."""
        scaled = self.factors[at] * value[:, None]
        total = np.add.reduceat(scaled, starts)
        squares = np.add.reduceat(scaled**2, starts)
        return self.bias + np.add.reduceat(self.linear[at] * value, starts) + 0.5 * (total**2 - squares).sum(axis=1)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        starts = np.cumsum([0, *(len(a) for a, _ in rows)])[:-1]
        z = self.margins(np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 6, steps: int = 300, rate: float = 0.02, ridge: float = 1e-5, seed: int = 7) -> Machine:
    """Mini-batch Adam on the logistic loss, over the rows ``epochs`` times and for ``steps`` batches at least."""
    draw = np.random.default_rng(seed)
    mean = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    model = Machine(float(np.log(mean / (1 - mean))), np.zeros(SIZE, np.float32), draw.normal(0, 0.02, (SIZE, rank)).astype(np.float32))
    if not 0 < labels.sum() < len(labels):
        return model
    state = [np.zeros_like(x) for x in (model.linear, model.linear, model.factors, model.factors)]
    step = 0
    for _ in range(max(epochs, -(-steps // -(-len(rows) // 256)))):
        order = draw.permutation(len(rows))
        for lo in range(0, len(order), 256):
            part = order[lo : lo + 256]
            step += 1
            sizes = np.array([len(rows[i][0]) for i in part])
            at = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            starts = np.cumsum([0, *sizes])[:-1]
            z = model.margins(at, value, starts)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            each = np.repeat(error, sizes).astype(np.float32)
            scaled = model.factors[at] * value[:, None]
            total = np.repeat(np.add.reduceat(scaled, starts), sizes, axis=0)
            slopes = (each * value)[:, None] * (total - scaled)
            model.bias -= rate * float(error.sum())
            used, where = np.unique(at, return_inverse=True)
            for x, m, v, g in ((model.linear, state[0], state[1], each * value), (model.factors, state[2], state[3], slopes)):
                grad = np.zeros((len(used), *x.shape[1:]), np.float32)
                np.add.at(grad, where, g)
                grad += ridge * x[used]
                m[used] = 0.9 * m[used] + 0.1 * grad
                v[used] = 0.99 * v[used] + 0.01 * grad**2
                x[used] -= rate * (m[used] / (1 - 0.9**step)) / (np.sqrt(v[used] / (1 - 0.99**step)) + 1e-6)
    return model


def remainder(id_col: str):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        found = [features(x.as_py(), known) for x in batch.column(1)]
        at = pa.array([a for a, _ in found], pa.list_(pa.int32()))
        value = pa.array([v for _, v in found], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), at, value], names=["label", "at", "value"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 12_000) -> Machine:
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (remainder(id_col) != 0))
    one = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    sample = one.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # at most max_rows rows, so it can be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    once = texts.groupBy("_id").agg(F.first("_label").alias("_label"), F.min("_text").alias("_text"))
    rows = once.select(F.col("_label").cast("int"), "_text").mapInArrow(_featurise, "label int, at array<int>, value array<float>").toArrow()
    pairs = [(np.array(a.values, np.int32), np.array(v.values, np.float32)) for a, v in zip(rows.column("at"), rows.column("value"), strict=True)]
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), pairs[i][0].tobytes()))  # partitions come in any order
    return fit([pairs[i] for i in order], rows.column("label").to_numpy()[order].astype(float))


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score) for every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # fixed size: SIZE rows of rank + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        machine = sent.value
        for batch in batches:
            rows = [features(x.as_py(), known) for x in batch.column(2)]
            found = np.concatenate([machine.scores(rows[k : k + 64]) for k in range(0, len(rows), 64)]) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.astype(float))], names=["doc_id", "held_out", "score"])

    held = F.coalesce(remainder(id_col) == 0, F.lit(False)).alias("held_out")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
