"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character 1- to 3-grams (frequency in
the text, times inverse document frequency over all training documents).  The
model is trained by follow-the-regularised-leader with an elastic-net penalty
on a sample of training documents, bounded by ``SAMPLE_ROWS`` and taken by
hash, equally many of each label; its scores are calibrated by one
temperature, fitted on a part of the sample the training has not seen.

A text's score is a mean over its n-grams of what the model holds for each,
so texts of any length are read whole, in one pass.

Defined results: null texts and texts without a letter are ``und`` with score
0; so is every text when no labelled training document exists (``keep_identified``
then keeps all texts with a letter); rows without a label are never trained on;
rows of one doc_id and label are one document in the sample (the first by
place), and count as often as they occur in document frequencies; a null doc_id is not held out; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.collect import newest_per_group
from .common import free_name, place_of, placed
from .pretokens import text_blocks

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Documents of each label in the sample, and in the sample altogether.
PER_LABEL, SAMPLE_ROWS = 600, 12_000
#: Every so-manieth document of the sample calibrates the temperature.
CALIBRATE = 4
#: FTRL: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 3
#: Brings frequencies to a size that the learning rate suits.
SCALE = 30.0
TEXT_BYTES = 1 << 20
NO_LANGUAGE = "und"
#: Below this calibrated score a document counts as in no learned language.
LEAST_SCORE = 0.3
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of all texts' n-grams, and how many of them
    lie before each text (and in all)."""
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    for n in ORDERS:
        m = len(cp) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h + cp[j:j + m]) * _MULTIPLIERS[j]
        h ^= h >> np.uint64(29)
        h = (h * _MIX) >> np.uint64(48)
        inside = owner[:m] == owner[n - 1:]
        count = np.maximum(sizes - n + 1, 0)
        assert int(inside.sum()) == int(count.sum()) and len(ends)
        yield h[inside].astype(np.int64), np.concatenate([[0], np.cumsum(count)])


def _texts(column) -> list[str]:
    return [(t or "").lower() for t in column.to_pylist()]


def document_frequency(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents of ``train`` each bucket occurs, and their number.
    Tasks send one count per bucket; the sums are as many as the buckets."""
    def run(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for t in text_blocks(batches, TEXT_BYTES):
            texts = _texts(t.column(1))
            n += len(texts)
            parts = list(grams(texts))
            for k in range(len(texts)):
                seen = np.zeros(BUCKETS, bool)
                for h, at in parts:
                    seen[h[at[k]:at[k + 1]]] = True
                df += seen
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(k, -1), pa.int32()), pa.array(np.append(df[k], n), pa.int64())], ["bucket", "n"])

    source = train.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sums = source.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df, total = np.zeros(BUCKETS, np.int64), 0
    for bucket, n in zip(sums["bucket"].tolist(), sums["n"].tolist(), strict=True):
        if bucket < 0:
            total = n
        else:
            df[bucket] = n
    return df, total


def sample(train: DataFrame) -> DataFrame:
    """(label, order, buckets, counts) of the sampled documents."""
    train = placed(train)
    light = train.select("doc_id", F.col("lang").alias("label"), *place_of(train)).groupBy("doc_id", "label") \
        .agg(F.min(F.struct("file", "row")).alias("place")).withColumn("h", F.xxhash64("doc_id"))
    by_hash = [F.col("h"), F.col("doc_id")]
    few = newest_per_group(light, ["label"], PER_LABEL, by_hash, "doc_id")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*by_hash))   # PER_LABEL rows each
    ids = few.withColumn("order", rank).orderBy("order", "h", "label").limit(SAMPLE_ROWS).select("place.file", "place.row", "order")

    def run(batches):
        schema = pa.schema([("label", pa.string()), ("order", pa.int32()),
                            ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
        for t in text_blocks(batches, TEXT_BYTES):
            out = []
            texts = _texts(t.column(1))
            parts = list(grams(texts))
            for k, (label, order) in enumerate(zip(t.column(0).to_pylist(), t.column(2).to_pylist(), strict=True)):
                h = np.concatenate([p[at[k]:at[k + 1]] for p, at in parts])
                b, c = np.unique(h, return_counts=True)
                out.append((label, order, b.astype(np.int32), c.astype(np.int32)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    # at most SAMPLE_ROWS ids
    rows = train.select(F.col("lang").alias("label"), F.col("text").cast("string").alias("text"), *place_of(train))
    return rows.join(F.broadcast(ids), ["file", "row"]).select("label", "text", F.col("order").cast("int")).mapInArrow(
        run, "label string, order int, buckets array<int>, counts array<int>")


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray   # (buckets, labels): what an n-gram adds, idf and scale included
    bias: np.ndarray
    temperature: float


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader."""

    def __init__(self, features: int, classes: int):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1
        g = np.outer(x, p)
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[rows] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood (golden-section search)."""
    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -float(np.mean(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300))))
    lo, hi, g = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train_model(train: DataFrame) -> Model | None:
    """Fit on ``train`` (doc_id, text, lang without nulls).  None without rows."""
    rows = sorted(sample(train).collect(), key=lambda r: (r["order"], r["label"]))
    rows = [r for r in rows if r["counts"]]
    if not rows:
        return None
    df, total = document_frequency(train)
    idf = np.log((1 + total) / (1 + df)) + 1
    labels = sorted({r["label"] for r in rows})
    number = {x: k for k, x in enumerate(labels)}
    data = []
    for r in rows:
        b, c = np.array(r["buckets"]), np.array(r["counts"], float)
        x = SCALE * c / c.sum() * idf[b]
        # the last feature is the bias
        data.append((np.append(b, BUCKETS), np.append(x, 1.0), number[r["label"]], r["order"]))
    fit = [d for d in data if d[3] % CALIBRATE] or data
    rest = [d for d in data if d[3] % CALIBRATE == 0] or data
    model = Ftrl(BUCKETS + 1, len(labels))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)):
            model.learn(*fit[k][:3])
    w = model.weights(slice(None))
    logits = np.array([x @ w[b] for b, x, _, _ in rest])
    temperature = fit_temperature(logits, np.array([d[2] for d in rest]))
    return Model(labels, SCALE * idf[:, None] * w[:-1], w[-1], temperature)


@lru_cache(maxsize=1)
def _letter():
    import regex

    return regex.compile(r"\p{L}")


def _predicted(model: Model, raw: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Labels and scores of texts."""
    has = np.array([x is not None and _letter().search(x) is not None for x in raw], bool)
    texts = [(x or "").lower() for x in raw]
    total, number = np.zeros((len(texts), len(model.labels))), np.zeros(len(texts))
    for h, at in grams(texts):
        for c in range(len(model.labels)):
            total[:, c] += np.diff(np.concatenate([[0.0], np.cumsum(model.weights[h, c])])[at])
        number += np.diff(at)
    p = softmax((total / np.maximum(number, 1)[:, None] + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    lang = [model.labels[k] if ok else NO_LANGUAGE for k, ok in zip(best, has, strict=True)]
    return lang, np.where(has, p[np.arange(len(best)), best], 0.0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text)."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(NO_LANGUAGE).alias("lang_pred"),
                           F.lit(0.0).alias("score"))

    def run(batches):
        for t in text_blocks(batches, TEXT_BYTES):
            lang, score = _predicted(model, t.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.array(lang, pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))) \
        .select("doc_id", "text", F.col("lang").cast("string").alias("lang"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the rows that are not held out."""
    out = predict(docs, train_model(training_rows(docs)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model | None, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is identified: those
    with a letter and a calibrated score of ``least_score`` or more, or all with
    a letter without a model.  Texts and predictions stay in their rows, so nothing is joined."""
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    names = docs.columns
    first = free_name(names, "position")

    def run(batches):
        for t in text_blocks(batches, TEXT_BYTES):
            lang, score = _predicted(model, t.column(1).to_pylist())
            keep = np.array([x != NO_LANGUAGE for x in lang], bool) & (score >= least_score)
            for b in t.drop_columns([first]).filter(pa.array(keep)).to_batches():
                yield b

    # the second column is the text, which blocks are measured by
    source = docs.select(F.lit(None).cast("int").alias(first), F.col("text"), *[c for c in names if c != "text"])
    schema = T.StructType([docs.schema["text"], *[f for f in docs.schema if f.name != "text"]])
    return source.mapInArrow(run, schema).select(*names)
