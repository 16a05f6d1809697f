"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms of a text are hashed byte trigrams and a few marks of its form: words that repeat the word
before, capitals, runs of symbols, line breaks. Their weights are log frequencies times inverse
document frequencies over the labelled sample; a truncated singular value decomposition of the sample
gives the latent space. At most ``per_label`` labelled rows of each label are used, those with the
least hash of their id: a documented bound, so what is fitted and broadcast has a fixed size. Every
document is compared with all labelled vectors, by exact cosine products in blocks, and its
``neighbours`` nearest vote with their similarities.

Defined results: null labels are not used; a null or empty text, or one whose vector has no positive cosine, scores the mean
label of the sample; without labelled rows every score is 0.5; null document ids stay null; repeated rows give repeated rows
(labels joined to an id that occurs more than once count for each of its rows); an empty table gives no row; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import tokens

TRIGRAMS, FORMS = 4096, 16
TERMS = TRIGRAMS + FORMS
#: A mark of form weighs as much as so many trigrams of like frequency.
FORM_WEIGHT = 5
_symbols = re.compile(r"[^\w\s.,;:'\"()-]+")


def terms(text: str) -> np.ndarray:
    """Weights of a text's terms before inverse document frequencies."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    raw = np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    code = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    n = np.bincount(code, minlength=TRIGRAMS)
    out[:TRIGRAMS] = np.log1p(n * (1000.0 / len(raw)))
    words = text.split()
    size = max(1, len(words))
    lines = text.split("\n")
    form = (
        sum(a == b for a, b in zip(words, words[1:])) / size,
        1 - len(set(words)) / size,
        sum(w.isupper() and len(w) > 1 for w in words) / size,
        len(_symbols.findall(text)) / size,
        sum(not any(c.isalnum() for c in w) for w in words) / size,
        sum(any(c.isdigit() for c in w) for w in words) / size,
        1 - len(set(lines)) / len(lines),
        min(1.0, len(lines) / size),
        min(1.0, 5 / size),
        min(1.0, sum(map(len, words)) / size / 20),
        sum(text.count(c) for c in ".!?") / size,
    )
    out[TRIGRAMS : TRIGRAMS + len(form)] = FORM_WEIGHT * np.log1p(1000 * np.array(form, np.float32))
    return out


@dataclass
class Model:
    weight: np.ndarray  # TERMS: inverse document frequencies
    project: np.ndarray  # TERMS x dimensions
    vectors: np.ndarray  # sample x dimensions, of length 1
    labels: np.ndarray
    neighbours: int

    @property
    def mean(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def embed(self, x: np.ndarray) -> np.ndarray:
        y = (x * self.weight) @ self.project
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Votes for a block of documents' terms."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        near = self.embed(x) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.tile(np.arange(k), (len(near), 1))
        w = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64)
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-12), self.mean)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = 2000, dimensions: int = 64, neighbours: int = 15, seed: int = 5) -> Model:
    """Fit on at most ``per_label`` rows of each of the labels 0 and 1, chosen by the hash of their id.

    The sample is drawn from the labels, so it is bounded before it is broadcast to meet the texts.
    """
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in tokens.portions(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([terms(x).astype(np.float16).tobytes() for x in held], pa.binary())], names=["label", "hash", "terms"])

    marked = labels.select(F.col(label_col).cast("int").alias("label"), F.col(id_col).cast("long").alias("id")).where("id is not null").withColumn("hash", F.xxhash64("id"))
    sample = None
    for label in (0, 1):
        some = marked.where(F.col("label") == label).orderBy("hash").limit(per_label)
        sample = some if sample is None else sample.unionByName(some)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").select("label", "hash", "text")
    held = rows.mapInArrow(run, "label int, hash long, terms binary").orderBy("hash", "terms").limit(2 * per_label).collect()
    x = [np.frombuffer(r["terms"], np.float16).astype(np.float32) for r in held]
    labels = [r["label"] for r in held]
    if not x:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours)
    x = np.stack(x)
    weight = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    y = x * weight
    # Truncated singular value decomposition by a random range, refined twice.
    rng = np.random.default_rng(seed)
    rank = min(dimensions, len(x))
    q = np.linalg.qr(y.T @ (y @ rng.standard_normal((TERMS, rank + 10)).astype(np.float32)))[0]
    for _ in range(2):
        q = np.linalg.qr(y.T @ (y @ q))[0]
    right = np.linalg.svd(y @ q, full_matrices=False)[2][:rank]
    project = (q @ right.T).astype(np.float32)
    model = Model(weight, project, np.zeros((0, rank), np.float32), np.array(labels, np.float64), neighbours)
    model.vectors = model.embed(x)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", block: int = 128) -> DataFrame:
    """doc_id, score for every document."""
    spark = runtime.ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, held in tokens.portions(batches, "text"):
            votes = []
            for k in range(0, len(held), block):
                x = np.stack([terms(t) for t in held[k : k + block]])
                v = model.score(x)
                votes.append(np.where(x.any(axis=1), v, model.mean))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(np.concatenate(votes), 0, 1))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
