"""Language ID by mixture inference: each document as a mixture of languages over its n-grams.

A language is a smoothed distribution over hashed byte trigrams of lower-case letters, counted over all
rows the caller trains on. For a document, expectation-maximisation finds the proportions of the
languages that maximise the likelihood of its trigrams. The set of languages is chosen by likelihood
less ``penalty * log(trigrams)`` for each further language: of all sets, where there are at most ``EVERY_SET`` languages, but for those whose
size alone rules them out, as no set is likelier than all languages together; of more languages the sets that the languages with the largest shares of the mixture of all make, one by one. The prediction is the language with the
largest share of the chosen set, its share the score. A document that even the best language explains
worse than the uniform distribution, by three standard errors, is ``foreign``; a short text with a key
or a number in it is not.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no languages; without any training row every
document is ``und``; ties go to the language first in the alphabet; null document ids stay null; repeated rows give repeated
rows; an empty table gives no row; extra columns are ignored by ``predict`` and passed through by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import tokens

BUCKETS = 1 << 15
#: Up to so many languages all sets of them are tried.
EVERY_SET = 8
#: ASCII other than letters counts as a space.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
SCHEMA = "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>, foreign boolean"


def grams(text: str) -> np.ndarray:
    """Hashed trigrams of the text's bytes, without those that begin with two spaces."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    code = code[(code >> 8) != 0x2020]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # languages x BUCKETS


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", smoothing: float = 0.5) -> Model:
    """Count the trigrams of every row with a language; one row for each language and bucket reaches the driver."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch, held in tokens.portions(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), held):
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS, np.int64)
                total[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, n in total.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(there), pa.string()), "bucket": pa.array(there, pa.int32()), "n": pa.array(n[there], pa.int64())})

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    found = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique().tolist())
    n = np.zeros((len(languages), BUCKETS))
    if languages:
        n[[languages.index(x) for x in found["lang"]], found["bucket"].to_numpy()] = found["n"].to_numpy()
    p = (n + smoothing) / (n.sum(axis=1, keepdims=True) + smoothing * BUCKETS)
    return Model(languages, np.log(p))


def mixture(p: np.ndarray, n: np.ndarray, steps: int = 60, close: float = 1e-4) -> tuple[np.ndarray, float]:
    """Shares of the languages (rows of p) that maximise the likelihood of n trigrams of each kind, and its logarithm."""
    share = np.full(len(p), 1 / len(p))
    total = n.sum()
    for _ in range(steps):
        mixed = share @ p
        new = share * (p @ (n / mixed)) / total
        done = np.abs(new - share).max() < close
        share = new
        if done:
            break
    return share, float(n @ np.log(share @ p))


def infer(model: Model, text: str, penalty: float = 3.0) -> tuple[str, float, list[tuple[str, float]], bool]:
    """Prediction, score, the chosen languages with their shares, and whether the document is foreign."""
    if not model.languages or not any(c.isalpha() for c in text):
        return "und", 0.0, [], False
    counts = np.bincount(grams(text), minlength=BUCKETS)
    there = np.flatnonzero(counts)
    n = counts[there].astype(np.float64)
    log_p = model.log_p[:, there]
    single = log_p @ n
    best = int(single.argmax())
    total = n.sum()
    chosen, share, value = [best], np.ones(1), float(single[best])
    # The likelihood is concave in the shares: if no language gains at the best one alone, that is the maximum.
    gain = np.exp(log_p - log_p[best]) @ n / total
    cost = penalty * np.log(total + 1)
    if len(model.languages) > 1 and np.delete(gain, best).max() > 1:
        p = np.exp(log_p)
        everyone, ceiling = mixture(p, n)
        order = np.argsort(-everyone, kind="stable")
        for size in range(2, len(order) + 1):
            # Half a unit more than the mixture of all has found, which may stop short of its maximum.
            if ceiling + 0.5 - cost * (size - 1) <= value - cost * (len(chosen) - 1):
                break
            for trial in combinations(range(len(order)), size) if len(order) <= EVERY_SET else [sorted(order[:size].tolist())]:
                s, likelihood = mixture(p[list(trial)], n)
                if likelihood - cost * (size - 1) > value - cost * (len(chosen) - 1):
                    chosen, share, value = list(trial), s, likelihood
    top = int(np.argmax(share))
    ranked = sorted(((model.languages[c], float(x)) for c, x in zip(chosen, share)), key=lambda x: (-x[1], x[0]))
    mean = single[best] / total
    error = np.sqrt(max(0.0, float(log_p[best] ** 2 @ n / total - mean**2)) / total)
    return model.languages[chosen[top]], min(1.0, float(share[top])), ranked, bool(mean + 3 * error < -np.log(BUCKETS))


def predict(docs: DataFrame, model: Model, penalty: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages, foreign for every document. The model's size is its languages times 2**15."""
    spark = runtime.ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, held in tokens.portions(batches, "text"):
            found = [infer(model, x, penalty) for x in held]
            languages = [[{"lang": a, "share": s} for a, s in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found]), pa.array(languages, kind), pa.array([f[3] for f in found], pa.bool_())], names=["doc_id", "lang_pred", "score", "languages", "foreign"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents in a language of the model, with all their columns: neither ``und`` nor foreign. No shuffle."""
    spark = runtime.ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = (infer(model, x or "") for x in batch.column(at).to_pylist())
            yield batch.filter(pa.array([f[0] != "und" and not f[3] for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
