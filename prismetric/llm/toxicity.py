"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import whole_text

WORD = re.compile(r"\w+")
CACHE = 100_000


@dataclass(frozen=True)
class Training:
    """rows bounds the labelled rows that the model is fitted on (those first in hash order of the id)."""

    rows: int = 16_000
    bits: int = 20
    epochs: int = 6
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0


class Features:
    """Distinct hashed unigrams, bigrams and skip-grams (one word left out) of a whole text, in lower case."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.words: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        if len(self.words) >= CACHE:
            self.words.clear()
        code = word.encode()
        got = self.words[word] = zlib.crc32(code) << 32 | zlib.adler32(code)
        return got

    def __call__(self, text: str) -> np.ndarray:
        known, make = self.words, self._hash
        words = WORD.findall(text.lower())
        h = np.fromiter((known.get(w) or make(w) for w in words), np.uint64, len(words))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        turned = (h >> np.uint64(23)) | (h << np.uint64(41))
        grams = [h, (h[:-1] ^ turned[1:]) * np.uint64(0xC2B2AE3D27D4EB4F), (h[:-2] ^ turned[2:]) * np.uint64(0x165667B19E3779F9)]
        return np.unique((np.concatenate(grams) >> self.shift).astype(np.int32))


def fit(examples: list[tuple[np.ndarray, int]], how: Training) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias): the non-zero weights. Each coordinate has a rate of its own; L1 keeps a weight at
    zero until its gradients have added up beyond l1."""
    size = 1 << how.bits
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= how.l1, 0.0, (np.sign(z) * how.l1 - z) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2))

    def bias() -> float:
        return -bias_z / ((how.beta + math.sqrt(bias_n)) / how.alpha)

    for _ in range(how.epochs):
        for at, label in examples:
            zs, ns = z[at], n[at]
            w = weight(zs, ns)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + bias())))) - label
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / how.alpha * w
            n[at] = ns + g * g
            b, old = bias(), bias_n
            bias_n += g * g
            bias_z += g - (math.sqrt(bias_n) - math.sqrt(old)) / how.alpha * b
    w = weight(z, n)
    places = np.flatnonzero(w)
    return places, w[places], bias()


def held_out(id_col: str) -> Column:
    """Whether crc32(id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, how: Training) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The model, or None without labelled rows of both kinds. At most ``how.rows`` labelled rows that are not held
    out are used; a repeated label counts once (the largest), and a repeated id by its least text. Their features meet in one task that reads them in
    hash order, so that reruns agree; the driver gets the non-zero weights."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) > 0).cast("int").alias("__label"))
    some = known.orderBy(F.xxhash64("__id"), "__id").limit(how.rows)
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    texts = texts.join(F.broadcast(some), texts["id"] == some["__id"])
    # of rows that repeat an id one text is learnt from, so that the one task has ``how.rows`` of them at most
    texts = texts.groupBy("id", F.col("__label").alias("label")).agg(F.min("text").alias("text"))
    texts = texts.select(F.xxhash64("id", "text").alias("turn"), "text", "label")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(how.bits)
        for batch in batches:
            found = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["turn", "found", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each batch's features lie in one array, which goes back to the system at the end
        turns, labels, places, ends = [], [], [], []
        for batch in batches:
            found = batch.column(1).to_pylist()
            places.append(np.frombuffer(b"".join(found), np.int32))
            ends.append(np.cumsum([len(f) // 4 for f in found]))
            turns += batch.column(0).to_pylist()
            labels += batch.column(2).to_pylist()
        if len(set(labels)) == 2:
            rows = [x for at, end in zip(places, ends, strict=True) for x in np.split(at, end[:-1])]
            order = sorted(range(len(rows)), key=lambda k: (turns[k], labels[k]))
            found, weights, bias = fit([(rows[k], labels[k]) for k in order], how)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *found.tolist()], pa.int32()), pa.array([bias, *weights.tolist()])], names=["place", "weight"])

    got = texts.mapInArrow(featured, "turn long, found binary, label int").repartition(1).mapInArrow(learn, "place int, weight double").toArrow()
    place, weight = got.column(0).to_numpy(), got.column(1).to_numpy()
    if not len(place):
        return None
    return place[place >= 0], weight[place >= 0], float(weight[place < 0][0])


Model = tuple[np.ndarray, np.ndarray, float]


class Scorer:
    """Scores texts by a model; made anew in each task from the few weights that aren't zero."""

    def __init__(self, model: Model | None, bits: int):
        self.model, self.features = model, Features(bits)
        self.dense = np.zeros(1 << bits, np.float32)
        if model:
            self.dense[model[0]] = model[1]

    def __call__(self, text: str) -> float:
        if self.model is None:
            return 0.0
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, float(self.dense[self.features(text)].sum()) + self.model[2]))))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, how: Training = Training()) -> DataFrame:
    """One row per row of ``docs``: (id, held_out, score, predicted).

    The score (0 to 1, higher: label 1 likelier) looks at the whole text only; a null text counts as empty and
    scores as the bias says. Without labelled rows of both kinds every score is 0. Repeated rows are scored
    alike; other columns are not looked at; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, how))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model.value, how.bits)
        for batch in batches:
            scores = pa.array([score(t.as_py()) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), whole_text(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(scored, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, how: Training = Training()) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, how))
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model.value, how.bits)
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py() or "") < threshold for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
