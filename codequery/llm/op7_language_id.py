"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte 2-, 3- and 4-grams of the whole text, A-Z lower-cased, each hashed into a bucket with an
embedding. A text is the mean of its embeddings; a softmax layer reads it. Training is stochastic gradient
descent in numpy on a bounded sample (SAMPLE_DOCS labelled documents), in one task; part of it calibrates the
temperature of the scores and the score below which a prediction is rejected. For prediction the two linear layers are
one table, which is all that the driver gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, sampled, table

FOLDS, HELD = 4, 2
SAMPLE_DOCS = 3000
BITS = 14
DIM = 16
UNKNOWN = "und"
REJECTED_SHARE = 0.001
_letter = regex.compile(r"\p{L}")
_MIX = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}
_MODEL = pa.schema([("langs", pa.list_(pa.string())), ("table", pa.binary()), ("bias", pa.binary()), ("temperature", pa.float64()), ("threshold", pa.float64())])


def bag(data: bytes, bits: int = BITS) -> np.ndarray:
    """Counts of the hashed byte n-grams of a text."""
    b = np.frombuffer(data.lower(), np.uint8)
    out = np.zeros(1 << bits, np.int64)
    for start in range(0, max(0, len(b) - 1), 1 << 20):
        part = b[start : start + (1 << 20) + 3].astype(np.uint32)
        gram = part
        for n in (2, 3, 4):
            if len(part) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | part[n - 1 :]
            own = gram[: 1 << 20]  # the rest begins in the next stretch
            out += np.bincount((own * np.uint32(_MIX[n])) >> np.uint32(32 - bits), minlength=1 << bits)
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / max(1, counts.sum()) + self.bias

    def rejects(self, lang: str, score: float) -> bool:
        return lang == UNKNOWN or score < self.threshold

    def predict(self, data: bytes | None) -> tuple[str, float]:
        if data is None or not self.langs or not _letter.search(data.decode("utf-8", "replace")):
            return UNKNOWN, 0.0
        z = self.logits(bag(data)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.langs[int(p.argmax())], float(p.max())


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 7, epochs: int = 12, rate: float = 8.0) -> Model:
    """bags: (bucket, count) of each text. A fifth calibrates, the rest trains."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    calibrating, training = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    top = rng.normal(0, 0.5, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    shares = [(c / max(1, c.sum())).astype(np.float32) for _, c in bags]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(training):
            at, share = bags[i][0], shares[i]
            z = share @ emb[at]
            logit = z @ top + bias
            g = np.exp(logit - logit.max())
            g /= g.sum()
            g[y[i]] -= 1
            back = top @ g
            top -= 0.05 * step * np.outer(z, g)
            bias -= 0.002 * step * g
            emb[at] -= step * np.outer(share, back)
    model = Model(names, emb @ top, bias)
    if len(calibrating) >= 10:
        z = np.array([model.logits(np.bincount(bags[i][0], bags[i][1], 1 << BITS)) for i in calibrating])
        scores = {}
        for t in np.geomspace(0.05, 20, 60):
            p = np.exp((z - z.max(1, keepdims=True)) / t)
            p /= p.sum(1, keepdims=True)
            scores[t] = (-np.log(np.maximum(p[np.arange(len(p)), y[calibrating]], 1e-12)).mean(), p.max(1))
        model.temperature = float(min(scores, key=lambda t: scores[t][0]))
        # between what known texts reach and what bags of no language do (buckets drawn at random): over most of the
        # latter, but never over what more than a small share of known texts falls short of
        known = scores[model.temperature][1]
        odd = np.array([model.logits(np.bincount(rng.permutation(1 << BITS)[: len(bags[i][0])], bags[i][1], 1 << BITS)) for i in calibrating]) / model.temperature
        odd = np.exp(odd - odd.max(1, keepdims=True))
        odd = (odd / odd.sum(1, keepdims=True)).max(1)
        model.threshold = float(min(np.quantile(odd, 0.9), np.quantile(known, REJECTED_SHARE)))
    return model


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of a partition's languages and texts, as one row."""
    got = []
    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = bag(data)
            at = np.flatnonzero(counts)
            got.append((lang, at.astype("<u2").tobytes(), counts[at].astype("<u4").tobytes()))
    got.sort()
    model = train([(np.frombuffer(a, "<u2"), np.frombuffer(c, "<u4")) for _, a, c in got], [x for x, _, _ in got])
    yield pa.RecordBatch.from_pylist([{"langs": model.langs, "table": model.table.tobytes(), "bias": model.bias.tobytes(), "temperature": model.temperature, "threshold": model.threshold}], _MODEL)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from at most sample_docs rows of the training folds that have a text, the first by the hash of id and language.

    Rows that repeat an id and its language count once; rows without an id, text or language are not learned from.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("data"), F.col(lang).cast("string").alias("lang"))
    usable = (fold(F.col("doc_id"), FOLDS) != HELD) & F.col("lang").isNotNull() & F.col("data").isNotNull()
    few = sampled(rows.where(usable), sample_docs, "doc_id", "lang").select("lang", "data").coalesce(1)
    got = few.mapInArrow(_taught, "langs array<string>, table binary, bias binary, temperature double, threshold double").first()
    if got is None or not got.langs:
        return train([], [])
    return Model(got.langs, np.frombuffer(got.table, np.float32).reshape(-1, len(got.langs)), np.frombuffer(got.bias, np.float32), got.temperature, got.threshold)


def _predicted(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [model.predict(x) for x in batch.column(2).to_pylist()]
        gone = [model.rejects(x, s) for x, s in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array(gone, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): one row per input row; und and 0 for texts that are null or have no letter.

    rejected: und, or a score under the calibrated limit; the prediction is given all the same. With nothing to learn from every row is und. Rows without an id are predicted and count as not held out;
    repeated rows repeat; other columns are not read.
    """
    key = F.col(doc_id).cast("long")
    held = F.coalesce(fold(key, FOLDS) == HELD, F.lit(False))
    return docs.select(key.alias("doc_id"), held.alias("held_out"), F.col(text).cast("binary").alias("data")).mapInArrow(partial(_predicted, model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def _accepted(model: Model, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [model.predict(None if x is None else x.encode()) for x in batch.column(at).to_pylist()]
        yield batch.filter(pa.array([not model.rejects(x, s) for x, s in found], pa.bool_()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of no recognisable language, or under the calibrated score, go; others stay as they are."""
    return docs.mapInArrow(partial(_accepted, learn(docs), docs.columns.index("text")), docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predict() over all documents by a model of the training folds; see there for nulls, repeats and empty tables."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
