"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text (all documents of the training folds) are described by surface
statistics of the whole text, each cut into quantile bins of the unlabelled texts. A logistic model over the bins
minimises the non-negative unbiased risk   pi R_p(+) + max(0, R_u(-) - pi R_p(-)).   Labels 0 are never read.

The class prior pi is estimated from positives and unlabelled texts alone: a first model, of prior a half, scores both;
pi is the least ratio of the share of unlabelled texts to that of positives above a score, where enough of both lie.

Steps are Newton's on the whole risk; where its estimated negative part falls below zero, a step goes back along the
gradient of that part alone, as published. Every step sums gradient and curvature over all texts, by Spark; what
reaches the driver are sums of a size that the features fix.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, fold, on_table, stored, table

FOLDS, HELD = 3, 1
BINS = 12
DECAY = 5.0
UPPER, LOWER, DIGIT, SPACE, OTHER, HIGH = range(6)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = UPPER
_KIND[ord("a") : ord("z") + 1] = LOWER
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[128:] = HIGH
FEATURES = 22


def features(data: bytes | None) -> np.ndarray:
    """Statistics of the whole text; null counts as empty."""
    data = data or b""
    out = np.zeros(FEATURES)
    raw = np.frombuffer(data, np.uint8)
    byte = np.bincount(raw, minlength=256)
    kind = np.bincount(_KIND, byte, 6)
    words = data.split()
    n, m = max(1, len(data)), max(1, len(words))
    count = Counter(words)
    top = [c for _, c in count.most_common(5)] or [0]
    length = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    same = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 1
    lines = [x for x in data.split(b"\n") if x.strip()] or [b""]
    share = byte[byte > 0] / n
    ends = Counter(w[-1] for w in words)
    out[:6] = kind / n
    out[6:22] = [
        np.log1p(len(data)),
        np.log1p(len(words)),
        len(count) / m,
        top[0] / m,
        sum(top) / m,
        same / m,
        pairs / max(1, len(words) - 1),
        length.mean(),
        length.std(),
        length.max(),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        -(share * np.log2(share)).sum() if len(share) else 0.0,
        ends[ord("!")] / m,
        (ends[ord(".")] + ends[ord(",")]) / m,
        len(zlib.compress(data, 1)) / n,
    ]
    return out


@dataclass
class Model:
    edges: np.ndarray  # features x (bins - 1)
    weights: np.ndarray  # features x bins
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for k in range(FEATURES):
            z += self.weights[k][np.searchsorted(self.edges[k], x[:, k], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


SIZE = FEATURES * BINS + 1


def _hot(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of the bin of each feature of each row."""
    return np.stack([np.searchsorted(edges[k], x[:, k], "right") + k * BINS for k in range(FEATURES)], 1)


def _logit(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.clip(w[at].sum(1) + w[-1], -30, 30)


def _sum_of(at: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Sum over rows of slope times the row's indicator vector; the last entry is the bias."""
    return np.append(np.bincount(at.ravel(), np.repeat(slope, FEATURES), SIZE - 1), slope.sum())


def sums(w: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Of a set of rows: their number, sums of the losses of z and -z, of their gradients, and of the curvature."""
    z = _logit(w, at)
    s = 1 / (1 + np.exp(-z))
    curve = s * (1 - s)
    h = np.zeros((SIZE, SIZE))
    for k in range(0, len(at), 4096):
        x = np.zeros((len(at[k : k + 4096]), SIZE))
        x[np.arange(len(x))[:, None], at[k : k + 4096]] = 1
        x[:, -1] = 1
        h += x.T @ (x * curve[k : k + 4096, None])
    return {"n": np.array([float(len(at))]), "loss_up": np.array([np.logaddexp(0, -z).sum()]), "loss_down": np.array([np.logaddexp(0, z).sum()]), "up": _sum_of(at, s - 1), "down": _sum_of(at, s), "curve": h.ravel()}


def newton(total, prior: float, steps: int = 16, decay: float = DECAY, back: float = 1.0) -> np.ndarray:
    """Weights that minimise the non-negative risk; total(w) gives the sums() of positives and of unlabelled rows.

    A step that raises the risk, or leads to where its negative part is below zero, is halved; where it begins there, it
    goes back along the gradient of that part alone. decay is divided by the number of positives.
    """
    w = np.zeros(SIZE)
    w[-1] = np.log(prior / (1 - prior))
    best, least = w, np.inf
    last, height = None, np.inf
    for _ in range(steps):
        p, u = total(w)
        n_p, n_u = p["n"][0], u["n"][0]
        shrink = np.append(np.full(SIZE - 1, decay / n_p), 0.0)
        below = u["down"] / n_u - prior * p["down"] / n_p
        negative = u["loss_down"][0] / n_u - prior * p["loss_down"][0] / n_p
        risk = prior * p["loss_up"][0] / n_p + max(0.0, negative) + (shrink * w * w).sum() / 2
        if risk < least:
            best, least = w, risk
        if last is not None and (negative < 0 or risk > height):
            w = (w + last) / 2
        elif negative < 0:
            w = w + back * below
        else:
            last, height = w, risk
            # with the logistic loss the positives' curvature cancels: only the unlabelled rows bend the risk
            step = np.linalg.solve(u["curve"].reshape(SIZE, SIZE) / n_u + np.diag(shrink + 1e-9), prior * p["up"] / n_p + below + shrink * w)
            reach = np.sqrt(max(1e-12, step @ u["curve"].reshape(SIZE, SIZE) @ step / n_u))  # at most half of what logits move by
            if reach < 1e-3:
                break
            w = w - step * min(1.0, 0.5 / reach)
    return best if steps > 1 else w


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from histograms of scores (from 0 to 1, equal bins) of positives and of unlabelled rows.

    Above a score lie q_p of the positives and q_u of the unlabelled rows; q_u / q_p never falls below the prior but by
    chance, and is closest where few negatives score so high. The bin is chosen by its upper confidence bound.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    q_p, q_u = (np.cumsum(x[::-1]) / max(1, x.sum()) for x in (positive, unlabelled))
    some = q_p > 0
    slack = np.sqrt(np.log(40) / (2 * max(1, n_p))) + np.sqrt(np.log(40) / (2 * max(1, n_u)))
    upper = (q_u[some] + slack) / q_p[some]
    return float(min(0.99, max(0.01, (q_u[some] / q_p[some])[int(np.argmin(upper))]))) if some.any() else 0.5


def shift(scores: np.ndarray, prior: float) -> float:
    """What to add to every logit so that the share of unlabelled rows scored 0.5 or more is the prior; scores: their histogram."""
    above = np.cumsum(scores[::-1])[::-1] / max(1, scores.sum())
    k = int(np.flatnonzero(above >= prior)[-1]) if (above >= prior).any() else 0
    edge = min(max(k / len(scores), 1e-6), 1 - 1e-6)
    return float(np.log((1 - edge) / edge))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, FEATURES)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(x).tolist() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def _summed(edges: np.ndarray, w: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a partition, of positives and of all rows, as one row each."""
    total: dict[bool, dict] = {}
    for batch in batches:
        at = _hot(edges, _matrix(batch.column(0)))
        for positive, rows in ((False, at), (True, at[np.array(batch.column(1).to_pylist(), bool)])):
            own = sums(w, rows)
            total[positive] = {k: v + total[positive][k] for k, v in own.items()} if positive in total else own
    for positive, own in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([positive]), pa.array([np.concatenate([own[k] for k in sorted(own)]).tobytes()], pa.binary())], ["positive", "sums"])


def _folded(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py()) for x in rows["sums"]], axis=0)
    return pa.table({"positive": rows["positive"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _counted(edges: np.ndarray, w: np.ndarray, bins: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histograms of the scores of a partition."""
    found = np.zeros((2, bins), np.int64)
    for batch in batches:
        z = _logit(w, _hot(edges, _matrix(batch.column(0))))
        at = np.minimum((bins / (1 + np.exp(-z))).astype(np.int64), bins - 1)
        found[0] += np.bincount(at, minlength=bins)
        found[1] += np.bincount(at[np.array(batch.column(1).to_pylist(), bool)], minlength=bins)
    positive, at = np.nonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(positive > 0), pa.array(at), pa.array(found[positive, at])], ["positive", "at", "n"])


def learn(described: DataFrame, labels: DataFrame) -> Model:
    """Learns from described texts (doc_id, x): positives by label, unlabelled are all of the training folds.

    Rows without an id are not learned from; repeated rows count as often as they occur; without positives or texts the
    model scores 0.5 everywhere.
    """
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("positive", F.lit(True))
    rows = stored(described.where(fold(F.col("doc_id"), FOLDS) != HELD).join(trusted, "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")))
    if rows.where("positive").isEmpty():
        return Model(np.zeros((FEATURES, BINS - 1)), np.zeros((FEATURES, BINS)), 0.0)
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    cut = rows.agg(*[F.percentile_approx(F.col("x")[k], shares, F.lit(10_000)).alias(f"e{k}") for k in range(FEATURES)]).first()
    edges = np.array([cut[k] for k in range(FEATURES)])

    none = sums(np.zeros(SIZE), np.zeros((0, FEATURES), np.int64))

    def total(rows: DataFrame, w: np.ndarray) -> tuple[dict, dict]:
        parts = rows.select("x", "positive").mapInArrow(partial(_summed, edges, w), "positive boolean, sums binary")
        for width in (64, 1):  # the sums of 64 partitions or so meet first
            part = F.spark_partition_id() / 64 if width > 1 else F.lit(0)
            parts = parts.withColumn("g", part.cast("int")).groupBy("positive", "g").applyInArrow(on_table(_folded), "positive boolean, sums binary")
        found = {r.positive: np.frombuffer(r.sums) for r in parts.collect()}
        names = sorted(none)
        cuts = np.cumsum([len(none[k]) for k in names])[:-1]
        return tuple(dict(zip(names, np.split(found[x], cuts), strict=True)) if x in found else none for x in (True, False))

    def histograms(rows: DataFrame, w: np.ndarray, bins: int = 1000) -> np.ndarray:
        out = np.zeros((2, bins))
        counted = rows.select("x", "positive").mapInArrow(partial(_counted, edges, w, bins), "positive boolean, at long, n long")
        for r in counted.groupBy("positive", "at").agg(F.sum("n").alias("n")).collect():
            out[int(r.positive), r.at] = r.n
        return out

    # what one half of the rows teaches is tried on the other
    first, other = rows.where("half = 0"), rows.where("half = 1")
    prior = 0.5
    if not first.where("positive").isEmpty() and not other.where("positive").isEmpty():
        for _ in range(2):  # the second model tells more, as it knows more of the prior
            unlabelled, positive = histograms(other, newton(partial(total, first), prior, steps=6))
            prior = prior_of(positive, unlabelled)
    w = newton(partial(total, rows), prior)
    w[-1] += shift(histograms(rows, w, 10_000)[0], prior)
    dropped(rows)
    return Model(edges, w[:-1].reshape(FEATURES, BINS), float(w[-1]))


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the features of each whole text, written once; a null text counts as empty."""
    return stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("data")).mapInArrow(_described, "doc_id long, x array<double>"))


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = model.score(_matrix(batch.column(2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score(described: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per described text.

    Rows without an id are scored and count as not held out; with nothing to learn from every score is 0.5;
    repeated rows repeat.
    """
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return described.select("doc_id", held.alias("held_out"), "x").mapInArrow(partial(_scored, model), "doc_id long, held_out boolean, score double, predicted int")


def _accepted(model: Model, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(None if d is None else d.encode("utf-8", "surrogatepass")) for d in batch.column(at).to_pylist()]).reshape(-1, FEATURES)
        yield batch.filter(pa.array(model.score(x) >= 0.5))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored under 0.5 go; others stay as they are."""
    model = learn(describe(docs), table(spark, sf_dir, "labels"))
    return docs.mapInArrow(partial(_accepted, model, docs.columns.index("text")), docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by a model of the training folds; see there, learn() and describe() for odd input."""
    described = describe(table(spark, sf_dir, "documents"))
    return score(described, learn(described, table(spark, sf_dir, "labels")))
