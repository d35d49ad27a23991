"""Embedding near-dedup by collision-counting projections.

Within a label, vectors at cosine >= c lie at most sqrt(2 - 2c) apart on the unit sphere, so a Gaussian
projection moves them apart by a normal of that deviation. The first projection deals a label into slabs as
wide as a window that practically no such pair exceeds; on each pair of neighbouring slabs, every projection
is sorted, each query's centred window is found by binary search, its members' counters go up by one, and
the pairs whose count passes a threshold calibrated for recall are verified by exact cosine.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import on_table, stored, table
from .components import Forest, classes, components

COSINE = 0.98
PROJECTIONS = 24
RECALL = 0.9999
SLAB_SIGMAS = 4.5
WINDOW_SIGMAS = 2.5
BLOCK_ROWS = 2048


def count_threshold(m: int, sigmas: float, recall: float) -> int:
    """Largest count that a pair at the limit distance reaches with this probability."""
    p = math.erf(sigmas / math.sqrt(2))
    total = 0.0
    for t in range(m, -1, -1):
        total += math.comb(m, t) * p**t * (1 - p) ** (m - t)
        if total >= recall:
            return t
    return 0


def directions(dim: int, m: int) -> np.ndarray:
    """m Gaussian directions after the slab's own; fixed by the dimension."""
    return np.random.default_rng(dim).standard_normal((m + 1, dim))


def _unit(vectors) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _slabs(width: float, batches):
    for batch in batches:
        vectors = batch.column("embedding").to_pylist()
        slab = np.zeros(len(vectors), np.int64)
        for dim in {len(v) for v in vectors}:
            rows = [i for i, v in enumerate(vectors) if len(v) == dim]
            slab[rows] = np.floor(_unit([vectors[i] for i in rows]) @ directions(dim, 0)[0] / width)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slab)], [*batch.schema.names, "slab"])


def candidates(query: np.ndarray, data: np.ndarray, threshold: int, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose projections (a column each) meet in at least threshold query-centred windows."""
    count = np.zeros((len(query), len(data)), np.uint8)
    for q, x in zip(query.T, data.T, strict=True):
        order = np.argsort(x)
        ranked = x[order]
        low, high = np.searchsorted(ranked, q - window, "left"), np.searchsorted(ranked, q + window, "right")
        for row, a, b in zip(count, low.tolist(), high.tolist(), strict=True):
            row[order[a:b]] += 1
    return np.nonzero(count >= threshold)


def _compare(cosine: float, m: int, recall: float, rows: pa.Table) -> pa.Table:
    """For each task in the group: (v, links, root) of the vectors with a link in it."""
    sigma = math.sqrt(2 - 2 * cosine)
    threshold = count_threshold(m, WINDOW_SIGMAS, recall)
    tasks: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(rows[c].to_pylist() for c in ("label", "dim", "s1", "b1", "s2", "b2")), strict=True)):
        tasks.setdefault(key, []).append(i)
    ids, copies, slab, block = (rows[c].to_numpy() for c in ("v", "n", "slab", "block"))
    vectors = rows["embedding"]
    out: list[tuple[int, int, int]] = []
    for (_, dim, s1, b1, s2, b2), at in tasks.items():
        at = np.array(at)
        unit = _unit(vectors.take(pa.array(at)).to_pylist())
        drawn = unit @ directions(dim, m)[1:].T
        one = np.flatnonzero((slab[at] == s1) & (block[at] == b1))
        two = one if (s1, b1) == (s2, b2) else np.flatnonzero((slab[at] == s2) & (block[at] == b2))
        if not len(one) or not len(two):
            continue
        i, j = candidates(drawn[one], drawn[two], threshold, WINDOW_SIGMAS * sigma)
        i, j = one[i], two[j]
        if two is one:
            i, j = i[i < j], j[i < j]
        sure = np.concatenate([np.einsum("ij,ij->i", unit[i[k : k + 65536]], unit[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[sure], j[sure]
        links = np.bincount(i, copies[at[j]], len(at)) + np.bincount(j, copies[at[i]], len(at))
        forest = Forest()
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            forest.union(a, b)
        out += [(int(ids[at[k]]), int(links[k]), int(ids[at[forest.find(k)]])) for k in np.flatnonzero(links).tolist()]
    return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("v", "links", "root"))})


def near_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, m: int = PROJECTIONS, recall: float = RECALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Links hold between rows of one label and length with cosine >= the limit. Rows whose id, label or vector
    is null, whose vector is empty, zero or has null or non-finite components link with nothing and are their
    own component. Equal vectors of a label are compared once and counted as often as they occur; repeated
    rows count as copies; no rows give no rows. Other columns are not read.
    """
    e = F.col("embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    usable = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(usable, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64("label", "embedding")))
    distinct = rows.where("v is not null").groupBy("v", "label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    slab = "v long, label {}, embedding {}, n long, rep long, slab long".format(*(rows.schema[c].dataType.simpleString() for c in ("label", "embedding")))
    width = SLAB_SIGMAS * math.sqrt(2 - 2 * cosine)
    placed = stored(distinct.select("v", "label", "embedding", "n", "rep").mapInArrow(partial(_slabs, width), slab).withColumn("dim", F.size("embedding")))

    sizes = placed.groupBy("label", "dim", "slab").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("own"))
    by = Window.partitionBy("label", "dim").orderBy("slab").rangeBetween(-1, -1), Window.partitionBy("label", "dim").orderBy("slab").rangeBetween(1, 1)
    sizes = sizes.select("label", "dim", "slab", "own", *[F.coalesce(F.max("own").over(w), F.lit(0)).alias(c) for w, c in zip(by, ("before", "after"), strict=True)])
    dealt = placed.join(sizes, ["label", "dim", "slab"]).withColumn("block", F.pmod(F.hash("v"), F.col("own")))

    def tasks(count: str, f):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(count) - 1, F.lit(0))), f)).otherwise(F.array())

    def task(s1, b1, s2, b2):
        return F.struct(s1.alias("s1"), b1.cast("int").alias("b1"), s2.alias("s2"), b2.cast("int").alias("b2"))

    s, b = F.col("slab"), F.col("block")
    every = F.concat(tasks("own", lambda o: task(s, F.least(b, o), s, F.greatest(b, o))), tasks("after", lambda o: task(s, b, s + 1, o)), tasks("before", lambda o: task(s - 1, o, s, b)))
    sent = dealt.select("v", "label", "dim", "embedding", "n", "slab", "block", F.explode(every).alias("t")).select("v", "label", "dim", "embedding", "n", "slab", "block", "t.*")
    groups = max(1, -(-3 * placed.count() // (2 * block_rows)))
    sent = sent.withColumn("g", F.pmod(F.xxhash64("label", "dim", "s1", "b1", "s2", "b2"), F.lit(groups)))
    found = stored(sent.groupBy("g").applyInArrow(on_table(_compare, cosine, m, recall), "v long, links long, root long"))

    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    grouped = classes(placed.select("v", "rep", "n"), components(found, "v", "root"), "v", "rep")
    told = stored(grouped.join(links, "v", "left").select("v", F.col("class").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    out = rows.select("vec_id", "v").join(told, "v", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_dedup() of all embeddings; see there for nulls, repeats and empty tables."""
    return near_dedup(table(spark, sf_dir, "embeddings"))
