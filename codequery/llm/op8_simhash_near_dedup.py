"""SimHash near-dedup by bit-sliced comparison.

Fingerprints lie in a sorted run as 64 bit planes (plane b holds bit b of every fingerprint, 64 to a word).
XOR of a plane with itself shifted by d gives that bit's difference for every pair at distance d in the run;
carry-save counters add the planes up for 64 pairs a word at once, and words of which every pair has passed
the radius are abandoned. Runs are buckets by equal parts of the fingerprint: two fingerprints at most
`radius` bits apart agree on at least one of `radius + 1` parts, so every link is found. A bucket of more than
BUCKET fingerprints is dealt into smaller ones by the parts of its other bits, for which the same holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stored, table, unused
from .components import classes, components

RADIUS = 3
SHINGLE_WORDS = 3
BUCKET = 1 << 14
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(data: bytes, width: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles of a UTF-8 text; 0 if it has no word."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < width:
        hashes = np.array([_hash(b" ".join(words))], np.uint64)
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        hashes = np.fromiter(map(_hash, grams), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).sum(0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x or b"") for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): a null text counts as empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("data")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _planes(prints: np.ndarray) -> np.ndarray:
    """(64, words + 2) uint64: bit i of word w of plane b is bit b of fingerprint 64 w + i."""
    n = len(prints)
    out = np.zeros((64, -(-n // 64) + 2), np.uint64)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = prints
    for b in range(64):
        bit = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[b, :-2] = np.packbits(bit, bitorder="little").view("<u8")
    return out


def linked(keys: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each lag, index pairs of the sorted run with equal keys whose fingerprints differ in <= radius bits."""
    n, digits = len(prints), max(1, radius.bit_length())
    planes = _planes(prints)
    for lag in range(1, n):
        same = keys[:-lag] == keys[lag:]
        if not same.any():
            return
        lanes = np.zeros(-(-n // 64) * 64, np.uint8)
        lanes[: n - lag] = same
        alive = np.packbits(lanes, bitorder="little").view("<u8").astype(np.uint64)
        words = np.flatnonzero(alive)
        alive, (skip, shift) = alive[words], divmod(lag, 64)
        count = [np.zeros(len(words), np.uint64) for _ in range(digits)]
        for b in range(64):
            plane = planes[b]
            moved = plane[words + skip]
            if shift:
                moved = (moved >> np.uint64(shift)) | (plane[words + skip + 1] << np.uint64(64 - shift))
            carry = plane[words] ^ moved
            for digit in count:  # carry-save addition of one bit to every lane's counter
                digit ^= carry
                carry &= ~digit
            alive &= ~carry  # out of the top digit: more than any allowed distance
            if b % 4 == 3 and b > 7:
                some = alive != 0
                if not some.all():
                    words, alive, count = words[some], alive[some], [c[some] for c in count]
                    if not len(words):
                        break
        if not len(words):
            continue
        on = np.unpackbits(alive.view(np.uint8), bitorder="little")
        far = sum(np.unpackbits(c.view(np.uint8), bitorder="little").astype(np.int16) << k for k, c in enumerate(count))
        hit = np.flatnonzero((on == 1) & (far <= radius))
        if len(hit):
            i = words[hit // 64] * 64 + hit % 64
            yield i, i + lag


def _spanning(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links of a run: at most a row for each fingerprint of a bucket, never all its pairs."""
    root = np.arange(len(prints))
    left, right = [], []
    for i, j in linked(keys, prints, radius):
        apart = root[i] != root[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                a, b = min(a, b), max(a, b)
                root[b] = a
                left.append(a)
                right.append(b)
        while not (root == (up := root[root])).all():
            root = up
    return prints[np.array(left, int)], prints[np.array(right, int)]


def _runs(radius: int, batch_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (used, key, fp) rows: whole buckets are handed on together, small ones many at a time."""
    keep: list[np.ndarray] = []
    held = 0

    def done(rows: np.ndarray):
        _, key = np.unique(rows[:, :2], axis=0, return_inverse=True)
        a, b = _spanning(key.ravel(), rows[:, 2].view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keep.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1))
        held += batch.num_rows
        if held >= batch_rows:
            rows = np.concatenate(keep)
            turns = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1))
            if len(turns):
                cut = turns[-1] + 1
                yield done(rows[:cut])
                keep, held = [rows[cut:]], len(rows) - cut
            else:
                keep = [rows]
    if held:
        yield done(np.concatenate(keep))


def _split(used: int, radius: int) -> list[int]:
    """Masks of the used bits and one more part of the others, which are cut into radius + 1 parts."""
    rest = [b for b in range(64) if not used >> b & 1]
    edges = [round(len(rest) * i / (radius + 1)) for i in range(radius + 2)]
    return [used | sum(1 << b for b in rest[edges[i] : edges[i + 1]]) for i in range(radius + 1)]


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def link_forest(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): a spanning forest, bucket by bucket, of all links between distinct fingerprints."""
    masks, found = _split(0, radius), None
    rows = prints.select(F.explode(F.array(*[F.lit(_long(m)) for m in masks])).alias("used"), "fp")
    key = F.col("fp").bitwiseAND(F.col("used")).alias("key")
    while True:
        rows = rows.select("used", key, "fp")
        masks = [m for m in masks if bin(m).count("1") + radius < 64]
        hot = stored(rows.groupBy("used", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).where(F.col("used").isin([_long(m) for m in masks])).drop("n"))
        seen = {r.used for r in hot.select("used").distinct().collect()}  # as many as masks at most
        masks, last = [m for m in masks if _long(m) in seen], not seen
        cold = rows if last else rows.join(hot, ["used", "key"], "left_anti")
        found = cold if found is None else found.unionByName(cold)
        if last:
            break
        next_of = F.create_map(*[x for m in masks for x in (F.lit(_long(m)), F.array(*[F.lit(_long(k)) for k in _split(m, radius)]))])
        rows = stored(rows.join(hot, ["used", "key"], "left_semi").select(F.explode(next_of[F.col("used")]).alias("used"), "fp").distinct())
        masks = sorted({k for m in masks for k in _split(m, radius)})  # two ways can lead to the same bits
    runs = found.repartition("used", "key").sortWithinPartitions("used", "key", "fp")
    return runs.mapInArrow(partial(_runs, radius, 1 << 16), "a long, b long")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row.

    Exact copies share a fingerprint and are collapsed before any comparison. Null or wordless texts have
    fingerprint zero and link like any other; a row without an id gets the smallest id of its group, null if
    it has none; repeated rows repeat in the result; no rows give no rows. Other columns are not read.
    """
    prints, grouped = _grouped(fingerprints(docs, doc_id, text), radius, bucket)
    return prints.join(grouped, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("class").alias("component_id"))


def _grouped(prints: DataFrame, radius: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints, written, and (fp, root, class) of the distinct ones; class: the least id of the group."""
    prints = stored(prints)
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(link_forest(reps.select("fp"), radius, bucket), "a", "b")
    return prints, classes(reps, found, "fp", "rep").select("fp", "root", "class")


def _with_prints(at: int, name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint((x or "").encode("utf-8", "surrogatepass")) for x in batch.column(at).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*batch.schema.names, name])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one row stays, the one with the smallest id (null ids last).

    Rows that repeat an id are rows like others: of equal ids the one with the least number stays, where numbers follow
    partitions and places in them, so that one row of a group stays and no other.
    """
    fp, row = unused("_fp", docs), unused("_row", docs)
    schema = StructType([*docs.schema.fields, StructField(fp, LongType())])
    rows = stored(docs.mapInArrow(partial(_with_prints, docs.columns.index("text"), fp), schema).withColumn(row, F.monotonically_increasing_id()))
    prints = rows.select(F.col(fp).alias("fp"), F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("rep")
    reps = stored(prints.groupBy("fp").agg(first))
    found = components(link_forest(reps.select("fp")), "a", "b")
    kept = classes(reps, found, "fp", "rep").where(F.col("rep") == F.col("class")).select(F.col("rep.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_dedup() over all documents; see there for nulls, repeats and empty tables."""
    return near_dedup(table(spark, sf_dir, "documents"))
