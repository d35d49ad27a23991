"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are dealt into shards of bounded size. On every shard several islands, each a Spark group of its own,
evolve packings in epochs: crossover injects whole well-filled bins of one parent into the other, drops the bins that
now repeat pieces, lets bins give pieces for displaced ones that fill them better, and places the rest by best fit.
After each epoch the islands' elites migrate to all islands of the shard, and in the end the best packing is kept.

Pieces that fill a sequence alone and bins that every parent shares are left out of the search: they cannot gain.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_table, stored, table

CAPACITY = 1024
END_ID = 2
SHARD_PIECES = 16_384
ISLANDS, EPOCHS, MEMBERS, BIRTHS = 2, 2, 4, 12
#: Bins that a child opens besides those that repeat pieces: the emptiest ones and others that are not full.
OPENED = 6
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str):
    """Encoder by the same vocabulary's ranks, about four times as fast as the JSON file's own library.

    That library itself takes the texts that hold a special token's string, where the two differ.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(json_path)
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.uint32, copy=False)

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: whole if it fits, else the first takes the remainder."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces(json_path: str, ranks_path: str, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = _encoder(json_path, ranks_path)
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
            rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    paths = json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_pieces, *map(str, paths), capacity), PIECES)


Bins = list[list[int]]


def best_fit(sizes: list[int], order, capacity: int, bins: Bins) -> Bins:
    """Put the items, in this order, each into the fullest bin that still takes it; bins is extended in place."""
    levels: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k, items in enumerate(bins):
        free = capacity - sum(sizes[i] for i in items)
        levels[free].append(k)
        mask |= 1 << free
    for item in order:
        size = sizes[item]
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            k = levels[free].pop()
            if not levels[free]:
                mask ^= 1 << free
            bins[k].append(item)
        else:
            free, k = capacity, len(bins)
            bins.append([item])
        levels[free - size].append(k)
        mask |= 1 << (free - size)
    return bins


def fitness(bins: Bins, sizes: list[int]) -> tuple[int, int]:
    """Fewer bins first, then fuller ones; smaller is better."""
    return len(bins), -sum(sum(sizes[i] for i in items) ** 2 for items in bins)


def _offers(pool: list[int], sizes: list[int], capacity: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Sums of one or two displaced pieces, rising, and which they are."""
    s = np.array([sizes[i] for i in pool])
    a, b = np.triu_indices(len(pool), 1)
    total = np.concatenate([s, s[a] + s[b]])
    order = np.argsort(total, kind="stable")
    order = order[total[order] <= capacity]
    who = [(k,) for k in range(len(pool))] + list(zip(a.tolist(), b.tolist(), strict=True))
    return total[order].tolist(), [who[k] for k in order.tolist()]


def exchanged(bins: Bins, displaced: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Let each bin give up to two pieces for one or two displaced ones that fill it best; gives what is displaced then."""
    pool = sorted(displaced, key=sizes.__getitem__)
    total, who = _offers(pool, sizes, capacity)
    for items in bins:
        if not pool:
            break
        free = capacity - sum(sizes[i] for i in items)
        if not free:
            continue
        gain, give, take = 0, (), ()
        n = len(items)
        for out in [(), *((i,) for i in range(n)), *((i, j) for i in range(n) for j in range(i))]:
            room = sum(sizes[items[i]] for i in out)
            at = bisect_right(total, room + free) - 1
            if at >= 0 and total[at] - room > gain:
                gain, give, take = total[at] - room, out, who[at]
        if gain:
            given = [items[i] for i in give]
            items[:] = [x for i, x in enumerate(items) if i not in give] + [pool[k] for k in take]
            pool = sorted([x for k, x in enumerate(pool) if k not in take] + given, key=sizes.__getitem__)
            if pool:
                total, who = _offers(pool, sizes, capacity)
    return pool


def crossed(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: np.random.Generator, opened: int = OPENED) -> Bins:
    """A child of a with whole well-filled bins of b that a does not have."""
    own = {frozenset(items) for items in a}
    fill = np.array([sum(sizes[i] for i in items) for items in b])
    limit = np.quantile(fill, 0.5)
    good = [k for k in range(len(b)) if fill[k] >= limit and frozenset(b[k]) not in own]
    given = [b[k] for k in rng.choice(good, int(rng.integers(1, min(len(good), 8) + 1)), replace=False)] if good else []
    inside = {i for items in given for i in items}
    child, displaced = [list(items) for items in given], []
    for items in a:
        if inside.isdisjoint(items):
            child.append(list(items))
        else:
            displaced += [i for i in items if i not in inside]
    # the emptiest bin is opened, and a few others that are not full
    free = np.array([capacity - sum(sizes[i] for i in items) for items in child])
    drop = {int(free.argmax())} | set(rng.permutation(np.flatnonzero(free))[: int(rng.integers(1, opened + 1))].tolist())
    for k in drop:
        displaced += child[k]
    child = [child[k] for k in rng.permutation(len(child)).tolist() if k not in drop]
    rest = exchanged(child, displaced, sizes, capacity)
    return best_fit(sizes, sorted(rest, key=lambda i: -sizes[i]), capacity, child)


def evolve(population: list[Bins], sizes: list[int], capacity: int, rng: np.random.Generator, births: int) -> list[Bins]:
    """The population after so many births, best first; it ends early at the lower bound.

    The search works on the bins that are not full in every parent, and on pieces that do not fill a bin alone.
    """
    bound = -(-sum(sizes) // capacity)
    if min(map(len, population)) <= bound or len(population) < 2:
        return sorted(population, key=lambda p: fitness(p, sizes))
    shared = set.intersection(*({frozenset(items) for items in p} for p in population))
    fixed = [sorted(items) for items in shared if sum(sizes[i] for i in items) == capacity]
    apart = {i for items in fixed for i in items}
    population = [[items for items in p if items[0] not in apart] for p in population]
    ranked = sorted(((fitness(p, sizes), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    for birth in range(births):
        if ranked[0][0][0] + len(fixed) <= bound:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = crossed(ranked[a][2], ranked[b][2], sizes, capacity, rng)
        value = fitness(child, sizes)
        if value < ranked[-1][0] and all(value != r[0] for r in ranked):
            ranked = sorted([*ranked[:-1], (value, -birth, child)], key=lambda x: x[:2])
    return [fixed + p for _, _, p in ranked]


def seeds(sizes: list[int], capacity: int, rng: np.random.Generator, members: int) -> list[Bins]:
    """Best fit by falling size, exactly and with jitter; one member is enough where it meets the lower bound."""
    s = np.array(sizes)
    first = best_fit(sizes, np.argsort(-s, kind="stable").tolist(), capacity, [])
    if len(first) <= -(-sum(sizes) // capacity):
        return [first]
    return [first, *(best_fit(sizes, np.argsort(-(s * rng.uniform(0.8, 1.2, len(s))), kind="stable").tolist(), capacity, []) for _ in range(members - 1))]


ORDER = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]


def _numbers(bins: Bins, n: int) -> np.ndarray:
    at = np.empty(n, np.int64)
    for k, items in enumerate(bins):
        at[items] = k
    return at


def _member(shard: int, island: int, elites: list[np.ndarray], capacity: int, members: int, births: int, sizes: list[int], epoch: int) -> np.ndarray:
    """An island's best packing after an epoch that begins with the elites of the last one, or with seeds."""
    rng = np.random.default_rng([shard, island, epoch])
    if not elites:
        return _numbers(evolve(seeds(sizes, capacity, rng, members), sizes, capacity, rng, births)[0], len(sizes))
    population = []
    for numbers in elites:
        bins: dict[int, list[int]] = {}
        for i, k in enumerate(numbers.tolist()):
            bins.setdefault(k, []).append(i)
        population.append(list(bins.values()))
    if min(map(len, population)) > -(-sum(sizes) // capacity):
        population += seeds(sizes, capacity, rng, max(1, members - len(population)))[1:]
    return _numbers(evolve(population, sizes, capacity, rng, births)[0], len(sizes))


def _epoch(capacity: int, members: int, births: int, epoch: int, rows: pa.Table) -> pa.Table:
    """One island's epoch: its shard's pieces, each with the bins that the elites of the last epoch put it into."""
    rows = rows.sort_by(ORDER)
    before = np.array(rows["bins"].to_pylist(), np.int64).reshape(rows.num_rows, -1)
    elites = list({x.tobytes(): x for x in before.T}.values())
    best = _member(rows["shard"][0].as_py(), rows["island"][0].as_py(), elites, capacity, members, births, rows["length"].to_pylist(), epoch)
    return rows.drop_columns(["bins"]).append_column("bin", pa.array(best))


def _migrated(islands: int, rows: pa.Table) -> pa.Table:
    """The elites of a shard's islands, handed to each of its islands."""
    each = [rows.filter(pc.equal(rows["island"], i)).sort_by(ORDER) for i in sorted(set(rows["island"].to_pylist()))]
    bins = np.stack([x["bin"].to_numpy() for x in each], 1)
    found = each[0].drop_columns(["island", "bin"]).append_column("bins", pa.array(bins.tolist(), pa.list_(pa.int64())))
    return pa.concat_tables([found.append_column("island", pa.array([i] * found.num_rows, pa.int32())) for i in range(islands)])


def _placed(rows: pa.Table) -> pa.Table:
    """The best of the elites, as numbered sequences with offsets."""
    rows = rows.sort_by(ORDER)
    sizes, shard = rows["length"].to_pylist(), rows["shard"][0].as_py()
    packings = []
    for numbers in np.array(rows["bins"].to_pylist(), np.int64).reshape(len(sizes), -1).T:
        bins: dict[int, list[int]] = {}
        for i, k in enumerate(numbers.tolist()):
            bins.setdefault(k, []).append(i)
        packings.append(list(bins.values()))
    best = min(packings, key=lambda p: fitness(p, sizes))
    offset = np.empty(len(sizes), np.int64)
    for items in best:
        offset[items] = np.cumsum([0, *(sizes[i] for i in items[:-1])])
    own = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"])
    return own.append_column("sequence_id", pa.array(_numbers(best, len(sizes)) + (shard << 32))).append_column("offset", pa.array(offset))


def pack(cut: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, shard_pieces: int = SHARD_PIECES, members: int = MEMBERS, births: int = BIRTHS, epochs: int = EPOCHS) -> DataFrame:
    """Pieces (PIECES) with sequence_id and offset. Each shard is within a few sequences of its lower bound."""
    shards = max(1, -(-cut.count() // shard_pieces))
    # rows that are equal in all columns fall into one shard and take its places in any order
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    own = f"{PIECES}, shard long"
    now = dealt.withColumn("bins", F.array().cast("array<long>")).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    for epoch in range(epochs):
        elites = now.groupBy("shard", "island").applyInArrow(on_table(_epoch, capacity, members, births, epoch), f"{own}, island int, bin long")
        now = elites.groupBy("shard").applyInArrow(on_table(_migrated, islands if epoch < epochs - 1 else 1), f"{own}, bins array<long>, island int")
    return now.groupBy("shard").applyInArrow(on_table(_placed), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every token of every row, once.

    Null or empty texts are a document of its end token alone; a null id is carried along; repeated rows are
    packed once each; no rows give no rows. Other columns are not read.
    """
    return pack(stored(pieces(docs, doc_id, text, capacity)), capacity)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents with their sequences; see pack_documents()."""
    return pack_documents(docs)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents() of all documents; see there for nulls, repeats and empty tables."""
    return pack_documents(table(spark, sf_dir, "documents"))
