"""Byte-level BPE encoding and decoding.

Every distinct word (match of the pattern), however long, is encoded once by Spark higher-order functions: its bytes
are an array of pieces (ids), and a fold merges, step by step, all places of the neighbouring pair of lowest rank,
looked up in a literal rank map, until no pair has a rank. Decoding folds the ids' binary pieces, from a literal array,
into one value.

Words travel, texts hardly: documents lie in blocks of bounded bytes; a block sends its distinct words, by range of
their hash; a range's words are told apart, encoded and decoded as rows of their own, and go back to the blocks that
asked, in the blocks' own order. There a document's ids and decoded bytes are those of its words, put together.

Words that are frequent in a bounded sample are coded first, by the same folds, and told to every block; so a block asks
only for the rest. Whichever words these are, the result is the same.
"""

from __future__ import annotations

import base64
import ctypes
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache, lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import MAX_RANGES, blocks, ipc, opened, put_numbers
from .common import on_table, on_tables, table

BLOCK_BYTES = 4 << 20
#: Text of a range of words, in blocks.
RANGE_BLOCKS = 8
#: Bytes of the sample (of less than SHARE of all), and how many words of it, and how long ones, are told to every block.
SAMPLE_BYTES, SHARE, COMMON, COMMON_BYTES = 32 << 20, 1 / 8, 1 << 17, 64
NEVER = 1 << 17
#: Of compression: blocks are a tenth smaller than at the usual level.
LEVEL = 6
#: Slots of displacements in the rank map (a prime).
SLOTS = 65_521


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word by a heap of pairs, lowest rank first, leftmost on ties; to find the map's exceptions with."""
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or len(piece[i]) + len(piece[j]) != size:
            continue
        piece[i] += piece[j]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (r, a, len(piece[a]) + len(piece[b])))
    return [ranks[p] for p, on in zip(piece, alive, strict=True) if on]


def pairs_of(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id): the id of the two joined, for every way to cut a piece into two."""
    cuts = ((t[:i], t[i:], r) for t, r in ranks.items() for i in range(1, len(t)))
    return {(ranks[a], ranks[b]): r for a, b, r in cuts if a in ranks and b in ranks}


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@lru_cache(maxsize=2)
def rank_map(path: str) -> tuple[str, str, str, str, str]:
    """JSON arrays of the literals: a displacement a slot, then keys and ids by place, ids of the bytes, and pieces.

    The key of a pair is left * 65,536 + right; its place is (key XOR the displacement of slot key % SLOTS) % places,
    with displacements found so that no two keys share a place.
    """
    ranks = ranks_of(path)
    if odd := [t for t, r in ranks.items() if merged(t, ranks) != [r]]:
        raise ValueError(f"{len(odd)} pieces are not what their bytes merge to")
    pairs = pairs_of(ranks)
    places = _prime(2 * len(pairs) + 1)
    slots: dict[int, list[tuple[int, int]]] = {}
    for (a, b), r in pairs.items():
        slots.setdefault(((a << 16) | b) % SLOTS, []).append(((a << 16) | b, r))
    moved, keys, ids = [0] * SLOTS, [-1] * places, [0] * places
    rng = np.random.default_rng(1)
    for slot, members in sorted(slots.items(), key=lambda x: -len(x[1])):
        while True:
            at = [(key ^ moved[slot]) % places for key, _ in members]
            if len(set(at)) == len(at) and all(keys[p] < 0 for p in at):
                break
            moved[slot] = int(rng.integers(0, 1 << 40))
        for p, (key, r) in zip(at, members, strict=True):
            keys[p], ids[p] = key, r
    pieces = [b""] * (1 + max(ranks.values()))
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return (*map(json.dumps, (moved, keys, ids, [ranks[bytes([b])] for b in range(256)])), json.dumps([base64.b64encode(p).decode() for p in pieces]))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _literal(text: str, kind: str) -> Column:
    return F.from_json(F.lit(text), f"array<{kind}>")


def encoded(word: Column, path: str) -> Column:
    """array<int>: the ids of a word given as an array<int> of its bytes.

    The fold's state is one number a piece: the id that it and the next piece would merge to (NEVER if none), shifted,
    and its own id. So the least number tells the lowest rank, and only pairs beside a merge are looked up again.
    """
    moved, keys, ids, single, _ = rank_map(path)
    places = keys.count(",") + 1

    def fold(tables: Column) -> Column:
        def state(left: Column, right: Column) -> Column:
            key = left * 65_536 + right
            place = (key.bitwiseXOR(F.get(tables["moved"], (key % SLOTS).cast("int"))) % places).cast("int")
            rank = _let(place, lambda at: F.when(F.get(tables["keys"], at) == key, F.get(tables["ids"], at)))
            return F.coalesce(rank, F.lit(NEVER)) * 65_536 + left

        def own(q: Column) -> Column:
            return q.bitwiseAND(F.lit(65_535))

        def every_other(on: Column) -> Column:
            """Of marked places in a row, which overlap, the first, third and so on."""
            # the last unmarked place before each, by doubling the stretch that is looked at
            last = F.transform(on, lambda x, i: F.when(x, F.lit(-1)).otherwise(i))
            reach = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(on))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
            found = F.aggregate(reach, last, lambda m, d: F.transform(m, lambda x, i: F.greatest(x, F.coalesce(F.get(m, i - d), F.lit(-1)))))
            return _let(found, lambda m: F.transform(on, lambda x, i: x & ((i - F.get(m, i)) % 2 == 1)))

        def merge(q: Column, best: Column) -> Column:
            def at(begins: Column) -> Column:
                def beside(i: Column) -> Column:
                    """The id that stands at place i when all merges are done; null past the end."""
                    return F.when(F.get(begins, i), best).otherwise(own(F.get(q, i)))

                def renewed(x: Column, i: Column) -> Column:
                    merged_with_last = F.when(F.coalesce(F.get(begins, i - 1), F.lit(False)), F.lit(-1).cast("bigint"))
                    return F.when(F.get(begins, i), state(best, beside(i + 2))).otherwise(F.coalesce(merged_with_last, F.when(F.get(begins, i + 1), state(own(x), best)).otherwise(x)))

                return F.filter(F.transform(q, renewed), lambda x: x >= 0)

            marked = F.transform(q, lambda x: F.shiftright(x, 16) == best)
            apart = lambda on: F.when(F.size(F.filter(on, lambda x: x)) <= 1, on).otherwise(every_other(on))
            return _let(_let(marked, apart), at)

        def step(q: Column, _: Column) -> Column:
            return _let(F.shiftright(F.array_min(q), 16), lambda best: F.when(best == NEVER, q).otherwise(merge(q, best)))

        def start(first: Column) -> Column:
            return F.transform(first, lambda x, i: state(x, F.get(first, i + 1)))

        first = F.transform(word, lambda b: F.get(tables["single"], b))
        done = F.aggregate(F.slice(word, 2, F.size(word)), _let(first, start), step)
        return F.transform(done, lambda q: own(q).cast("int"))

    tables = F.struct(_literal(moved, "bigint").alias("moved"), _literal(keys, "bigint").alias("keys"), _literal(ids, "bigint").alias("ids"), _literal(single, "bigint").alias("single"))
    return _let(tables, fold)


def decoded(ids: Column, path: str) -> Column:
    """binary: the pieces of array<int> ids, concatenated."""
    return _let(_literal(rank_map(path)[4], "binary"), lambda pieces: F.aggregate(ids, F.lit(b""), lambda done, i: F.concat(done, F.get(pieces, i))))


def _text(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def _matches(text: str) -> list[bytes]:
    return [w.encode("utf-8", "surrogateescape") for w in pattern().findall(text)]


def _spaced(data: bytes) -> list[bytes] | None:
    """The matches in a space and a chunk; None where the chunk isn't matched on its own.

    The pattern joins a space to what follows and splits nothing else by it, but for white space beside it. Letters,
    and letters before one mark, need no search.
    """
    chunk = _text(data)
    if chunk.isalpha():
        return [b" " + data]
    if not chunk or chunk[0].isspace() or chunk[-1].isspace():
        return None
    if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
        return [b" " + data[:-1], data[-1:]]
    return _matches(" " + chunk)


def _part_of(words: pa.Array, ranges: int) -> np.ndarray:
    key = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
    return (((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _pieces(data: pa.Array) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each distinct piece, the texts' runs of pieces in a row, and each text's number of them.

    A text is a run of pieces: what stands before its first space, and each chunk after one with that space; a text
    with other white space beside a space is one piece. A piece is a run of words.
    """
    parts = pc.split_pattern(data, b" ")
    starts, count = parts.offsets.to_numpy()[:-1].astype(np.int64), pc.list_value_length(parts).to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    run = coded.indices.to_numpy().astype(np.int64) if len(coded) else np.zeros(0, np.int64)
    pieces = [_spaced(c) for c in coded.dictionary.to_pylist()]
    odd = np.array([p is None for p in pieces], bool)
    whole = (count > 1) & (np.add.reduceat(odd[run], starts) > 0) if len(run) else np.zeros(len(count), bool)
    # first pieces and whole texts have numbers behind those of the chunks
    bare: dict[bytes, int] = {}
    texts, heads = data.to_pylist(), coded.dictionary.take(pa.array(run[starts])).to_pylist() if len(run) else []
    first = [bare.setdefault(t if w else h, len(bare)) for t, h, w in zip(texts, heads, whole.tolist(), strict=True)]
    run[starts] = np.array(first, np.int64) + len(pieces)
    keep = ~np.repeat(whole, count)
    keep[starts] = True
    pieces = [p or [] for p in pieces] + [_matches(_text(t)) for t in bare]
    return pieces, run[keep], np.where(whole, 1, count)


def _tokenized(ranges: int, common: bytes, rows: pa.Table) -> bytes:
    """A block of (doc_id, data) as its distinct words that aren't common, by range and in order there, and numbers.

    A word's number is its place among these, or how many they are and its place among the common ones.
    """
    pieces, run, lengths = _pieces(rows["data"].combine_chunks().fill_null(b""))
    words = pa.array([w for p in pieces for w in p], pa.binary()).dictionary_encode()
    told = pc.index_in(words.dictionary, value_set=opened(common)["word"].combine_chunks())
    asked = np.flatnonzero(told.is_null().to_numpy(zero_copy_only=False))
    distinct = words.dictionary.take(pa.array(asked))
    order = pc.sort_indices(distinct).to_numpy()
    part = _part_of(distinct, ranges)
    order = order[np.argsort(part[order], kind="stable")]  # by range, in order there: neighbours are alike and pack well
    place = len(asked) + told.fill_null(0).to_numpy().astype(np.int64)
    place[asked[order]] = np.arange(len(order))
    # frequent pieces get small numbers, whose upper bytes pack away; equally frequent ones follow their words
    sizes = np.array([len(p) for p in pieces], np.int64)
    words_of = place[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    begins = np.cumsum(sizes) - sizes
    leads = np.where(sizes > 0, words_of[np.minimum(begins, max(0, len(words_of) - 1))], -1) if len(words_of) else np.full(len(sizes), -1)
    often = np.lexsort((leads, -np.bincount(run, minlength=len(pieces))))
    rank = np.empty(len(often), np.int64)
    rank[often] = np.arange(len(often))
    inside = np.arange(len(words_of)) - np.repeat(begins, sizes)
    at = np.cumsum(sizes[often]) - sizes[often]
    moved = np.empty_like(words_of)
    moved[np.repeat(at[rank], sizes) + inside] = words_of
    step = np.diff(moved, prepend=0)
    row = {
        "doc_id": rows["doc_id"].combine_chunks(),
        "lengths": pa.array(lengths),
    }
    numbers = {
        "run": rank[run],
        "sizes": sizes[often],
        "words_of": (step << 1) ^ (step >> 63),  # steps either way as numbers from 0
        "cut": np.searchsorted(part[order], np.arange(ranges + 1)),
    }
    return b"".join(_framed(x) for x in (_packed(pa.table(row)), _packed(pa.table({"word": distinct.take(pa.array(order))})), *map(_squeezed, numbers.values())))


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 1 << 32 as their lowest bytes, then their next, and so on: bytes of a kind pack best together."""
    width = len(put_numbers(x[:0] if not len(x) else np.array([x.max()]))) - 1
    return bytes([max(0, width)]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : max(0, width)].T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    if not data[0]:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.view("<i8").ravel()


def _packed(rows: pa.Table) -> bytes:
    return ipc(rows, LEVEL)


def _framed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + data


def _unframed(data: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return parts


def _squeezed(x: np.ndarray) -> bytes:
    return _packed(pa.table({"x": [_planes(x.astype(np.int64))]}, schema=pa.schema([("x", pa.binary())])))


class Block:
    """What _tokenized() packed."""

    def __init__(self, pack: bytes) -> None:
        parts = [opened(x) for x in _unframed(pack)]
        self.doc_id, self.lengths, self.word = parts[0]["doc_id"], parts[0]["lengths"].to_numpy(), parts[1]["word"].combine_chunks()
        self.run, self.sizes, steps, self.cut = (_numbers(p["x"][0].as_py()) for p in parts[2:])
        self.words_of = np.cumsum((steps >> 1) ^ -(steps & 1))


def _joined(values: pa.Array, at: np.ndarray, sizes: np.ndarray, between: bytes) -> pa.Array:
    """Runs of values, by place and so many each, joined: binary with 64-bit offsets."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values.take(pa.array(at))), pa.scalar(between, values.type))


def _sent(packs: pa.Table) -> pa.Table:
    """The block's words, a row for each range."""
    parts, blocks, words = [], [], []
    for number, pack in zip(packs["block"].to_pylist(), packs["pack"], strict=True):
        block = Block(pack.as_py())
        for k in np.flatnonzero(block.cut[1:] > block.cut[:-1]).tolist():
            parts.append(k)
            blocks.append(number)
            words.append(_packed(pa.table({"word": block.word.slice(block.cut[k], block.cut[k + 1] - block.cut[k])})))
    return pa.table({"part": pa.array(parts, pa.int32()), "block": pa.array(blocks, pa.int64()), "words": pa.array(words, pa.binary())})


def _known(rows: pa.Table) -> tuple[list[pa.ChunkedArray], pa.Array]:
    """The words of each row, and the distinct ones in order."""
    each = [opened(x.as_py())["word"] for x in rows["words"]]
    every = pc.unique(pa.chunked_array([c for x in each for c in x.chunks], pa.binary()))
    return each, every.take(pc.sort_indices(every))


def _distinct(rows: pa.Table) -> pa.Table:
    """A row for each distinct word of the range: its place among them and its bytes."""
    words = _known(rows)[1]
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False))])
    plain = np.frombuffer(b"".join(words.to_pylist()), np.uint8).astype(np.int32)
    return pa.table({"part": pa.array(np.full(len(words), rows["part"][0].as_py()), pa.int32()), "k": pa.array(np.arange(len(words)), pa.int32()), "word": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(plain))})


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coded words, compressed together by range."""
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        for part in pc.unique(batch.column("part")).to_pylist():
            own = whole.filter(pc.equal(whole["part"], part)).select(["k", "ids", "decoded"])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(own)], pa.binary())], ["part", "coded"])


def _replied(rows: pa.Table, coded: pa.Table) -> pa.Table:
    """For each block that asked, its words' decoded bytes, numbers of ids and ids, in its own order."""
    each, words = _known(rows)
    known = pa.concat_tables([opened(x.as_py()) for x in coded["coded"]]).sort_by("k").select(["ids", "decoded"]).combine_chunks()
    replies = []
    for x in each:
        own = known.take(pc.index_in(x, value_set=words).combine_chunks())
        ids = own["ids"].combine_chunks()
        # what was decoded goes back where it isn't the word that was asked for; null says that it is
        back = pc.if_else(pc.equal(own["decoded"], x), pa.scalar(None, pa.binary()), own["decoded"])
        size = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        replies.append(_framed(_packed(pa.table({"decoded": back}))) + _framed(_squeezed(size)) + _framed(_squeezed(ids.flatten().to_numpy())))
    return pa.table({"part": rows["part"].combine_chunks(), "block": rows["block"].combine_chunks(), "reply": pa.array(replies, pa.binary())})


@cache
def _libc():
    return ctypes.CDLL(None)


def _lean(f, *given):
    """f(*given); what was freed on the way goes back to the system, as idle Python workers keep what they hold."""
    out = f(*given)
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of some texts that are short enough to be common, and how often they occur."""
    for batch in batches:
        pieces, run, _ = _pieces(batch.column("data").fill_null(b""))
        words = pa.array([w for p in pieces for w in p], pa.binary()).dictionary_encode()
        often = np.repeat(np.bincount(run, minlength=len(pieces)), [len(p) for p in pieces])
        n = np.bincount(words.indices.to_numpy(), often, len(words.dictionary)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        counted = pa.RecordBatch.from_arrays([words.dictionary, pa.array(n)], ["word", "n"])
        yield counted.filter(pc.less_equal(pc.binary_length(words.dictionary), COMMON_BYTES))


def _common(rows: DataFrame, total: int, path: str) -> bytes:
    """(word, ids, decoded) of the words that are most frequent in a sample, coded by the folds.

    Only how much blocks ask for depends on the sample.
    """
    if not total:
        return _packed(pa.table({"word": pa.array([], pa.binary()), "ids": pa.array([], pa.list_(pa.int32())), "decoded": pa.array([], pa.binary())}))
    some = rows.where(F.rand(1) < min(SHARE, SAMPLE_BYTES / total)).select("data")
    counted = some.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(COMMON).select("word").repartition(16)
    plain = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.conv(F.hex(F.substring("word", i, F.lit(1))), 16, 10).cast("int"))
    ids = often.select("word", encoded(plain, path).alias("ids"))
    told = ids.select("word", "ids", decoded(F.col("ids"), path).alias("decoded")).toArrow().sort_by("word")
    return _packed(told.cast(pa.schema([("word", pa.binary()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])))


CODED = "doc_id long, n_tokens long, ids binary, decoded binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _assembled(digest: bool, common: bytes, packs: pa.Table, replies: pa.Table) -> pa.Table:
    """Each document's ids and bytes: those of its pieces, which are those of their words, asked for or common."""
    names = [f.split()[0] for f in (DIGEST if digest else CODED).split(", ")]
    kinds = (pa.int64(), pa.int64(), *((pa.string(),) * 2 if digest else (pa.binary(),) * 2))
    out = [pa.table([pa.array([], t) for t in kinds], names=names)]
    replies, common = replies.sort_by("part"), opened(common).combine_chunks()
    for pack in packs["pack"]:  # one
        block = Block(pack.as_py())
        told = [_unframed(x.as_py()) for x in replies["reply"]]
        size, ids = (np.concatenate([np.zeros(0, np.int64), *(_numbers(opened(t[k])["x"][0].as_py()) for t in told)]) for k in (1, 2))
        size, ids = (np.concatenate([own, f(common["ids"]).to_numpy()]) for own, f in ((size, pc.list_value_length), (ids, pc.list_flatten)))
        numbers = pa.array(ids).cast(pa.string()).cast(pa.large_binary())
        spelled = _joined(numbers, np.arange(len(numbers)), size, b" ")
        back = pa.chunked_array([c for t in told for c in opened(t[0])["decoded"].chunks], pa.binary()).combine_chunks()
        back = pa.concat_arrays([pc.coalesce(back, block.word), *common["decoded"].chunks]).cast(pa.large_binary())
        tokens = np.concatenate([[0], np.cumsum(size[block.words_of])])
        per_piece = np.concatenate([[0], np.cumsum(block.sizes)])
        tokens = (tokens[per_piece[1:]] - tokens[per_piece[:-1]])[block.run]
        n = np.add.reduceat(tokens, np.cumsum(block.lengths) - block.lengths)
        texts, whole = ((_joined(_joined(x, block.words_of, block.sizes, gap), block.run, block.lengths, gap)) for x, gap in ((spelled, b" "), (back, b"")))
        both = ([hashlib.sha256(x).hexdigest() for x in y.to_pylist()] for y in (texts, whole)) if digest else (texts.cast(pa.binary()), whole.cast(pa.binary()))
        out.append(pa.table([block.doc_id.cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, t) if digest else x for x, t in zip(both, kinds[2:], strict=True))], names=names))
    return pa.concat_tables(out)


def code(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: CODED (ids as decimal text with single spaces, and the decoded bytes) or DIGEST.

    Null texts are empty and have no ids; ids may be null or repeat; a text or word of any length is encoded
    whole; no rows give no rows. Other columns are not read. docs must give a partition's rows in one order however
    often it is computed, as a table does; write others first.
    """
    path = str(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = int(min(MAX_RANGES, max(1, -(-total // (RANGE_BLOCKS * block_bytes)))))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("data"))
    common = _common(rows, total, path)
    # formed in passing, so that one exchange of the blocks serves both passes
    packs = blocks(rows, block_bytes, partial(_lean, _tokenized, ranges, common)).select("block", "pack")
    sent = packs.groupBy("block").applyInArrow(on_table(_lean, _sent), "part int, block long, words binary")
    words = sent.groupBy("part").applyInArrow(on_table(_lean, _distinct), "part int, k int, word array<int>")
    ids = words.select("part", "k", encoded(F.col("word"), path).alias("ids"))
    coded = ids.select("part", "k", "ids", decoded(F.col("ids"), path).alias("decoded")).mapInArrow(_gathered, "part int, coded binary")
    replied = sent.groupBy("part").cogroup(coded.groupBy("part")).applyInArrow(on_tables(_lean, _replied), "part int, block long, reply binary")
    return packs.groupBy("block").cogroup(replied.groupBy("block")).applyInArrow(on_tables(_lean, _assembled, digest, common), DIGEST if digest else CODED)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code() over all documents, as digests; see there for nulls, repeats and empty tables."""
    return code(table(spark, sf_dir, "documents"), digest=True)
