"""Line dedup: fuzzy lines by MinHash.

Lines (trimmed, lower-cased; blank ones are left alone) are sets of shingles of five characters, a shorter line being
one shingle. In blocks of documents:

1. equal lines meet by 128 bits of hash in a range of the key space, which answers who holds a line first;
2. first holders sign their lines; band keys meet in ranges; the lines of a band join the unit of its least line, the
   leader, and the blocks learn the units of their lines;
3. the lines of units are fetched and verified by exact Jaccard similarity: each against the unit's leader, and what
   that leaves apart against all of the unit. A unit beyond UNIT_LINES is dealt into parts, each with the leader,
   and lines that stay apart from it visit the other parts;
4. the verified links go through distributed union-find, and of each component the first line (by document, then
   place) stays.

Bands are sharp (six minima), so that lines that share only common words hardly meet: their number grows with the
square of the corpus. Each minimum is in two bands; a pair at a similarity of 0.8 meets in one with probability 0.997,
at 0.85 with 0.9999.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .blocks import bounds, get_keys, get_numbers, opened, packed, put_keys, put_numbers, ranges_for
from .common import dropped, on_table, on_tables, stored, table, unused
from .components import Forest, components

SIMILARITY = 0.8
SHINGLE = 5
BANDS, ROWS = 24, 6
MINIMA = 72
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
UNIT_LINES = 1024
#: Lines times distinct shingles of a unit that are compared at once.
MATRIX = 1 << 22
#: A line's id is its block's number and its place among the block's distinct lines.
LINE_BITS = 26
BLANK = " \t\r\x0b\f"
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_IN_BAND = np.concatenate([_rng.permutation(MINIMA) for _ in range(BANDS * ROWS // MINIMA)]).reshape(BANDS, ROWS)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
PLACE = np.dtype([("has", "u1"), ("doc", "<i8"), ("row", "<u8"), ("pos", "<u4")])


def normal_lines(text: str) -> list[str]:
    """The lines of a text, each trimmed and lower-cased."""
    return [x.strip(BLANK) for x in text.lower().split("\n")]


def _padded(line: bytes) -> str:
    """A line's characters, one shingle at least; bytes that are no UTF-8 count as characters of their own."""
    return line.decode("utf-8", "surrogateescape").ljust(SHINGLE, "\0")


def _windows(text: str) -> np.ndarray:
    """The five characters from each place on, hashed to one number: 21 bits hold a character, so three and two of them."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two = c[:-1] | (c[1:] << np.uint64(21))
    three = two[:-3] | (c[2:-2] << np.uint64(42))
    w = three * _ODD
    w ^= w >> np.uint64(32)
    w += two[3:]
    w *= _MIX
    return w ^ (w >> np.uint64(29))


def shingles(line: bytes) -> np.ndarray:
    """The sorted set of a line's shingles."""
    return shingle_sets([line])[0]


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """The same of many lines."""
    padded = [_padded(x) for x in lines]
    w = _windows("".join(padded) + "\0" * SHINGLE)
    ends = np.cumsum([len(x) for x in padded])
    out = []
    for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
        own = w[a : b - SHINGLE + 1]
        own.sort()
        keep = np.empty(len(own), bool)
        keep[0] = True
        np.not_equal(own[1:], own[:-1], out=keep[1:])
        out.append(own[keep])
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def bands(lines: list[bytes], stretch: int = 1 << 16) -> np.ndarray:
    """(lines, BANDS) keys: lines that agree in ROWS minima of a band get the same key for it."""
    out = np.empty((len(lines), BANDS), np.uint64)
    first, held = 0, 0
    for i, line in enumerate(lines):
        held += len(line)
        if held >= stretch or i == len(lines) - 1:
            out[first : i + 1] = _bands([_padded(x) for x in lines[first : i + 1]])
            first, held = i + 1, 0
    return out


def _bands(lines: list[str]) -> np.ndarray:
    lengths = np.array([len(x) for x in lines])
    inside = np.ones(lengths.sum(), bool)
    ends = np.cumsum(lengths)
    for k in range(1, SHINGLE):
        inside[ends - k] = False  # windows that reach into the next line
    x = ((_windows("".join(lines) + "\0" * SHINGLE)[: len(inside)][inside] * _MIX) >> np.uint64(32)).astype(np.uint32)
    count = lengths - SHINGLE + 1
    begins = np.cumsum(count) - count
    low = np.empty((MINIMA, len(lines)), np.uint64)
    mixed = np.empty_like(x)
    for k in range(MINIMA):
        np.multiply(x, _A[k], out=mixed)  # an odd factor permutes the hashes
        low[k] = np.minimum.reduceat(mixed, begins)
    key = np.arange(BANDS, dtype=np.uint64)[:, None] + np.zeros((1, len(lines)), np.uint64)
    for r in range(ROWS):
        key = (key ^ low[_IN_BAND[:, r]]) * _MIX
        key ^= key >> np.uint64(31)
    return key.T


def jaccard_at_least(a: np.ndarray, b: np.ndarray, limit: float) -> bool:
    if min(len(a), len(b)) < limit * max(len(a), len(b)):
        return False
    both = common(a, b)
    return both >= limit * (len(a) + len(b) - both)


class Lines:
    """A block's lines: rows, places and distinct lines, these sorted by their hashes."""

    def __init__(self, number: int, rows: pa.Table, text_at: int) -> None:
        """rows: columns of the documents, the last one the id; text_at: which one holds the text."""
        self.number, self.rows, self.text_at = number, rows, text_at
        ids, texts = rows.column(rows.num_columns - 1).to_pylist(), rows.column(text_at).to_pylist()
        self.has = np.array([d is not None for d in ids], np.uint8)
        self.doc = np.array([d or 0 for d in ids], np.int64)
        self.hash = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], np.uint64)
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        known[""]  # blank lines are number 0
        each = [np.fromiter(map(known.__getitem__, normal_lines(t or "")), np.int64) for t in texts]
        count = np.array([len(x) for x in each], np.int64)
        line = np.concatenate([*each, np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(each)), count)
        pos = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
        some = line > 0
        self.row, self.pos, line = row[some], pos[some], line[some] - 1
        self.norm = list(known)[1:]
        del each, known, texts
        digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in self.norm]), "<u8").reshape(-1, 2)
        if len(digest) >> LINE_BITS:
            raise ValueError("a block has too many lines")
        order = np.lexsort((digest[:, 1], digest[:, 0]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.low, self.high = np.ascontiguousarray(digest[order, 0]), np.ascontiguousarray(digest[order, 1])
        self.norm = [self.norm[i] for i in order.tolist()]
        self.line = place[line]
        # rows in their order; rows equal in id and text take the same place in it
        by = np.lexsort((self.hash, self.doc, self.has))
        turn = np.concatenate([[0], np.cumsum((np.diff(self.has[by].astype(int)) != 0) | (np.diff(self.doc[by]) != 0) | (self.hash[by][1:] != self.hash[by][:-1]))]) if len(by) else by
        rank = np.empty(len(by), np.int64)
        rank[by] = turn
        self.at = (rank[self.row] << 32) | self.pos
        self.first = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.line, self.at)

    def places(self) -> np.ndarray:
        """PLACE of the first occurrence of each distinct line."""
        out = np.zeros(len(self.low), PLACE)
        one = np.flatnonzero(self.at == self.first[self.line])
        at, row = self.line[one], self.row[one]
        out["has"][at], out["doc"][at], out["row"][at], out["pos"][at] = self.has[row], self.doc[row], self.hash[row], self.pos[one]
        return out


def _each(packs: pa.Table, text_at: int) -> Iterator[Lines]:
    for number, pack in zip(packs["block"].to_pylist(), packs["pack"], strict=True):
        yield Lines(number, opened(pack.as_py()), text_at)


def _sent(block: int, cut: np.ndarray, **columns) -> pa.Table:
    """A row for each range that has keys: columns give (kind of packing, array)."""
    some = np.flatnonzero(cut[1:] > cut[:-1])
    made = {c: pa.array([put(x[cut[k] : cut[k + 1]]) for k in some], pa.binary()) for c, (put, x) in columns.items()}
    return pa.table({"part": pa.array(some, pa.int32()), "block": pa.array(np.full(len(some), block), pa.int64()), **made})


# 1. Who holds a line first.


def _held(ranges: int, text_at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lines in _each(pa.Table.from_batches([batch]), text_at):
            sent = _sent(lines.number, bounds(lines.low, ranges), low=(put_keys, lines.low), high=(bytes, lines.high), place=(bytes, lines.places()))
            yield from sent.to_batches()


def _owned(rows: pa.Table) -> pa.Table:
    """For each block, whether its place of a line is the first of all (a byte a line, in its order)."""
    low = [get_keys(x.as_py()) for x in rows["low"]]
    place = np.frombuffer(b"".join(rows["place"].to_pylist()), PLACE)
    keys = np.concatenate(low), np.frombuffer(b"".join(rows["high"].to_pylist()), "<u8")
    order = np.lexsort((place["pos"], place["row"], place["doc"], place["has"], keys[1], keys[0]))
    begins = np.ones(len(order), bool)
    begins[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
    own = np.empty(len(order), np.uint8)
    own[order] = place[order] == place[first]
    ends = np.cumsum([len(x) for x in low])
    return pa.table({"block": rows["block"], "part": rows["part"], "marks": pa.array([x.tobytes() for x in np.split(own, ends[:-1])], pa.binary())})


def _own(marks: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(marks.sort_by("part")["marks"].to_pylist()), np.uint8).astype(bool)


# 2. Bands and units.


def _signed(ranges: int, text_at: int, packs: pa.Table, marks: pa.Table) -> pa.Table:
    out = [pa.table({"part": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "lines": pa.array([], pa.binary())})]
    for lines in _each(packs, text_at):
        own = np.flatnonzero(_own(marks))
        if len(own):
            key = bands([lines.norm[i].encode("utf-8", "surrogatepass") for i in own.tolist()]).ravel()
            order = np.argsort(key, kind="stable")
            key, at = key[order], own[order // BANDS]
            out.append(_sent(lines.number, bounds(key, ranges), keys=(put_keys, key), lines=(put_numbers, at)))
    return pa.concat_tables(out)


def _united(rows: pa.Table) -> pa.Table:
    """For each block, the units that its lines are in, a unit being the id of its leader."""
    each = [get_keys(x.as_py()) for x in rows["keys"]]
    key = np.concatenate(each)
    block = np.repeat(rows["block"].to_numpy(), [len(x) for x in each])
    line = (block << LINE_BITS) | np.concatenate([get_numbers(x.as_py()) for x in rows["lines"]])
    order = np.lexsort((line, key))
    key, line = key[order], line[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([begins, [len(key)]]))
    some = np.repeat(size > 1, size)
    line, unit = line[some], np.repeat(line[begins], size)[some]
    order = np.lexsort((unit, line))
    line, unit = line[order], unit[order]
    once = np.ones(len(line), bool)
    once[1:] = (line[1:] != line[:-1]) | (unit[1:] != unit[:-1])
    line, unit = line[once], unit[once]
    number, at = np.unique(line >> LINE_BITS, return_index=True)
    cuts = np.concatenate([at, [len(line)]])
    packed_by = lambda put, x: pa.array([put(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    return pa.table({"block": pa.array(number, pa.int64()), "units": packed_by(np.ndarray.tobytes, unit), "lines": packed_by(put_numbers, line & ((1 << LINE_BITS) - 1))})


# 3. Fetching and verifying.

FETCHED = "unit long, line long, has boolean, doc long, row long, pos long, norm binary"
_KINDS = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _fetched(text_at: int, packs: pa.Table, wanted: pa.Table) -> pa.Table:
    """The lines of units; one that several ranges found in a unit comes once."""
    names = [f.split()[0] for f in FETCHED.split(", ")]
    out = [pa.table([pa.array([], t) for t in _KINDS], names=names)]
    if wanted.num_rows:
        unit = np.frombuffer(b"".join(wanted["units"].to_pylist()), "<i8")
        line = np.concatenate([get_numbers(x.as_py()) for x in wanted["lines"]])
        unit, line = np.unique(np.stack([unit, line], 1), axis=0).T
        for lines in _each(packs, text_at):
            place = lines.places()[line]
            texts = [lines.norm[i].encode("utf-8", "surrogatepass") for i in line.tolist()]
            columns = (unit, (lines.number << LINE_BITS) | line, place["has"] > 0, place["doc"], np.ascontiguousarray(place["row"]).view(np.int64), place["pos"].astype(np.int64), texts)
            out.append(pa.table([pa.array(x, t) for x, t in zip(columns, _KINDS, strict=True)], names=names))
    return pa.concat_tables(out)


class _Unit:
    """Lines of a unit's part, the leader first; links go into a forest that units of one task share."""

    def __init__(self, line: list[int], sets: list[np.ndarray], limit: float, forest: Forest) -> None:
        self.line, self.sets, self.limit, self.forest = line, sets, limit, forest
        self.every = None

    def visit(self, k: int) -> None:
        """Link line k with every line that is similar to it."""
        if len(self.line) <= 4:
            for j in range(len(self.line)):
                if j != k and jaccard_at_least(self.sets[k], self.sets[j], self.limit):
                    self.forest.union(self.line[k], self.line[j])
            return
        if self.every is None:
            self.size = np.array([len(s) for s in self.sets])
            self.start = np.cumsum(self.size) - self.size
            self.every = np.concatenate(self.sets)
        own = self.sets[k]
        at = own.searchsorted(self.every)
        at[at == len(own)] = 0
        both = np.add.reduceat(own[at] == self.every, self.start, dtype=np.int64)
        for j in np.flatnonzero(both >= self.limit * (self.size + len(own) - both)).tolist():
            self.forest.union(self.line[k], self.line[j])

    def joined(self, k: int) -> bool:
        return self.forest.find(self.line[k]) == self.forest.find(self.line[0])

    def every_pair(self) -> bool:
        """Link all similar lines by one product of their incidence matrix; False where that would be too large."""
        size = np.array([len(s) for s in self.sets])
        every = np.concatenate(self.sets)
        order = np.argsort(every)
        ranked = every[order]
        number = np.empty(len(every), np.int64)
        number[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
        width = int(number[order[-1]]) + 1
        if width * len(size) > MATRIX:
            return False
        held = np.zeros((len(size), width), np.float32)
        held[np.repeat(np.arange(len(size)), size), number] = 1
        both = held @ held.T  # whole numbers, far below what a float holds exactly
        for k, j in zip(*np.nonzero(np.triu(both >= self.limit * (size[:, None] + size[None, :] - both), 1)), strict=True):
            self.forest.union(self.line[k], self.line[j])
        return True

    def apart(self) -> list[int]:
        """Visits the leader, then each line that is not connected with it at its turn; gives those that end apart."""
        if all(map(self.joined, range(1, len(self.line)))):
            return []
        if len(self.line) > 2 and self.every_pair():
            return [x for k, x in enumerate(self.line) if not self.joined(k)]
        for k in range(len(self.line) - (len(self.line) == 2)):
            if k == 0 or not self.joined(k):
                self.visit(k)
        return [x for k, x in enumerate(self.line) if not self.joined(k)]


LINKS = "a long, b long, apart boolean, unit long"


def _verified(limit: float, visiting: bool, rows: pa.Table) -> pa.Table:
    """Links (a, b) within each (unit, part) of the group; of units of many parts also the lines that stay apart (a, null).

    visiting: rows marked lead are visitors, compared with all lines of the part, and nothing else is.
    """
    parts: dict[tuple, list[int]] = {}
    line, lead = rows["line"].to_pylist(), rows["lead"].to_pylist()
    for i, key in enumerate(zip(rows["unit"].to_pylist(), rows["o"].to_pylist(), strict=True)):
        parts.setdefault(key, []).append(i)
    texts, several = rows["norm"], rows["parts"].to_numpy() > 1
    once = {x: i for i, x in enumerate(line)}
    sets = dict(zip(once, shingle_sets(texts.take(pa.array(once.values(), pa.int64())).to_pylist()), strict=True))
    forest, left = Forest(), []
    for (unit, _), at in parts.items():
        at.sort(key=lambda i: (not lead[i], line[i]))
        found = _Unit([line[i] for i in at], [sets[line[i]] for i in at], limit, forest)
        if visiting:
            for k in range(sum(lead[i] for i in at)):
                found.visit(k)
        else:
            apart = found.apart()
            if several[at[0]]:
                left += [(x, None, True, unit) for x in apart]
    out = left + [(a, b, False, None) for a, b in forest.stars()]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[f.split()[0] for f in LINKS.split(", ")])


def _links(fetched: DataFrame, similarity: float, unit_lines: int) -> DataFrame:
    """(a, b) of verified lines of all units."""
    large = stored(fetched.groupBy("unit").agg(F.ceil(F.count("*") / unit_lines).alias("parts")).where("parts > 1"))
    rows = fetched.select("unit", "line", "norm", (F.col("unit") == F.col("line")).alias("lead"))
    rows = rows.withColumn("parts", F.lit(1).cast("long")) if large.isEmpty() else rows.join(large, "unit", "left").na.fill(1, ["parts"])
    own = F.pmod(F.xxhash64("line"), F.col("parts"))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    n = fetched.count()

    def verify(dealt: DataFrame, visiting: bool) -> DataFrame:
        groups = max(1, -(-n // (2 * unit_lines)))
        keyed = dealt.withColumn("g", F.pmod(F.xxhash64("unit", "o"), F.lit(groups)))
        return stored(keyed.groupBy("g").applyInArrow(on_table(_verified, similarity, visiting), LINKS))

    # the leader goes to every part
    first = verify(rows.withColumn("o", F.explode(F.when(F.col("lead"), every).otherwise(F.array(own)))), False)
    links = first.where("not apart").select("a", "b")
    left = first.where("apart").select("unit", F.col("a").alias("line"), F.lit(True).alias("_left"))
    if left.isEmpty():
        return links
    many = rows.where("parts > 1").join(left, ["unit", "line"], "left").drop("lead")
    visitors = many.where("_left").withColumn("o", F.explode(every)).where(F.col("o") != own).withColumn("lead", F.lit(True))
    hosts = many.join(left.select("unit").distinct(), "unit", "left_semi").withColumn("o", own).withColumn("lead", F.lit(False))
    return links.union(verify(visitors.unionByName(hosts), True).where("not apart").select("a", "b"))


# 4. What stays.


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to take out, gathered by block."""
    for batch in batches:
        line = np.sort(batch.column(0).to_numpy())
        number, at = np.unique(line >> LINE_BITS, return_index=True)
        marks = [put_numbers(x & ((1 << LINE_BITS) - 1)) for x in np.split(line, at[1:])] if len(line) else []
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array([-1] * len(number), pa.int32()), pa.array(marks, pa.binary())], ["block", "part", "marks"])


def _rebuilt(text_at: int, schema: pa.Schema | None, packs: pa.Table, marks: pa.Table) -> pa.Table:
    out = []
    gone = pc.equal(marks["part"], -1)
    for lines in _each(packs, text_at):
        keep = _own(marks.filter(pc.invert(gone))).copy()
        for x in marks.filter(gone)["marks"]:
            keep[get_numbers(x.as_py())] = False
        stays = keep[lines.line] & (lines.at == lines.first[lines.line])
        total = np.bincount(lines.row, minlength=lines.rows.num_rows)
        removed = np.bincount(lines.row[~stays], minlength=lines.rows.num_rows)
        texts = lines.rows.column(text_at).to_pylist()
        leave: dict[int, set[int]] = {}
        for i, k in zip(lines.row[~stays].tolist(), lines.pos[~stays].tolist(), strict=True):
            leave.setdefault(i, set()).add(k)
        for i, ks in leave.items():
            texts[i] = "\n".join([x for k, x in enumerate(texts[i].split("\n")) if k not in ks])
        rows = lines.rows.set_column(text_at, lines.rows.schema.field(text_at), pa.array(texts, lines.rows.schema.field(text_at).type))
        rows = rows.remove_column(rows.num_columns - 1)
        out.append(rows.append_column("_lines", pa.array(total, pa.int32())).append_column("_removed", pa.array(removed, pa.int32())))
    return pa.concat_tables(out) if out else pa.table([pa.array([], f.type) for f in schema], schema=schema)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, unit_lines: int = UNIT_LINES, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs with the text less the lines that another line stands for, and columns _lines and _removed (counts).

    Null and empty texts have no lines and stay as they are; so do blank lines. Rows equal in id and text are
    one document, and keep the same lines; a null id sorts first; lines of any length are compared whole; no
    rows give no rows. All columns of docs are kept; none may be called _lines or _removed.
    """
    key = unused("_id", docs)
    text_at = docs.columns.index(text)
    packs = packed(docs.select("*", F.col(doc_id).cast("long").alias(key)), block_bytes)
    ranges = ranges_for(packs, range_bytes)
    whole = packs.select("block", "pack")

    sent = whole.mapInArrow(partial(_held, ranges, text_at), "part int, block long, low binary, high binary, place binary")
    marks = stored(sent.groupBy("part").applyInArrow(on_table(_owned), "block long, part int, marks binary"))

    signed = whole.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(on_tables(_signed, ranges, text_at), "part int, block long, keys binary, lines binary")
    units = stored(signed.groupBy("part").applyInArrow(on_table(_united), "block long, units binary, lines binary"))
    fetched = stored(whole.groupBy("block").cogroup(units.groupBy("block")).applyInArrow(on_tables(_fetched, text_at), FETCHED))
    dropped(units)

    classes = components(_links(fetched, similarity, unit_lines), "a", "b")
    place = F.struct("has", "doc", F.col("row").alias("row"), "pos")
    at = fetched.select("line", place.alias("at")).distinct()
    roots = classes.select(F.col("root").alias("v"), "root").distinct()
    of = at.join(classes.union(roots), F.col("line") == F.col("v"))
    first = of.groupBy("root").agg(F.min("at").alias("first"))
    gone = stored(of.join(first, "root").where(F.col("at") != F.col("first")).select("line").distinct().mapInArrow(_gone, "block long, part int, marks binary"))

    out = StructType([*docs.schema.fields, StructField("_lines", IntegerType()), StructField("_removed", IntegerType())])
    none = docs.sparkSession.createDataFrame([], out).toArrow().schema
    decided = marks.unionByName(gone)
    return whole.groupBy("block").cogroup(decided.groupBy("block")).applyInArrow(on_tables(_rebuilt, text_at, none), out)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with its repeated lines taken out and n_chars counted anew."""
    out = dedup(docs).drop("_lines", "_removed")
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup() over all documents, with its counts; see there for nulls, repeats and empty tables."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_removed").cast("long").alias("n_removed"), "text")
