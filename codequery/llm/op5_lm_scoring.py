"""Language-model scoring by a weighted backoff automaton of order three.

Model: trigrams over lower-cased words with Dirichlet priors on the next shorter history,
    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),
    p(w | b) = (c(b w) + MU[0] p(w)) / (c(b) + MU[0]),
    p(w | a b) = (c(a b w) + MU[1] p(w | b)) / (c(a b) + MU[1]).
As an automaton: the empty history, every word and every seen pair of words is a state. A state has an arc for each
word seen after it, which weighs log10 of the probability above and leads to the longest history that is a state,
and a failure arc, which weighs log10 of the share left to the prior and leads to the next shorter history. Texts are
walked from left to right, many at a time, each with its state and its sum; a long text is walked in stretches, each
of which first reads two words without weight, and so stands in the state in which the stretch before it ends.

Counts are exact over all training documents and belong to no one machine: documents are cut into words once, and kept
as blocks of word numbers; each block sends the counts of its n-grams, packed by key range; the range's group returns
totals in the block's own order; so each block gets just the part of the automaton that its texts can reach. Words are told apart by 128 bits of hash, longer n-grams by 64:
two of those with equal hashes would share a count in the score (not in the other columns).
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import bounds, get_keys, get_numbers, ipc, opened, packed, put_keys, put_numbers, ranges_for
from .common import on_table, on_tables, stored, table

FOLDS, HELD = 10, 0
ADD = 0.1
MU = (200.0, 4.0)
BLOCK_BYTES = 6 << 20
RANGE_BYTES = 6 << 20
STRETCH = 256
END, START = b" ", b"  "


def tokens(data: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, then the end."""
    return [*data.lower().split(), END]


def remainder(doc_id: int | None, n: int = FOLDS) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key for an ordered pair of keys."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Automaton:
    """States, arcs and failure arcs over words 0 .. len(low) - 1 and pairs 0 .. len(pairs) - 1.

    States: 0 is the empty history, 1 + w a word, 1 + len(low) + p a pair. An arc's key is that of the n-gram which
    state and word make. low: keys of words; words, history: totals of each as a token and as a history; pairs: sorted
    keys with the words of each and its total; triples: sorted keys with the pairs that begin and end each and its total.
    """

    def __init__(self, n: int, v: int, low, words, history, pairs, triples, mu=MU) -> None:
        key, first, second, seen = pairs
        triple, begin, end, thrice = triples
        self.size, self.low = len(low), low
        self.state_key = np.concatenate([np.zeros(1, np.uint64), low, key])
        p1 = (words + ADD) / (n + ADD * (v + 1))
        p2 = (seen + mu[0] * p1[second]) / (history[first] + mu[0])
        p3 = (thrice + mu[1] * p2[end]) / (seen[begin] + mu[1])
        of_pair = 1 + self.size + np.arange(len(key))
        self.empty = np.log10(p1)
        # arcs of word states and of pair states: keys, weights, states that they lead to
        self.arcs = [(k[on], np.log10(p[on]), to[on]) for k, p, to, on in ((key, p2, of_pair, seen > 0), (triple, p3, of_pair[end], thrice > 0))]
        self.fail_weight = np.log10(np.concatenate([[1.0], mu[0] / (history + mu[0]), mu[1] / (seen + mu[1])]))
        self.fail_to = np.concatenate([np.zeros(1 + self.size, np.int64), 1 + second.astype(np.int64)])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, weights) after each state reads its word, by failure arcs down to a state that has an arc for it."""
        state, weight, todo = state.copy(), np.zeros(len(state)), np.ones(len(state), bool)
        for (keys, weights, to), above in ((self.arcs[1], self.size), (self.arcs[0], 0)):  # pairs, then words
            at = np.flatnonzero(todo & (state > above))
            wanted = _mixed(self.state_key[state[at]], self.low[word[at]])
            arc = np.searchsorted(keys, wanted)
            arc[arc == len(keys)] = 0
            hit = keys[arc] == wanted if len(keys) else np.zeros(len(at), bool)
            done, arc, failed = at[hit], arc[hit], at[~hit]
            weight[done] += weights[arc]
            state[done] = to[arc]
            todo[done] = False
            weight[failed] += self.fail_weight[state[failed]]
            state[failed] = self.fail_to[state[failed]]
        weight[todo] += self.empty[word[todo]]
        state[todo] = 1 + word[todo]
        return state, weight

    def walk(self, run: np.ndarray, first: np.ndarray, length: np.ndarray, start: int, stretch: int = STRETCH) -> np.ndarray:
        """Sum of the weights of each text: length words of run from its first on, out of the state of the word start."""
        parts = np.maximum(1, -(-length // stretch))
        text = np.repeat(np.arange(len(first)), parts)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        warm = np.where(turn > 0, 2, 0)
        begin = first[text] + turn * stretch - warm
        steps = np.minimum(stretch, length[text] - turn * stretch) + warm
        order = np.argsort(-steps, kind="stable")
        text, warm, begin, steps = text[order], warm[order], begin[order], steps[order]
        state, total = np.where(warm > 0, 0, 1 + start), np.zeros(len(text))
        lanes = len(text)
        for t in range(int(steps[0]) if len(steps) else 0):
            while lanes and steps[lanes - 1] <= t:
                lanes -= 1
            state[:lanes], weight = self.step(state[:lanes], run[begin[:lanes] + t])
            total[:lanes] += weight if t > 1 else np.where(warm[:lanes] > t, 0.0, weight)
        return np.bincount(text, total, len(first))


def _tokenized(rows: pa.Table) -> bytes:
    """A block of (doc_id, data) as its distinct words, in the order of their hashes, and runs of their numbers."""
    words: defaultdict = defaultdict()
    words.default_factory = words.__len__
    runs = [np.fromiter(map(words.__getitem__, (START, *tokens(x.as_py() or b""))), np.int64) for x in rows["data"]]
    digest = _digests(words)
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    named = pa.array(list(words), pa.binary()).take(pa.array(order))
    row = {"doc_id": [rows["doc_id"].to_pylist()], "lengths": [[len(r) for r in runs]], "run": [put_numbers(place[np.concatenate(runs)])], "words": pa.ListArray.from_arrays([0, len(named)], named)}
    return ipc(pa.table(row, schema=pa.schema([("doc_id", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("run", pa.binary()), ("words", pa.list_(pa.binary()))])))


def _digests(words) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts the keys, where each distinct key begins in it, distinct keys)."""
    order = np.argsort(keys)
    ranked = keys[order]
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), ranked[1:] != ranked[:-1]]))
    return order, begins, ranked[begins]


class Block:
    """A block's texts as runs of numbers of its own words; each text begins with START, which is no token."""

    def __init__(self, pack: bytes) -> None:
        row = opened(pack)
        self.doc_id = row["doc_id"][0].as_py()
        lengths = np.array(row["lengths"][0].as_py(), np.int64)
        digest = _digests(row["words"][0].as_py())
        self.low, self.high = np.ascontiguousarray(digest[:, 0]), np.ascontiguousarray(digest[:, 1])
        ends = _digests((START, END))
        self.start, self.end = (int(np.flatnonzero((digest == e).all(1))[0]) for e in ends)
        self.run = get_numbers(row["run"][0].as_py()).astype(np.int32)
        self.tokens = lengths - 1
        self.first = np.cumsum(lengths) - lengths + 1  # after the start of each text
        at = np.ones(len(self.run), bool)
        at[self.first - 1] = False
        self.at = np.flatnonzero(at)  # places of tokens in the run; what stands before one is its history
        left = [remainder(d) for d in self.doc_id]
        self.held = np.array([r == HELD for r in left])
        self.train = np.array([r is not None and r != HELD for r in left])
        self.on = np.repeat(self.train, self.tokens)  # whether each token trains

    def pair_keys(self) -> np.ndarray:
        """The key of each token with what stands before it."""
        return _mixed(self.low[self.run[self.at - 1]], self.low[self.run[self.at]])

    def triple_keys(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens with two before them, START counted; the key of each with these)."""
        third = np.ones(len(self.at), bool)
        third[self.first - 1 - np.arange(len(self.first))] = False  # the first token of each text
        here = np.flatnonzero(third)
        return here, _mixed(pair[here - 1], self.low[self.run[self.at[here]]])

    def automaton(self, n: int, v: int, totals: list[np.ndarray], mu) -> Automaton:
        words, pairs, triples = totals
        history = words.copy()
        history[self.start] = words[self.end]  # each document starts once and ends once
        pair = self.pair_keys()
        order, begins, keys = _grouped(pair)
        number = np.empty(len(order), np.int32)
        number[order] = np.repeat(np.arange(len(keys), dtype=np.int32), np.diff(np.append(begins, len(order))))
        one = self.at[order[begins]]
        here, triple = self.triple_keys(pair)
        del pair
        order, begins, triple = _grouped(triple)
        of = here[order[begins]]
        return Automaton(n, v, self.low, words, history, (keys, self.run[one - 1], self.run[one], pairs), (triple, number[of - 1], number[of], triples), mu)


KINDS = ("words", "pairs", "triples")
SENT = "part int, block long, " + ", ".join(f"{k} binary, {k}_counts binary" for k in KINDS) + ", high binary"


def _counted(ranges: int, kinds: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys and counts in training documents, a row for each range; kinds that are not asked for are null."""
    for batch in batches:
        for number, pack in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            block = Block(pack.as_py())
            found: dict[str, tuple] = {}
            if "words" in kinds:
                found["words"] = block.low, np.bincount(block.run[block.at[block.on]], minlength=len(block.low))
            pair = block.pair_keys()
            for kind, keys, on in (("pairs", pair, block.on), ("triples", None, None)):
                if kind in kinds:
                    if keys is None:
                        here, keys = block.triple_keys(pair)
                        on = block.on[here]
                    order, begins, keys = _grouped(keys)
                    found[kind] = keys, np.add.reduceat(on[order], begins, dtype=np.int64) if len(order) else np.zeros(0, np.int64)
            cuts = {k: bounds(keys, ranges) for k, (keys, _) in found.items()}
            some = np.flatnonzero(np.logical_or.reduce([c[1:] > c[:-1] for c in cuts.values()]))
            columns = {"part": pa.array(some, pa.int32()), "block": pa.array(np.full(len(some), number), pa.int64())}
            for kind in KINDS:
                if kind in found:
                    (keys, counts), cut = found[kind], cuts[kind]
                    columns[kind] = pa.array([put_keys(keys[cut[k] : cut[k + 1]]) for k in some], pa.binary())
                    columns[f"{kind}_counts"] = pa.array([put_numbers(counts[cut[k] : cut[k + 1]]) for k in some], pa.binary())
                else:
                    columns[kind] = columns[f"{kind}_counts"] = pa.nulls(len(some), pa.binary())
            high = [block.high[cuts["words"][k] : cuts["words"][k + 1]].tobytes() for k in some] if "words" in found else [None] * len(some)
            yield pa.RecordBatch.from_pydict({**columns, "high": pa.array(high, pa.binary())})


TOTALS = "part int, block long, words binary, pairs binary, triples binary, n long, v long"


def _summed(kinds: tuple[str, ...], rows: pa.Table) -> pa.Table:
    """For each block, its totals in its own order; on the first row also what the range adds to N and V."""
    back, n, v = {}, 0, 0
    for kind in kinds:
        each = [get_keys(x.as_py()) for x in rows[kind]]
        key, count = np.concatenate(each), np.concatenate([get_numbers(x.as_py()) for x in rows[f"{kind}_counts"]])
        high = np.frombuffer(b"".join(rows["high"].to_pylist()), "<u8") if kind == "words" else None
        order = np.argsort(key) if high is None else np.lexsort((high, key))
        ranked = key[order]
        apart = ranked[1:] != ranked[:-1]
        if high is not None:
            apart |= high[order][1:] != high[order][:-1]
        begins = np.concatenate([np.zeros(min(1, len(key)), np.int64), np.flatnonzero(apart) + 1])
        total = np.add.reduceat(count[order], begins) if len(key) else count
        if kind == "words":
            n, v = int(total.sum()), int((total > 0).sum())
        own = np.empty(len(key), np.int64)
        own[order] = np.repeat(total, np.diff(np.append(begins, len(key))))
        back[kind] = [put_numbers(x) for x in np.split(own, np.cumsum([len(e) for e in each])[:-1])]
    first = [1] + [0] * (rows.num_rows - 1)
    answers = [pa.array(back[k], pa.binary()) if k in back else pa.nulls(rows.num_rows, pa.binary()) for k in KINDS]
    return pa.table([rows["part"].combine_chunks(), rows["block"].combine_chunks(), *answers, pa.array([n * f for f in first], pa.int64()), pa.array([v * f for f in first], pa.int64())], names=[f.split()[0] for f in TOTALS.split(", ")])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(n: int, v: int, mu: tuple[float, float], packs: pa.Table, model: pa.Table) -> pa.Table:
    model = model.sort_by("part")
    out = []
    for pack in packs["pack"]:  # one
        block = Block(pack.as_py())
        totals = [np.concatenate([get_numbers(x) for x in model[c].to_pylist() if x is not None] or [np.zeros(0, np.int64)]) for c in KINDS]
        automaton = block.automaton(n, v, totals, mu)
        word = block.run[block.at]
        offsets = block.first - 1 - np.arange(len(block.first))
        known, base = (np.add.reduceat(x, offsets) for x in ((totals[0] > 0).astype(np.int64)[word], automaton.empty[word]))
        walked = automaton.walk(block.run, block.first, block.tokens, block.start)
        out.append(pa.table([pa.array(block.doc_id, pa.int64()), pa.array(block.held), pa.array(block.tokens, pa.int64()), pa.array(known), pa.array(np.full(len(known), n), pa.int64()), pa.array(base), pa.array(walked)], names=[f.split()[0] for f in SCORED.split(", ")]))
    return pa.concat_tables(out) if out else pa.table({f.split()[0]: pa.array([], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.split()[1]]) for f in SCORED.split(", ")})


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mu: tuple[float, float] = MU, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SCORED: one row per input row, by a model of the rows whose crc32(id) mod 10 is not 0.

    Null texts are empty (their end alone is scored); rows without an id are scored, but neither train nor are
    held out; repeated rows count as often as they occur; no rows give no rows, and with no training rows
    every probability is that of an unknown word. Other columns are not read.
    """
    packs = packed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("data")), block_bytes, _tokenized)
    ranges = ranges_for(packs, range_bytes)

    def totals_of(*kinds: str) -> DataFrame:
        sent = packs.select("block", "pack").mapInArrow(partial(_counted, ranges, kinds), SENT)
        return stored(sent.groupBy("part").applyInArrow(on_table(_summed, kinds), TOTALS))

    # one exchange after the other, so that only one lies on disk
    totals = totals_of("words", "pairs").union(totals_of("triples"))
    n, v = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    model = totals.select("block", "part", *KINDS).groupBy("block")
    return packs.select("block", "pack").groupBy("block").cogroup(model).applyInArrow(on_tables(_scored, n, v, tuple(mu)), SCORED)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() over all documents; see there for nulls, repeats and empty tables."""
    return score(table(spark, sf_dir, "documents"))
