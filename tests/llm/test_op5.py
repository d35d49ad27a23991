"""The automaton against the model's formula, spelled out word by word."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codequery.llm import op5_lm_scoring as op5


def ngrams(ws, n):
    padded = [op5.START, *ws]
    return [tuple(padded[i : i + n]) for i in range(1 if n == 1 else 0, len(padded) - n + 1)]


class Formula:
    def __init__(self, texts, mu):
        self.mu = mu
        self.c = Counter(g for ws in texts for n in (1, 2, 3) for g in ngrams(ws, n))
        self.n = sum(map(len, texts))
        self.v = len({w for ws in texts for w in ws})
        self.c[(op5.START,)] = len(texts)

    def p(self, history, w):
        if not history:
            return (self.c[(w,)] + 0.1) / (self.n + 0.1 * (self.v + 1)) if w != op5.START else 0
        mu = self.mu[len(history) - 1]
        return (self.c[(*history, w)] + mu * self.p(history[1:], w)) / (self.c[history] + mu)

    def score(self, ws):
        padded = [op5.START, *ws]
        return sum(np.log10(self.p(tuple(padded[max(0, i - 2) : i]), padded[i])) for i in range(1, len(padded)))


def want(rows, mu):
    cut = [(d, op5.remainder(d), op5.tokens((t or "").encode())) for d, t in rows]
    model = Formula([ws for _, r, ws in cut if r not in (None, 0)], mu)
    for d, r, ws in cut:
        base = sum(np.log10(model.p((), w)) for w in ws)
        yield d, r == 0, len(ws), sum(model.c[(w,)] > 0 for w in ws), model.n, base, model.score(ws)


def agree(got, expected):
    got, expected = sorted(map(tuple, got), key=str), sorted(expected, key=str)
    assert len(got) == len(expected)
    for g, w in zip(got, expected, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_scores_equal_the_formula(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(70_001, None), (70_002, ""), (None, "the the"), (70_004, "A b\x0bC\x1cd é É"), (70_005, "w " * 3_000), (70_006, "a b c " * 400), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block long, data string")
    for mu, size in ((op5.MU, op5.BLOCK_BYTES), ((3.0, 0.5), 50_000)):
        agree(op5.score(df, mu=mu, block_bytes=size, range_bytes=size).collect(), want(rows, mu))


def test_one_walk_in_stretches_equals_one_without():
    rng = np.random.default_rng(2)
    texts = [[b"%d" % x for x in rng.integers(0, 9, n)] + [op5.END] for n in (0, 1, 2, 3, 7, 50, 500)]
    rows = pa.table({"doc_id": list(range(1, 8)), "data": pa.array([b" ".join(t[:-1]) for t in texts], pa.binary())})
    block = op5.Block(op5._tokenized(rows))
    pair = block.pair_keys()
    counts = [np.bincount(block.run[block.at], minlength=len(block.low)), *(np.unique(k, return_counts=True)[1] for k in (pair, block.triple_keys(pair)[1]))]
    auto = block.automaton(int(counts[0].sum()), int((counts[0] > 0).sum()), counts, (2.0, 1.0))
    whole = auto.walk(block.run, block.first, block.tokens, block.start, 1 << 20)
    for stretch in (2, 3, 16):
        assert auto.walk(block.run, block.first, block.tokens, block.start, stretch) == pytest.approx(whole, rel=1e-12)


def test_arcs_and_failure_of_a_state_sum_to_one():
    model = Formula([op5.tokens(b"a b"), op5.tokens(b"A a b b")], (4.0, 2.0))
    words = [w for (w,) in (g for g in model.c if len(g) == 1) if w != op5.START]
    unseen = model.p((), b"zz")
    for history in ((b"a",), (op5.START,), (b"a", b"b"), (op5.START, b"a")):
        rest = np.prod([model.mu[k - 1] / (model.c[history[-k:]] + model.mu[k - 1]) for k in range(1, len(history) + 1)])
        assert sum(model.p(history, w) for w in words) + rest * unseen == pytest.approx(1)


def test_without_rows_or_training(spark):
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    (row,) = op5.score(df).collect()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0.0, 0.0)
    assert op5.score(df.limit(0)).collect() == []


def test_totals_pass_32_bits():
    key = op5.put_keys(np.array([7], np.uint64))
    row = {"part": [0, 0], "block": [0, 1], "high": [b"\0" * 8] * 2}
    row |= {k: [key] * 2 for k in op5.KINDS} | {f"{k}_counts": [op5.put_numbers(np.array([3 << 31]))] * 2 for k in op5.KINDS}
    out = op5._summed(op5.KINDS, pa.table(row))
    assert out["n"].to_pylist() == [3 << 32, 0] and op5.get_numbers(out["triples"][1].as_py()).tolist() == [3 << 32]
