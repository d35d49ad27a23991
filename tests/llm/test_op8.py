import numpy as np
import pytest
import xxhash

from codequery.llm import op8_simhash_near_dedup as op8


def brute(prints, radius=3):
    p = np.array(prints, np.uint64)
    root = list(range(len(p)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(p)):
        d = np.bitwise_count(p ^ p[i])
        for j in np.flatnonzero(d <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(p))]


def test_bit_sliced_links_equal_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    p = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, False))) for k in range(6)]))
    got = {(int(i), int(j)) for a, b in op8.linked(np.zeros(len(p), int), p) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if (int(p[i]) ^ int(p[j])).bit_count() <= 3}
    assert got == want and want


def own_fingerprint(text):
    """Word by word and bit by bit."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [1 << 14, 25])
def test_documents_equal_brute_force(spark, bucket):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    extra = [(10_001, None), (10_002, ""), (10_003, " \t\n"), (10_004, "one Two"), (10_005, "ONE two"), (10_006, "x " * 50_000)]
    rows += extra + [rows[0]]
    got = sorted(op8.near_dedup(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, root int"), bucket=bucket).collect())
    rows = sorted(rows, key=lambda r: r[0])
    prints = [own_fingerprint(t) for _, t in rows]
    roots = brute(prints)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, d), d)
    want = sorted((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots, strict=True))
    assert [tuple(x) for x in got] == want


def test_no_rows(spark):
    assert op8.near_dedup(spark.createDataFrame([], "doc_id long, text string, fp int, component_id int")).collect() == []


def test_hot_buckets_are_split_without_loss(spark):
    rng = np.random.default_rng(4)
    base = [int(rng.integers(0, 2**63)) for _ in range(3)]
    p = sorted({b ^ sum(1 << int(x) for x in rng.choice(64, k, False)) for b in base for k in (0, 1, 2, 3, 4) for _ in range(15)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in p], "fp long")
    want = brute(p)
    for bucket in (1 << 14, 40):
        root = {x: x for x in p}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in op8.link_forest(df, bucket=bucket).collect():
            a, b = sorted((find(r.a % (1 << 64)), find(r.b % (1 << 64))))
            root[b] = a
        assert [find(x) for x in p] == [p[k] for k in want]


def test_ids_that_are_null_and_a_stage_that_keeps_one_row(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, None), (None, ""), (9, "w x y z q r")], "doc_id long, text string")
    got = sorted(map(tuple, op8.near_dedup(df).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (None, None), (9, 9)], key=str)
    kept = op8.stage(spark, df.select("*", df.doc_id.alias("_row"), df.text.alias("_fp")), "")
    assert kept.columns == ["doc_id", "text", "_row", "_fp"]
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [0, 7, 9]
    assert op8.stage(spark, df.limit(0), "").collect() == []
