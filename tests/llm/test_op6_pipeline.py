import numpy as np

import corpus_pipeline
from codequery.llm import op6_line_dedup as op6
from codequery.llm import op8_simhash_near_dedup as op8

SF = "/root/testdata/sf0.001"


def norm(line):
    return line.strip(" \t\r\x0b\f").lower()


def brute(rows, limit=0.8):
    """Kept texts: all pairs of distinct lines by exact similarity."""
    places = [(d is not None, d, t, i, norm(x)) for d, t in rows for i, x in enumerate((t or "").split("\n")) if norm(x)]
    distinct = sorted({p[4] for p in places})
    sets = [op6.shingles(x.encode()) for x in distinct]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets])
    for i in range(len(sets)):
        for j in np.flatnonzero((sizes[i + 1 :] >= limit * sizes[i]) & (limit * sizes[i + 1 :] <= sizes[i])) + i + 1:
            if op6.jaccard_at_least(sets[i], sets[j], limit):
                root[find(int(j))] = find(i)
    at = {x: find(i) for i, x in enumerate(distinct)}
    first = {}
    for has, d, t, i, x in places:
        key = (has, d or 0, i)
        if at[x] not in first or key < first[at[x]][0]:
            first[at[x]] = (key, (d, t, i))
    keep = {v[1] for v in first.values()}
    return [(d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not norm(x) or (d, t, i) in keep)) for d, t in rows]


def fixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    long = "the quick brown fox jumps over the lazy dog and runs into the forest where nobody has ever been before"
    rows += [(90_001, None), (90_002, ""), (90_003, "\n \nA\n a\r\nb"), (None, "a\n" + long), (90_005, long + "!\nnew line of its own"), (90_006, long.upper()), (90_007, "z" * 100_000)]
    return rows


def test_lines_equal_brute_force(spark):
    rows = fixture(spark)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, line int, band int")
    want = sorted(brute(rows), key=str)
    for size in (1024, 2):
        got = op6.dedup(df, unit_lines=size, block_bytes=20 * size << 10, range_bytes=100_000)
        assert got.columns == ["doc_id", "text", "line", "band", "_lines", "_removed"]
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (2, "x y z")], "doc_id long, text string")
    assert sorted(tuple(r)[:2] for r in op6.dedup(df).collect()) == [(1, "x y z"), (1, "x y z"), (2, "")]
    assert op6.dedup(df.limit(0)).collect() == []


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = op8.stage(spark, docs, SF)
    assert kept.columns == docs.columns
    near = op8.near_dedup(docs)
    assert kept.count() == near.select("component_id").distinct().count()
    lines = op6.stage(spark, docs, SF)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert lines.where("n_chars <> length(text)").count() == 0


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 0.3 * n < len(ids) <= n


def test_pipeline_of_odd_rows_and_of_none(spark, tmp_path):
    """Null texts and ids, repeated rows and ties pass every stage; what is packed is what the stages kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(40)
    rows = odd.union(odd).union(odd.limit(2).selectExpr(*["CAST(NULL AS STRING) AS text" if c == "text" else c for c in odd.columns])).union(odd.limit(2).selectExpr(*["CAST(NULL AS BIGINT) AS doc_id" if c == "doc_id" else c for c in odd.columns]))
    for name, table in (("odd", rows), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    kept = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, str(tmp_path / "odd")).cache()
        assert kept.columns == docs.columns and kept.count() <= before
    assert kept.count() == kept.select("doc_id", "text").distinct().count()  # SimHash leaves one row of each group
    packed = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert sorted(str(r.doc_id) for r in packed.where("piece = 0").collect()) == sorted(str(r.doc_id) for r in kept.collect())
