import pytest

from codequery.plans import catalog, code_queries, search_queries
from tests.oracle import connect, differs

SF = "/root/testdata/sf0.001"
SOME = "item_id IN (0, 7, 21)"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", ["bm25_topk_all", "bm25_lang_filter_all", "hybrid_rrf_all", "rerank_overlap_all", "rewrite_rrf3_all"])
def test_three_queries_at_once(spark, duck, name):
    plans = code_queries if name.startswith("rewrite") else search_queries
    query, sql = getattr(plans, name), getattr(plans, f"{name}_sql")(SOME)
    assert duck.sql(f"SELECT count(DISTINCT item_id) FROM ({sql})").fetchall()[0][0] == 3
    assert differs(spark, duck, name, lambda s, d: query(s, d, SOME), sql, SF) is None


def test_every_hundredth_vector_in_small_blocks(spark, duck):
    sql = catalog.oracle_sql()["dense_topk_all"]
    assert duck.sql(f"SELECT count(DISTINCT query_id) FROM ({sql})").fetchall()[0][0] == 5
    for block in (4096, 100):
        assert differs(spark, duck, "dense_topk_all", lambda s, d, b=block: search_queries.dense_topk_all(s, d, b), sql, SF) is None
