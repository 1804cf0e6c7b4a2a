import pytest

from skylattice.llm import queries
from tests.oracle import SF_DIR, compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_oracle(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0


#: Queries that return ranks.
RANKED = {"op11_inner_products", "op13_ranked_search"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_every_row(spark, name):
    table = {"op3_quote_links": "conversations", "op7_language_id": "pages"}.get(name, "documents")
    if name in RANKED:
        pytest.skip("ranks, not rows of a table: tested in its own module")
    n = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    got = queries.QUERIES[name](spark, SF_DIR).count()
    assert got == n if name != "op8_spaced_seeds" else 0 < got < n
