"""Each registered XML query against its SQL on the smallest tables."""

import duckdb
import pytest

from tests.conftest import SF
from xylem.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(df.collect(), df.columns) == canonical(want.fetchall(), want.columns)


def test_one_exchange_for_a_path(spark):
    from xylem import corpora
    from xylem.engine import Documents

    docs = spark.createDataFrame([(1, "<a/>")], "doc_id long, content string")
    plan = Documents(docs, unique_ids=True).select("/a/b/c", "window")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert corpora.PART_GROUP
