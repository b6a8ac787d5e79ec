"""Every registered query against its SQL counterpart on the smallest tables."""

import importlib.util
import os

import pytest
from conftest import ROOT, SF
from oracle import compare, connect

_spec = importlib.util.spec_from_file_location("entry_names", os.path.join(ROOT, "__spark_entry__.py"))
_entry = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_entry)
QUERIES, SQL = _entry.queries(), _entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# the training-data operators have tests of their own
@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"} - {n for n in QUERIES if n.startswith("op")}))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert compare(con, df, SQL[name]) is None
        assert con.execute(f"select count(*) from ({SQL[name]})").fetchone()[0] > 0, "a query without rows shows nothing"
    else:
        assert df.count() > 0


def test_entry(spark):
    assert _entry.entry(spark).columns == ["question_id", "chunk_id", "score", "position"]


def test_every_counterpart_has_a_query():
    assert set(SQL) <= set(QUERIES)
