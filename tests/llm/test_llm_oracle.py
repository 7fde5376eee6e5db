"""Every query of the subpackage with SQL, beside DuckDB."""

import pytest

from conftest import DATA
from logmill.llm.queries import QUERIES, SQL
from test_oracle import con, sorted_rows  # noqa: F401


@pytest.mark.parametrize("name", list(SQL))
def test_same_as_sql(name, spark, small, con):  # noqa: F811
    assert DATA
    df = QUERIES[name](spark, small)
    r = con.sql(SQL[name])
    assert sorted_rows(df.collect(), df.columns) == sorted_rows(r.fetchall(), r.columns)
