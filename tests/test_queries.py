"""Every query against its DuckDB SQL on the smallest tables; the driver does the same at another scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]


def plain(value):
    if isinstance(value, float):
        return repr(value)
    return "∅" if value is None or value is pd.NA else str(value)


def rows(frame):
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(plain(float(v) if isinstance(v, float) and not v.is_integer() else int(v) if isinstance(v, float) else v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", OWN)
def test_query_matches_oracle(spark, name):
    out = entry.queries()[name](spark, SF).toPandas()
    assert len(out)
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        expected = con.execute(entry.oracle_sql()[name]).fetchdf()
        assert sorted(out.columns) == sorted(expected.columns)
        assert rows(out) == rows(expected)


def test_entry(spark):
    assert entry.entry(spark).count() == 692
