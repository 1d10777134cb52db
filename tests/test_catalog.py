import glob
import os

import duckdb
import pytest
from conftest import SF

from vespera import catalog


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df, columns):
    return sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_unified_diff_equals_the_standard_librarys(spark):
    import difflib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["page"]: r["diff"] for r in catalog.QUERIES["page_unified_diff"](spark, SF).collect()}
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"page_unified_diff"} and got.keys() == {k for k in texts if k % 4 == 0}
    for k, d in got.items():
        new = "first\n" + texts[k] + "\nlast"
        assert d == "\n".join(difflib.unified_diff(texts[k].split("\n"), new.split("\n"), f"{k} (old)", f"{k} (new)", lineterm=""))


def test_entry(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
