"""Every query that SQL can express, against DuckDB on the same tables."""

import pytest
from conftest import same_rows

from turnweave.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_duckdb(name, spark, duck, sf_dir):
    want = duck.execute(registry.ORACLE[name]).df()
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    for df in (want, got):
        for c in df.columns:
            if df[c].dtype.kind == "M":
                df[c] = df[c].astype("datetime64[us]").astype(str)
    same_rows(want, got)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_has_rows(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
