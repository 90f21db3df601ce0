"""Every registered shipment query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from cargolens.plans import registry

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    return float(f"{float(value):.9g}") if isinstance(value, (int, float)) else str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf, duck, name):
    mine = registry.queries()[name](spark, sf)
    twin = duck.execute(ORACLES[name])
    names = [d[0] for d in twin.description]
    assert sorted(mine.columns) == sorted(names)
    got, want = rows(mine.columns, [tuple(r) for r in mine.collect()]), rows(names, twin.fetchall())
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-7) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
