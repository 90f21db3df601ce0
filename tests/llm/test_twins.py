"""Each corpus query that has a DuckDB twin against it."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from cargolens.llm import queries as q

ORACLES = q.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def in_order(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf, duck, name):
    mine = q.queries()[name](spark, sf)
    twin = duck.execute(ORACLES[name])
    names = [d[0] for d in twin.description]
    assert sorted(mine.columns) == sorted(names)
    got, want = in_order(map(tuple, mine.collect()), mine.columns), in_order(twin.fetchall(), names)
    assert len(got) == len(want) > 0
    assert got == want
