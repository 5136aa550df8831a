"""Every registered query that has SQL gives the same rows as DuckDB, at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog, feeds, records  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "NULL" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = canonical(df.collect(), df.columns)
    assert len(set(df.columns)) == len(df.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == canonical(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def zero_closes(tmp_path_factory):
    """Six days of 60 users: some closes that a return is taken over, and some last ones, are zero, of held users too."""
    root = tmp_path_factory.mktemp("zeros")
    duckdb.connect().execute(f"""COPY (SELECT u * 6 + d AS event_id, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)) + to_seconds(u) AS ts, u AS user_id, 'view' AS event_type,
        CASE WHEN d = 1 AND u % 7 = 3 OR d = 5 AND u % 11 = 5 AND u % 7 <> 3 THEN 0E0 ELSE 1E0 + (u * 37 + d * 11) % 101 END AS value, '{{"k": 1}}' AS props FROM range(60) a(u), range(6) b(d)) TO '{root}/events.parquet'""")
    return str(root)


@pytest.mark.parametrize("name", ["momentum_targets", "rebalance_decisions", "order_sizing"])
def test_closes_of_zero(spark, zero_closes, name):
    """A return over a close of zero is infinite, and ranks first, as in the SQL (and in pandas)."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{zero_closes}/events.parquet'")
    df = catalog.QUERIES[name](spark, zero_closes)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert canonical(df.collect(), df.columns) == canonical(want.fetchall(), want.columns)
