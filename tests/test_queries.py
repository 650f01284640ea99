"""Queries against their oracle SQL, and the entry point; INKSCAN_SF names other tables than the smallest."""

import os

import duckdb
import pytest

import __spark_entry__
from inkscan.operators.checks import faults
from inkscan.oracles_built import ALL as ORACLES
from inkscan.queries import QUERIES

SF = os.environ.get("INKSCAN_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("documents", "labels", "conversations", "pages"):
        if os.path.exists(f"{SF}/{name}.parquet"):
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert len(got) == len(want)
    differ = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert differ == [], differ[:3]


def test_entry_and_rules(spark):
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns[:3] == ["doc_id", "score", "verdict"]
    assert faults() == []
