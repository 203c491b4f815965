from __future__ import annotations

import importlib
import sys

import pytest

import __spark_entry__ as entry
from feedloom.plans import registry

duckdb = pytest.importorskip("duckdb")


def test_core_works_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "feedloom.llm", None)
    try:
        bare = importlib.reload(entry)
        assert set(bare.queries()) == set(registry.queries())
        assert set(bare.oracle_sql()) == set(registry.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {r.source for r in entry.entry(spark).collect()} == {"app_store", "play_store"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in ("raw_review", "clean_review", "embedding_cache", "review_cluster", "pulse_run", "product_registry", "documents", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got, want = registry.queries()[name](spark, data).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)

    def rows(frame):
        def plain(x):
            if x is None or str(x) in ("<NA>", "NaT", "nan"):
                return None
            if hasattr(x, "year"):
                return str(x)[:19]
            return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x

        return sorted((tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)

    assert rows(got) == rows(want)
