"""Every registered query against its SQL twin, and the plans of those that should stay built in."""

import math

import duckdb
import pytest

import __spark_entry__
from tallyloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PYTHON = {"chatml_parse", "judge_parse", "output_parse", "fuzzy_merge", "aspects_from_text", "aspect_repr", "judged_again", "annotated_by_client", "annotated_in_batches", "stopped_and_resumed", "captured_logs", "chat_or_rows", "live_history", "business_class_by_automaton", "single_text", "evaluation_flow", "output_parse_many"}


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf, sql, name):
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    twin = sql.sql(registry.SQL[name])
    assert sorted(twin.columns) == names
    at = [twin.columns.index(c) for c in names]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in twin.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - PYTHON - {"review_ids"}))
def test_plans_stay_built_in(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("EvalPython", "InArrow", "InPandas", "CartesianProduct"))


def test_filters_reach_the_scan(spark, sf):
    plan = registry.QUERIES["ate_exact"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
    assert "text" not in registry.QUERIES["scoreable"](spark, sf)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
