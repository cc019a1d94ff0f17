"""The driver contract: what is registered, and some queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from plumbline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


def test_registration():
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalogue.QUERIES) <= set(q) and set(sql) <= set(q)
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_only_a_missing_subpackage_is_passed_over(monkeypatch):
    import builtins

    real = builtins.__import__

    def without(name, missing):
        def load(module, *a, **k):
            if module == name:
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return real(module, *a, **k)

        return load

    monkeypatch.setattr(builtins, "__import__", without("plumbline.llm.registry", "plumbline.llm"))
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES)
    monkeypatch.setattr(builtins, "__import__", without("plumbline.llm.registry", "xxhash"))
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["dedup_trust_ranked", "upsert_sticky_last", "hub_filter", "compact_spine", "enum_counter", "eval_branch", "probe_first_hit", "ttl_checkup", "resolve_typed", "unify_pointers", "load_flows", "bfs_hub_pruned", "optional_expand"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(catalogue.SQL[name])
    cols = [c[0] for c in cur.description]
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
