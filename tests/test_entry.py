import os
import re

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "per_device" not in df.columns and "device_id" in df.columns


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 60
    assert set(sql) <= set(qs)


def test_training_data_queries_are_there():
    """Where the optional part is present, an import error must not drop its queries without a word."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    if os.path.isdir(os.path.join(root, "fieldpulse", "llm")):
        assert "pipeline" in E.queries()
        assert {int(re.match(r"op(\d+)_", n)[1]) for n in E.queries() if n.startswith("op")} == set(range(1, 14))


def test_small_queries_run(spark):
    for name in ("window_global_stats", "latency_summary", "drain_stable", "group_lag"):
        assert E.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
