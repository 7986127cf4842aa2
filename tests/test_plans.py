"""Physical-plan properties: pruning and pushdown reach the scan, aggregates
combine map-side, and no registered query leaves the JVM for Python."""

import contextlib
import io
import re

import __spark_entry__ as E
from fieldpulse.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF",
            "FlatMapCoGroupsInPandas", "AggregateInPandas", "WindowInPandas")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_window_stats_scan_is_pruned_and_filtered(spark):
    plan = _plan(E.queries()["window_global_stats"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all(set(s.split(",")) == {"ts:timestamp_ntz", "value:double"} for s in schemas)
    assert "PushedFilters: [IsNotNull(value), IsNotNull(ts)]" in plan


def test_aggregates_are_partial_before_shuffle(spark):
    plan = _plan(E.queries()["window_stats_nested"](spark, SF))
    assert "partial_count" in plan and "partial_sum" in plan
    # one hash exchange per aggregation level, none on raw rows without a partial aggregate below
    for m in re.finditer(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        assert "window" in m.group(1)


def test_registered_queries_stay_jvm_side_and_match_oracle_schemas(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    type_map = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    sqls = E.oracle_sql()
    for name, q in QUERIES.items():
        df = q(spark, SF)
        plan = _plan(df)
        assert not any(n in plan for n in PY_NODES), name
        rel = con.sql(sqls[name])
        spark_types = {f.name: type_map.get(f.dataType.simpleString()) for f in df.schema.fields}
        duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
        assert spark_types == duck_types, name


def test_spread_only_when_the_session_asks_for_it(spark):
    from fieldpulse.session import DECODE_TASKS_KEY, spread
    df = spark.range(0, 10000, numPartitions=1)
    assert spread(df, "id") is df                                  # no shuffle added
    spark.conf.set(DECODE_TASKS_KEY, "5")
    try:
        assert spread(df, "id").rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset(DECODE_TASKS_KEY)
