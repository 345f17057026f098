"""SQL to column edges."""

import pytest

from spindrift.functions.dialect import dialect_of, qualify_to_filter, to_spark
from spindrift.functions.transforms import most_significant
from spindrift.plans.analyze import analyze_sql
from spindrift.plans.foreign_samples import FOREIGN, SCHEMA



def edges(spark, sql, schema=None, **options):
    r = analyze_sql(spark, sql, "m", SCHEMA if schema is None else schema, {}, **options)
    return {(e["source_model"], e["source_column"], e["target_column"], e["transform_type"]) for e in r.edges}


CASES = [
    ("SELECT order_id FROM orders", {("orders", "order_id", "order_id", "passthrough")}),
    ("SELECT id AS order_id FROM raw", {("raw", "id", "order_id", "rename")}),
    ("SELECT CAST(a AS STRING) AS b FROM x", {("x", "a", "b", "cast")}),
    ("SELECT a + b AS c FROM x", {("x", "a", "c", "arithmetic"), ("x", "b", "c", "arithmetic")}),
    ("SELECT SUM(amount) AS total FROM orders", {("orders", "amount", "total", "aggregation")}),
    ("SELECT COUNT(*) AS n FROM orders", {("__literal__", "COUNT(*)", "n", "literal")}),
    ("SELECT CASE WHEN s = 1 THEN 2 END AS f FROM x", {("x", "s", "f", "conditional")}),
    ("SELECT LOWER(s) AS f FROM x", {("x", "s", "f", "function")}),
    ("SELECT a || b AS f FROM x", {("x", "a", "f", "complex"), ("x", "b", "f", "complex")}),
    ("SELECT SUM(v) OVER (PARTITION BY k) AS w FROM x", {("x", "v", "w", "window")}),
    ("SELECT ROW_NUMBER() OVER (PARTITION BY k ORDER BY d) AS w FROM x", {("x", "k", "w", "window"), ("x", "d", "w", "window")}),
    ("SELECT * FROM stg_orders", {("stg_orders", "order_id", "order_id", "passthrough"), ("stg_orders", "status", "status", "passthrough")}),
    ("SELECT * EXCEPT (status) FROM stg_orders", {("stg_orders", "order_id", "order_id", "passthrough")}),
    ("SELECT * FROM unknown", set()),
    ("SELECT id, a, c FROM t1 JOIN t2 USING (id)", {("t1", "id", "id", "passthrough"), ("t2", "id", "id", "passthrough"), ("t1", "a", "a", "passthrough"), ("t2", "c", "c", "passthrough")}),
    ("SELECT id FROM t1 JOIN t2 ON t1.id = t2.id", set()),
    ("WITH b AS (SELECT id AS k, amount FROM raw) SELECT k AS order_id, amount * 100 AS cents FROM b", {("raw", "id", "order_id", "rename"), ("raw", "amount", "cents", "arithmetic")}),
    ("WITH b AS (SELECT SUM(x) AS s FROM raw) SELECT s AS total FROM b", {("raw", "x", "total", "aggregation")}),
    ("WITH b AS (SELECT * FROM raw) SELECT v FROM b", {("raw", "v", "v", "passthrough")}),
    ("WITH orders AS (SELECT id FROM orders) SELECT o.id FROM orders o", {("orders", "id", "id", "passthrough")}),
    ("SELECT a FROM x UNION ALL SELECT b FROM y", {("x", "a", "a", "passthrough"), ("y", "b", "a", "rename")}),
    ("SELECT v FROM (SELECT MAX(p) AS v FROM x) d", {("x", "p", "v", "aggregation")}),
    ("SELECT SAFE_CAST(a AS INT64) AS b FROM `p.d.t`", {("p.d.t", "a", "b", "cast")}),
    ("SELECT a FROM x QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY d) = 1", {("x", "a", "a", "passthrough")}),
    ("SELECT array_agg(r ORDER BY d DESC LIMIT 1)[OFFSET(0)] AS v FROM x", {("x", "r", "v", "complex")}),
]


@pytest.mark.parametrize("sql,expected", CASES, ids=[c[0][:50] for c in CASES])
def test_edges(spark, sql, expected):
    assert edges(spark, sql) == expected




@pytest.mark.parametrize("dialect,sql,expected", FOREIGN, ids=[f[1][:60] for f in FOREIGN])
def test_foreign_sql(spark, dialect, sql, expected):
    result = analyze_sql(spark, sql, "m", SCHEMA, {}, dialect=dialect)
    assert result.error is None
    assert expected is None or edges(spark, sql, dialect=dialect) == expected


@pytest.mark.parametrize("sql", ["", None, "THIS IS NOT SQL AT ALL", "SELECT {{ x }} FROM t"])
def test_no_edges(spark, sql):
    assert analyze_sql(spark, sql, "m").edges == []


def test_unparsable_sql_is_noted(spark):
    assert analyze_sql(spark, "THIS IS NOT SQL AT ALL", "m").error


def test_double_quotes_are_identifiers_in_some_dialects(spark):
    assert edges(spark, 'SELECT "a" AS b FROM x', dialect="postgres") == {("x", "a", "b", "rename")}


def test_ambiguous_column_is_listed(spark):
    assert analyze_sql(spark, "SELECT id FROM t1 JOIN t2 ON t1.id = t2.id", "m", SCHEMA).ambiguous_columns == ["id"]


def test_column_cap(spark):
    assert len(edges(spark, "SELECT a, b, c FROM x", max_columns=2)) == 2


def test_shared_ctes_are_cheap(spark):
    # each CTE reads the one before twice: worked out once each, not 2**24 times
    ctes = ", ".join(f"c{i} AS (SELECT l.v + r.v AS v FROM c{i - 1} l JOIN c{i - 1} r ON l.v = r.v)" for i in range(1, 25))
    assert edges(spark, f"WITH c0 AS (SELECT v FROM x), {ctes} SELECT v FROM c24") == {("x", "v", "v", "arithmetic")}


def test_dialects():
    assert dialect_of("BigQuery") == "bigquery" and dialect_of("athena") == "presto" and dialect_of("nope") is None
    assert "QUALIFY" not in to_spark("SELECT a FROM t QUALIFY x = 1 ORDER BY a") and "ORDER BY a" in to_spark("SELECT a FROM t QUALIFY x = 1 ORDER BY a")
    assert to_spark("SELECT 'QUALIFY' AS q") == "SELECT 'QUALIFY' AS q"


def test_qualify_runs(spark):
    spark.range(6).selectExpr("id", "id % 2 AS k").createOrReplaceTempView("q")
    rows = spark.sql(qualify_to_filter("SELECT id, k FROM q QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY id DESC) = 1")).collect()
    assert sorted((r["id"], r["k"]) for r in rows) == [(4, 0), (5, 1)]


def test_significance():
    assert most_significant(["rename", "window", "cast"]) == "window" and most_significant([]) == "unknown"
