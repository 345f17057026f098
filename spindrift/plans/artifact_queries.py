"""Registered queries over artifacts, the store and single statements, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.dialect import DIALECTS, dialect_of
from spindrift.operators import graph as G
from spindrift.operators import reports as R
from spindrift.plans import sample_project as P
from spindrift.plans.analyze import analyze_sql
from spindrift.plans.foreign_samples import FOREIGN, SCHEMA
from spindrift.sources import artifacts, store
from spindrift.sources.shared import shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def values(columns: str, rows) -> str:
    """SQL of fixed rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) t({columns})"


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def _file(spark: SparkSession, document: dict) -> str:
    """A JSON document as a text file of the shared folder."""
    path = f"{shared_dir(spark)}/document-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.text(path)
    return path


def _node(uid: str, sql: str = "", deps=(), schema: str = "public", **more) -> dict:
    return {"unique_id": uid, "name": uid.rpartition(".")[2], "resource_type": uid.partition(".")[0], "compiled_code": sql, "depends_on": {"nodes": list(deps), "macros": []}, "database": "db", "schema": schema} | more


_UID = {n: f"model.sample.{n}" for n, _, _ in P.MODELS} | {t: f"source.sample.{t}" for t in P.TABLES}
MANIFEST = {
    "metadata": {"adapter_type": "spark", "project_name": "sample"},
    "nodes": {_UID[n]: _node(_UID[n], q, [_UID[d] for d in deps]) for n, deps, q in P.MODELS} | {"test.sample.t": _node("test.sample.t"), "seed.sample.s": _node("seed.sample.s", alias="seeded", raw_code="x", compiled_code="")},
    "sources": {_UID[t]: _node(_UID[t]) for t in P.TABLES} | {f"source.{s}.users": _node(f"source.{s}.users", schema=s, columns={"Id": {"name": "Id", "data_type": "INT"}, "mail": {"name": "mail"}}) for s in ("crm", "web")},
}
CATALOG = {
    "nodes": {_UID["stg_orders"]: {"metadata": {"name": "stg_orders"}, "columns": {"ORDER_ID": {"name": "ORDER_ID", "type": "BIGINT", "index": 2}, "Customer_Id": {"name": "Customer_Id", "type": "", "index": 1}}}},
    "sources": {"source.other.gone": {"columns": {"k": {"type": "INT"}}}},
}
_LISTED = [(_UID[n], n, "model", q) for n, _, q in P.MODELS] + [("seed.sample.s", "seeded", "seed", "x")] + [(_UID[t], t, "source", "") for t in P.TABLES] + [(f"source.{s}.users", f"{s}.users", "source", "") for s in ("crm", "web")]


def _models(spark: SparkSession) -> DataFrame:
    return artifacts.read_manifest(spark, _file(spark, MANIFEST))[0]


_add("artifact_models", lambda spark, d: _models(spark).select("unique_id", "name", "resource_type", "compiled_sql"), values("unique_id, name, resource_type, compiled_sql", _LISTED))
_add("artifact_catalog", lambda spark, d: artifacts.read_catalog(spark, _file(spark, CATALOG), _models(spark)).select("table", F.col("ordinal").cast("long").alias("ordinal"), "column", "data_type"), values('"table", ordinal, "column", data_type', [("stg_orders", 2, "order_id", "BIGINT"), ("stg_orders", 1, "customer_id", "TEXT"), ("gone", 0, "k", "INT")]))
_add("artifact_documented", lambda spark, d: artifacts.documented_schemas(_models(spark)).select("table", "column", "data_type"), values('"table", "column", data_type', [(f"{s}.users", c, t) for s in ("crm", "web") for c, t in (("id", "INT"), ("mail", "TEXT"))]))
_add("artifact_dependencies", lambda spark, d: artifacts.dependency_edges(_models(spark)), values("parent, child", [(_UID[p], _UID[n]) for n, deps, _ in P.MODELS for p in deps]))
_add("artifact_selected_downstream", lambda spark, d: artifacts.selected(_models(spark), "+order_totals", include_downstream=True).select("name"), values("name", [(n,) for n in ("order_totals", "stg_lines", "lineitem", "orders_enriched", "mart_customers")]))
_add("artifact_inspect", lambda spark, d: (lambda m: artifacts.inspect(m, artifacts.read_catalog(spark, _file(spark, CATALOG), m), "net_total").withColumn("n_columns", F.col("n_columns").cast("long")))(_models(spark)), values("name, in_catalog, n_columns, templated, names_column", [(name, name == "stg_orders", 2 if name == "stg_orders" else 0, False, "net_total" in sql) for _, name, _, sql in _LISTED]))
_RUNS = "event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN 20 ELSE 10 END AS status, ts AS created_at, event_id % 2 = 0 AS has_manifest, event_id % 4 = 0 AS has_catalog"
_add("artifact_best_runs", lambda spark, d: artifacts.best_runs(spark.read.parquet(f"{d}/events.parquet").selectExpr(*_RUNS.split(", "))).select("run_id", "has_catalog"), f"SELECT run_id, has_catalog FROM (SELECT {_RUNS} FROM events WHERE event_id % 3 <> 0 ORDER BY created_at DESC, run_id DESC LIMIT 10) WHERE has_manifest")
_ADAPTERS = [*DIALECTS, "SQLServer", "unknown", ""]
_add("dialect_map", lambda spark, d: spark.createDataFrame([(a, dialect_of(a)) for a in _ADAPTERS], "adapter string, dialect string"), values("adapter, dialect", [("snowflake", "snowflake"), ("bigquery", "bigquery"), ("postgres", "postgres"), ("redshift", "redshift"), ("databricks", "databricks"), ("duckdb", "duckdb"), ("trino", "trino"), ("spark", "spark"), ("clickhouse", "clickhouse"), ("mysql", "mysql"), ("mssql", "tsql"), ("sqlserver", "tsql"), ("athena", "presto"), ("presto", "presto"), ("SQLServer", "tsql"), ("unknown", None), ("", None)]))


def expected_edges(expected: dict[str, str]) -> list[tuple[str, str, str, str, str]]:
    """(source model, source column, target model, target column, type) of the sample models."""
    rows = []
    for model, text in expected.items():
        for part in text.split("; "):
            source, target, kind = part.rsplit(" ", 2)
            rows.append((*source.split(".", 1), model, target, kind))
    return rows


def over_sample(expected: dict[str, str]) -> None:
    """Queries over the edges of the sample project, whose list is given."""
    rows = expected_edges(expected)
    five = "source_model, source_column, target_model, target_column, transform_type"
    e = f"e AS ({values(five, rows)}), n AS (SELECT source_model AS model, source_column AS col FROM e UNION SELECT target_model, target_column FROM e)"

    def kept(spark: SparkSession, d: str) -> DataFrame:
        folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
        edges = P.project_edges(spark, d)
        store.save(folder, "k", _models(spark), edges, {"n": 1})
        assert store.load(spark, folder, "other") is None
        return store.load(spark, folder, "k")[1].select(*five.split(", "))

    def results(spark: SparkSession, d: str) -> DataFrame:
        folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
        for n in (1, 2):
            row = [("m", "h", [], n, 0, [], [], [], ["c"])]
            store.save_results(folder, spark.createDataFrame(row, store.RESULTS))
        return store.load_results(spark, folder).select("unique_id", "sql_hash", F.col("columns_attempted").cast("long").alias("columns_attempted"))

    _add("store_edges", kept, f"WITH {e} SELECT * FROM e")
    _add("store_latest_results", results, "SELECT 'm' AS unique_id, 'h' AS sql_hash, 2::BIGINT AS columns_attempted")
    stats = "struct<models:array<string>,stats:struct<models:bigint,nodes:bigint,edges:bigint>>"
    _add("export_json", lambda spark, d: store.export_json(P.project_edges(spark, d)).select(F.from_json("json", stats).alias("j")).select("j.stats.*"), f"WITH {e} SELECT (SELECT count(DISTINCT model) FROM n) AS models, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
    _add("graph_frames", lambda spark, d: (lambda f: f[0].agg(F.count("*").alias("nodes")).crossJoin(f[1].agg(F.count("*").alias("edges"))))(G.frames(spark, P.project_edges(spark, d))), f"WITH {e} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")

    def report(part: str):
        def run(spark: SparkSession, d: str) -> DataFrame:
            found = R.trace_report(*G.trace(P.project_edges(spark, d), "mart_customers", "mean_order"))[part]
            return found.withColumn("columns", F.array_join("columns", ",")) if part == "roots" else found

        return run

    _add("trace_report_roots", report("roots"), values("model, columns", [("lineitem", "l_discount,l_extendedprice"), ("orders", "o_orderkey")]))
    _add("trace_report_types", report("types"), values("transform_type, cnt", [("passthrough", 2), ("function", 2), ("arithmetic", 2), ("aggregation", 1), ("rename", 1)]))
    _add("trace_report_statuses", report("statuses"), values("resolution_status, cnt", [("resolved", 8)]))
    _add("trace_report_renames", report("renames"), values("source_column, target_column", [("o_orderkey", "order_id")]))
    order = [("lineitem", "l_discount", "stg_lines", "net_price"), ("lineitem", "l_extendedprice", "stg_lines", "net_price"), ("stg_lines", "net_price", "order_totals", "net_total"), ("order_totals", "net_total", "orders_enriched", "net_total"), ("orders_enriched", "net_total", "mart_customers", "revenue")]
    numbered = lambda spark, d: spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(G.trace(P.project_edges(spark, d), "mart_customers", "revenue")[0].collect())], "place long, source_model string, source_column string, target_model string, target_column string")
    _add("graph_trace_order", numbered, values("place, source_model, source_column, target_model, target_column", [(i, *r) for i, r in enumerate(order)]))
    _add("report_timing", lambda spark, d: spark.createDataFrame([(n, s >= 0) for n, s in R.timed([("build", lambda: P.project(spark, d)), ("nothing", lambda: None)])], "stage string, measured boolean"), values("stage, measured", [("build", True), ("nothing", True)]))

    def counted(spark: SparkSession, d: str) -> DataFrame:
        s = P.project(spark, d)[1]
        return spark.createDataFrame([(s["total_models"], s["analyzed_models"], s["skipped_models"], s["failed_models"], s["columns_attempted"], s["columns_traced"], s["success_rate"], s["column_coverage"])], "total long, analyzed long, skipped long, failed long, attempted long, traced long, success_rate double, column_coverage double")

    n = len({(r[2], r[3]) for r in rows})
    _add("project_build_stats", counted, f"SELECT {len(expected)}::BIGINT AS total, {len(expected)}::BIGINT AS analyzed, 0::BIGINT AS skipped, 0::BIGINT AS failed, {n}::BIGINT AS attempted, {n}::BIGINT AS traced, 1.0::DOUBLE AS success_rate, 1.0::DOUBLE AS column_coverage")


def _statement(dialect: str | None, sql: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = analyze_sql(spark, sql, "m", SCHEMA, {}, dialect=dialect)
        return spark.createDataFrame([(e["source_model"], e["source_column"], e["target_column"], e["transform_type"]) for e in found.edges], "source_model string, source_column string, target_column string, transform_type string")

    return run


for _k, (_dialect, _sql, _edges) in enumerate(FOREIGN):
    if _edges is not None:
        _add(f"lineage_statement_{_k}", _statement(_dialect, _sql), values("source_model, source_column, target_column, transform_type", sorted(_edges)))


def _chain(spark: SparkSession, d: str) -> DataFrame:
    found = analyze_sql(spark, "WITH b AS (SELECT SUM(a) AS s FROM t1 GROUP BY id) SELECT ROUND(s) + 1 AS total FROM b", "m", SCHEMA, {})
    return spark.createDataFrame([(i, c["sql"], c["type"]) for e in found.edges for i, c in enumerate(e["transform_chain"])], "place long, sql string, type string")


_add("lineage_chain", _chain, values("place, sql, type", [(0, "SUM(a)", "aggregation"), (1, "ROUND(s) + 1", "arithmetic")]))


def _counters(spark: SparkSession, d: str) -> DataFrame:
    found = analyze_sql(spark, "SELECT id, t1.a AS x, nowhere.y AS y FROM t1 JOIN t2 ON t1.id = t2.id", "m", SCHEMA, {})
    return spark.createDataFrame([(",".join(found.output_columns), found.columns_attempted, found.columns_traced, ",".join(found.failed_columns), ",".join(found.ambiguous_columns), ",".join(found.unresolved_columns))], "names string, attempted long, traced long, failed string, ambiguous string, unresolved string")


_add("lineage_counters", _counters, values("names, attempted, traced, failed, ambiguous, unresolved", [("id,x,y", 3, 1, "id,y", "id", "y")]))
