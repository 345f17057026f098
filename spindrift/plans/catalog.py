"""Registered lineage queries and the DuckDB SQL that each is held against.

The graph queries run the operators over an edge table made from the foreign keys of the star schema (every row a
node: regions, nations, customers, suppliers, parts, orders, lines), the model queries run the sample project, and
the lineage queries give the edges of its models beside lists derived from their SQL by hand.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import graph as G
from spindrift.operators import reports as R
from spindrift.plans import artifact_queries
from spindrift.plans import sample_project as P
from spindrift.sources import artifacts, store

#: Edges by foreign key: source table, its key, target table, the target's key, the table that holds both.
KEYS = (
    ("region", "n_regionkey", "nation", "n_nationkey", "nation"),
    ("nation", "c_nationkey", "customer", "c_custkey", "customer"),
    ("nation", "s_nationkey", "supplier", "s_suppkey", "supplier"),
    ("customer", "o_custkey", "orders", "o_orderkey", "orders"),
    ("orders", "l_orderkey", "lineitem", "l_orderkey * 10 + l_linenumber", "lineitem"),
    ("part", "l_partkey", "lineitem", "l_orderkey * 10 + l_linenumber", "lineitem"),
    ("supplier", "l_suppkey", "lineitem", "l_orderkey * 10 + l_linenumber", "lineitem"),
)
TYPES = ("passthrough", "rename", "cast", "aggregation", "function")
_TYPE = "CASE CAST({0} AS BIGINT) % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table; a third of its edges is marked ambiguous by target key."""
    parts = []
    for source, a, target, b, table in KEYS:
        t = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        parts.append(t.selectExpr(f"'{source}' AS source_model", f"CAST({a} AS STRING) AS source_column", f"'{target}' AS target_model", f"CAST({b} AS STRING) AS target_column", f"{_TYPE.format(b)} AS transform_type", f"CASE WHEN CAST({b} AS BIGINT) % 3 = 0 THEN 'ambiguous' ELSE 'resolved' END AS resolution_status"))
    # lineitem repeats pairs of order and line number, so edges into lines can be repeated too
    return functools.reduce(DataFrame.union, parts)


EDGE_SQL = "e AS (" + " UNION ALL ".join(f"SELECT '{s}' AS source_model, CAST({a} AS VARCHAR) AS source_column, '{t}' AS target_model, CAST({b} AS VARCHAR) AS target_column, {_TYPE.format(b)} AS transform_type, CASE WHEN CAST({b} AS BIGINT) % 3 = 0 THEN 'ambiguous' ELSE 'resolved' END AS resolution_status FROM {f}" for s, a, t, b, f in KEYS) + ")"
NODE_SQL = "n AS (SELECT source_model AS model, source_column AS col FROM e UNION SELECT target_model, target_column FROM e)"
COLUMNS = "source_model, source_column, target_model, target_column, transform_type"

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def _graph(name: str, run, sql: str | None, more: str = "") -> None:
    """A query over the key edges; sql follows the edge table."""
    _add(name, lambda spark, d: run(key_edges(spark, d)), None if sql is None else f"WITH RECURSIVE {EDGE_SQL}, {NODE_SQL}{more} {sql}")


def _five(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS.split(", "))


UP = ", r(model, col) AS (SELECT 'orders', '1' UNION SELECT e.source_model, e.source_column FROM e JOIN r ON e.target_model = r.model AND e.target_column = r.col)"
DOWN = ", r(model, col) AS (SELECT 'nation', '3' UNION SELECT e.target_model, e.target_column FROM e JOIN r ON e.source_model = r.model AND e.source_column = r.col)"
INSIDE = f"SELECT {COLUMNS} FROM e WHERE (source_model, source_column) IN (SELECT (model, col) FROM r) AND (target_model, target_column) IN (SELECT (model, col) FROM r)"
_graph("graph_trace_edges", lambda e: _five(G.trace(e, "orders", "1")[0]), INSIDE, UP)
_graph("graph_trace_roots", lambda e: G.trace(e, "ORDERS", "1")[1], "SELECT model, col AS \"column\" FROM r WHERE (model, col) NOT IN (SELECT (target_model, target_column) FROM e)", UP)
_graph("graph_impact_edges", lambda e: _five(G.impact(e, "nation", "3")[0]), INSIDE, DOWN)
_graph("graph_impact_columns", lambda e: G.impact(e, "nation", "3")[1], "SELECT model, col AS \"column\" FROM r WHERE model <> 'nation'", DOWN)
_graph("graph_edges_between", lambda e: _five(G.edges_between(e, "nation", "customer")), f"SELECT {COLUMNS} FROM e WHERE source_model = 'nation' AND target_model = 'customer'")
_graph("graph_model_dependencies", lambda e: G.model_dependencies(e, "lineitem"), "SELECT DISTINCT source_model AS model FROM e WHERE target_model = 'lineitem' AND source_model <> 'lineitem'")
_graph("graph_all_models", G.all_models, "SELECT DISTINCT model FROM n")
_graph("graph_all_columns", lambda e: G.all_columns(e, "nation"), "SELECT DISTINCT col AS \"column\" FROM n WHERE model = 'nation'")
_graph("graph_search_columns", lambda e: G.search_columns(e, "99"), "SELECT model, col AS \"column\" FROM n WHERE contains(lower(col), '99')")
_graph("graph_transforms_by_type", lambda e: _five(G.transforms_by_type(e, "cast")), f"SELECT {COLUMNS} FROM e WHERE transform_type = 'cast'")
_graph("graph_stats", G.stats, "SELECT (SELECT count(DISTINCT model) FROM n) AS models, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
_graph("graph_resolve", lambda e: e.sparkSession.createDataFrame([G.resolve(e, "Nation", "7")], "model string, `column` string"), "SELECT model, col AS \"column\" FROM n WHERE lower(model) = 'nation' AND col = '7'")
_MODEL_EDGES = ", m AS (SELECT DISTINCT source_model, target_model FROM e), l(node, lvl) AS (SELECT DISTINCT model, 0 FROM n UNION ALL SELECT m.target_model, l.lvl + 1 FROM m JOIN l ON m.source_model = l.node)"


def _model_graph(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    pairs = e.select(F.col("source_model").alias("src"), F.col("target_model").alias("dst")).distinct()
    return pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct(), pairs


_graph("graph_levels", lambda e: G.levels(*_model_graph(e)), "SELECT node, max(lvl) AS level FROM l GROUP BY node", _MODEL_EDGES)
_graph("graph_topological", lambda e: G.topological(*_model_graph(e)), "SELECT node, row_number() OVER (ORDER BY max(lvl), node) AS rank FROM l GROUP BY node", _MODEL_EDGES)


def _row_levels(e: DataFrame) -> DataFrame:
    g = G.as_graph(e).select("src", "dst")
    nodes = g.select(F.col("src").alias("node")).union(g.select("dst"))
    return G.levels(nodes, g).groupBy("level").agg(F.count("*").alias("n"))


_graph("graph_row_levels", _row_levels, "SELECT lvl AS level, count(*) AS n FROM (SELECT node, max(lvl) AS lvl FROM l GROUP BY node) GROUP BY lvl", ", s AS (SELECT source_model || ':' || source_column AS a, target_model || ':' || target_column AS b FROM e), l(node, lvl) AS (SELECT DISTINCT model || ':' || col, 0 FROM n WHERE (model, col) NOT IN (SELECT (target_model, target_column) FROM e) UNION SELECT s.b, l.lvl + 1 FROM s JOIN l ON s.a = l.node)")


_PAIRS = ", p AS (SELECT source_model, target_model, transform_type, count(*) AS n FROM e WHERE source_model <> target_model GROUP BY ALL), q AS (SELECT source_model, target_model, sum(n)::BIGINT AS cnt, arg_min(transform_type, (-n, transform_type)) AS dominant FROM p GROUP BY ALL)"
_graph("report_transform_breakdown", R.transform_breakdown, "SELECT transform_type, count(*) AS cnt FROM e GROUP BY 1")
_graph("report_transform_bars", R.transform_bars, "SELECT transform_type, cnt, round(cnt / sum(cnt) OVER () * 100, 1) AS percent, repeat('#', floor(cnt / sum(cnt) OVER () * 40)::INT) AS bar FROM (SELECT transform_type, count(*) AS cnt FROM e GROUP BY 1)")
_graph("report_top_models", R.top_models, "SELECT target_model, count(*) AS cnt FROM e GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 20")
_graph("report_sample", lambda e: _five(R.sample_edges(e)), f"SELECT {COLUMNS} FROM e ORDER BY target_model, target_column, source_model, source_column LIMIT 20")
_graph("report_inbound", lambda e: _five(R.inbound(e, "Nation")), f"SELECT {COLUMNS} FROM e WHERE target_model = 'nation'")
_graph("report_outbound", lambda e: _five(R.outbound(e, "NATION")), f"SELECT {COLUMNS} FROM e WHERE source_model = 'nation' ORDER BY target_model, target_column, source_model, source_column LIMIT 30")
_graph("report_find_columns", lambda e: R.find_columns(e, "12"), "SELECT DISTINCT target_model, target_column FROM e WHERE lower(target_column) = '12' ORDER BY ALL LIMIT 30")
_graph("report_model_rollup", lambda e: R.model_rollup(e).select("source_model", "target_model", "cnt", "dominant", *(F.coalesce(F.col("types")[t], F.lit(0)).alias(f"n_{t}") for t in TYPES)), "SELECT q.*, " + ", ".join(f"coalesce((SELECT n FROM p WHERE p.source_model = q.source_model AND p.target_model = q.target_model AND transform_type = '{t}'), 0) AS n_{t}" for t in TYPES) + " FROM q", _PAIRS)
_graph("report_degrees", R.degrees, "SELECT model, count(*) FILTER (d = 'i') AS in_degree, count(*) FILTER (d = 'o') AS out_degree, count(*) AS degree FROM (SELECT source_model AS model, 'o' AS d FROM q UNION ALL SELECT target_model, 'i' FROM q) GROUP BY 1", _PAIRS)
_graph("report_pair_stats", R.pair_stats, "SELECT (SELECT count(DISTINCT m) FROM (SELECT source_model AS m FROM q UNION ALL SELECT target_model FROM q)) AS models, count(*) AS connections, sum(cnt)::BIGINT AS column_edges FROM q", _PAIRS)
_text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["name"], x["cnt"].cast("string"))), ",")
_graph("report_neighbours", lambda e: R.neighbours(e).select("model", _text("up").alias("up"), _text("down").alias("down")), "SELECT model, coalesce((SELECT string_agg(source_model || ':' || cnt, ',' ORDER BY cnt DESC, source_model) FROM q WHERE target_model = model), '') AS up, coalesce((SELECT string_agg(target_model || ':' || cnt, ',' ORDER BY cnt DESC, target_model) FROM q WHERE source_model = model), '') AS down FROM (SELECT DISTINCT model FROM n)", _PAIRS)
_graph("report_connected_pair", R.connected_pair, "SELECT DISTINCT source_model, target_model FROM e WHERE source_model <> target_model ORDER BY ALL LIMIT 1")


def _closure_sizes(e: DataFrame) -> DataFrame:
    sizes = G.all_pairs(G.as_graph(e).select("src", "dst")).groupBy("start").agg(F.count("*").alias("n"))
    return sizes.select(F.split("start", "\x1f")[0].alias("model"), F.split("start", "\x1f")[1].alias("column"), "n")


def _to_x(e: DataFrame) -> DataFrame:
    """Every edge with its target column as order and x in its place, so that edges meet."""
    return e.withColumn("ord", F.col("target_column").cast("long")).withColumn("target_column", F.lit("x"))


_EDGE_KEY = ["source_model", "source_column", "target_model", "target_column"]
_graph("graph_closure_sizes", _closure_sizes, "SELECT m AS model, k AS \"column\", count(*) AS n FROM c GROUP BY m, k", ", c(m, k, model, col) AS (SELECT source_model, source_column, target_model, target_column FROM e UNION SELECT c.m, c.k, e.target_model, e.target_column FROM e JOIN c ON e.source_model = c.model AND e.source_column = c.col)")
_graph("report_grouped_by_source", lambda e: R.grouped_edges(e, "source_model"), "SELECT e.source_model, g.n AS group_size, target_model, target_column, source_column, transform_type FROM e JOIN (SELECT source_model, count(*) AS n FROM e GROUP BY 1) g USING (source_model)")
_graph("report_resolution", R.resolution_breakdown, "SELECT resolution_status, count(*) AS cnt FROM t GROUP BY 1", ", t(target_model, target_column, m, c, source_model, source_column, resolution_status) AS (SELECT target_model, target_column, target_model, target_column, source_model, source_column, resolution_status FROM e UNION SELECT t.target_model, t.target_column, e.target_model, e.target_column, e.source_model, e.source_column, e.resolution_status FROM e JOIN t ON e.target_model = t.source_model AND e.target_column = t.source_column)")
_graph("report_labels", lambda e: R.labels(e.withColumn("transform_sql", F.concat(F.lit("t."), "source_column"))).select(*_EDGE_KEY, "label", "note", "shown"), f"SELECT {', '.join(_EDGE_KEY)}, CASE WHEN transform_type IN ('passthrough', 'rename') AND lower(source_column) <> lower(target_column) THEN 'rename: ' || source_column || ' -> ' || target_column ELSE transform_type END AS label, CASE WHEN resolution_status <> 'resolved' THEN '[' || resolution_status || ']' ELSE '' END AS note, '' AS shown FROM e")
_graph("edges_first_wins", lambda e: _five(G.first_wins(_to_x(e), _EDGE_KEY, "ord")), "SELECT source_model, source_column, target_model, 'x' AS target_column, arg_min(transform_type, target_column::BIGINT) AS transform_type FROM e GROUP BY 1, 2, 3")
_graph("edges_merged", lambda e: _five(G.merged(_to_x(e))), "SELECT source_model, source_column, target_model, 'x' AS target_column, arg_max(transform_type, (CASE transform_type WHEN 'aggregation' THEN 7 WHEN 'cast' THEN 4 WHEN 'function' THEN 3 WHEN 'rename' THEN 2 ELSE 0 END, target_column::BIGINT)) AS transform_type FROM e GROUP BY 1, 2, 3")


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as if they were models: brands as names, a source for each small size."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("model.p."), F.col("p_partkey").cast("string")).alias("unique_id"), F.concat(F.element_at(F.array(*map(F.lit, (*artifacts.LAYERS, "x"))), (F.col("p_partkey") % 8 + 1).cast("int")), F.lit("_"), F.lower("p_brand")).alias("name"),
        F.lower("p_brand").alias("short_name"), F.when(F.col("p_size") < 10, "source").otherwise("model").alias("resource_type"), F.lit("db").alias("database"), F.element_at(F.split("p_type", " "), 1).alias("schema_name"),
        F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("SELECT {{ x }} FROM "), "p_name")).alias("compiled_sql"),
    )


_MODEL_SQL = "WITH m AS (SELECT p_partkey AS ord, 'model.p.' || p_partkey AS unique_id, (['base', 'stg', 'int', 'fct', 'dim', 'rep', 'mart', 'x'])[p_partkey % 8 + 1] || '_' || lower(p_brand) AS name, lower(p_brand) AS short_name, CASE WHEN p_size < 10 THEN 'source' ELSE 'model' END AS resource_type, 'db' AS database, split_part(p_type, ' ', 1) AS schema_name, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'SELECT {{ x }} FROM ' || p_name END AS compiled_sql FROM part)"


def _meta(name: str, run, sql: str) -> None:
    _add(name, lambda spark, d: run(_models(spark, d)), f"{_MODEL_SQL} {sql}")


_meta("meta_collisions", lambda m: artifacts.name_collisions(m).select("name", "n", F.get("unique_ids", F.lit(0)).alias("first_id")), "SELECT name, count(*) AS n, min(unique_id) AS first_id FROM m GROUP BY name HAVING count(*) > 1")
_meta("meta_table_lookup", artifacts.table_lookup, "SELECT form, arg_max(name, ord) AS canonical FROM (SELECT lower(short_name) AS form, name, ord FROM m UNION ALL SELECT lower(schema_name || '.' || short_name), name, ord FROM m UNION ALL SELECT lower(database || '.' || schema_name || '.' || short_name), name, ord FROM m UNION ALL SELECT lower(name), name, ord FROM m) GROUP BY form")
_meta("meta_layers", lambda m: m.groupBy(artifacts.layer(F.col("name"), F.col("resource_type")).alias("layer")).agg(F.count("*").alias("n")), "SELECT CASE WHEN resource_type = 'source' THEN 'source' WHEN split_part(name, '_', 1) = 'x' THEN 'other' ELSE split_part(name, '_', 1) END AS layer, count(*) AS n FROM m GROUP BY 1")
_meta("meta_sql_hash", lambda m: m.select("unique_id", store.sql_hash(F.col("compiled_sql")).alias("sql_hash")), "SELECT unique_id, substr(sha1(compiled_sql), 1, 20) AS sql_hash FROM m")
_meta("meta_analyzable", lambda m: artifacts.analyzable(m).groupBy("templated").agg(F.count("*").alias("n")), "SELECT contains(compiled_sql, '{{') AS templated, count(*) AS n FROM m WHERE resource_type <> 'source' AND trim(compiled_sql) <> '' GROUP BY 1")
_meta("meta_suggestions", lambda m: artifacts.suggestions(m, "stg_br"), "SELECT DISTINCT name FROM m WHERE contains(name, 'stg_br') OR contains('stg_br', name) OR starts_with(name, 'stg_br') ORDER BY name LIMIT 8")
_meta("meta_first_filled", lambda m: m.select("unique_id", artifacts.first_filled(F.col("compiled_sql"), F.lit(None).cast("string"), F.col("name")).alias("sql")), "SELECT unique_id, coalesce(nullif(compiled_sql, ''), nullif(name, ''), '') AS sql FROM m")
_meta("meta_list_models", R.list_models, "SELECT name, resource_type FROM m ORDER BY ALL LIMIT 50")
_meta("meta_work_list", lambda m: store.work_list(m.select("unique_id", store.sql_hash(F.col("compiled_sql")).alias("sql_hash")), m.filter("ord % 3 = 0").select("unique_id", store.sql_hash(F.col("compiled_sql")).alias("sql_hash"))).select("unique_id"), "SELECT unique_id FROM m WHERE ord % 3 <> 0")


def _success(m: DataFrame) -> DataFrame:
    row = m.agg(F.count("*").alias("total"), F.count_if(F.col("resource_type") == "source").alias("skipped"), F.count_if((F.col("resource_type") != "source") & (F.col("compiled_sql") != "")).alias("analyzed"))
    rate, coverage = R.success(F.col("total"), F.col("skipped"), F.col("analyzed"), F.lit(0), F.lit(0))
    return row.select("total", "skipped", "analyzed", rate.alias("success_rate"), coverage.alias("column_coverage"))


_meta("meta_build_stats", _success, "SELECT count(*) AS total, count(*) FILTER (resource_type = 'source') AS skipped, count(*) FILTER (resource_type <> 'source' AND compiled_sql <> '') AS analyzed, round(analyzed / (total - skipped), 3) AS success_rate, 1.0::DOUBLE AS column_coverage FROM m")
_add("report_counts", lambda spark, d: R.counts(_models(spark, d), key_edges(spark, d)), f"WITH {EDGE_SQL} SELECT (SELECT count(*) FROM part) AS models, count(*) AS edges, count(DISTINCT target_column) AS target_columns, count(DISTINCT target_model) AS target_models FROM e")


def _select_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders depend on customers, those on nations, those on regions: the selection of one order."""
    rows = [spark.read.parquet(f"{sf_dir}/{t}.parquet").selectExpr(f"concat('{t}.', {k}) AS unique_id", f"concat('{t}_', {k}) AS name", f"array({up}) AS depends_on") for t, k, up in (("region", "r_regionkey", "cast(null as string)"), ("nation", "n_nationkey", "concat('region.', n_regionkey)"), ("customer", "c_custkey", "concat('nation.', c_nationkey)"), ("orders", "o_orderkey", "concat('customer.', o_custkey)"))]
    return artifacts.selected(functools.reduce(DataFrame.union, rows), "+ORDERS_1,orders_2+").select("name")


_add("meta_selection", _select_models, "WITH o AS (SELECT * FROM orders WHERE o_orderkey IN (1, 2)), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)) SELECT 'orders_' || o_orderkey AS name FROM o UNION SELECT 'customer_' || c_custkey FROM c UNION SELECT 'nation_' || n_nationkey FROM n UNION SELECT 'region_' || n_regionkey FROM n")
_CHAIN = "array(named_struct('step', 'a', 'sql', 'a', 'type', 'passthrough'), named_struct('step', 'b', 'sql', 'b', 'type', {t}), named_struct('step', 'c', 'sql', 'c', 'type', 'rename'))"
_graph("report_chain_steps", lambda e: e.withColumn("chain", F.expr(_CHAIN.format(t="transform_type"))).select(*_EDGE_KEY, F.size(R.chain_steps(F.col("chain"))).cast("long").alias("n_steps"), F.get(R.chain_steps(F.col("chain")), F.lit(0))["step"].alias("first_step")), f"SELECT {', '.join(_EDGE_KEY)}, CASE WHEN transform_type = 'passthrough' THEN 1 ELSE 2 END::BIGINT AS n_steps, CASE WHEN transform_type = 'passthrough' THEN 'c' ELSE 'b' END AS first_step FROM e")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = key_edges(spark, sf_dir)
    found = e.filter("target_model = 'lineitem'").groupBy(F.col("target_model").alias("model"), F.col("target_column").alias("column")).agg(F.count("*").alias("n_sources"), F.collect_set("resolution_status").alias("statuses"))
    cases = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("'lineitem' AS model", "cast(l_orderkey * 10 + l_linenumber AS string) AS `column`", "2L AS min_sources", "3L AS max_sources", "array('resolved') AS statuses")
    return R.known_cases(found, cases.distinct()).groupBy("ok").agg(F.count("*").alias("n"))


_add("report_known_cases", _known, f"WITH {EDGE_SQL} SELECT n BETWEEN 2 AND 3 AND s = 0 AS ok, count(*) AS n FROM (SELECT target_column, count(*) AS n, count(*) FILTER (resolution_status <> 'resolved') AS s FROM e WHERE target_model = 'lineitem' GROUP BY 1) GROUP BY 1")
_add("report_determinism", lambda spark, d: spark.createDataFrame([(R.same_rows(G.trace(key_edges(spark, d), "orders", "1")[0], G.trace(key_edges(spark, d), "orders", "1")[0]),)], "same boolean"), "SELECT true AS same")

#: Edges of the sample models, derived from their SQL by hand: source model, source column, target column, type.
EXPECTED = {
    "stg_customers": "customer.c_custkey customer_id rename; customer.c_name customer_name rename; customer.c_nationkey nation_id rename; customer.c_acctbal balance cast",
    "stg_orders": "orders.o_orderkey order_id rename; orders.o_custkey customer_id rename; orders.o_orderstatus o_orderstatus passthrough; orders.o_totalprice o_totalprice passthrough; orders.o_orderdate o_orderdate passthrough",
    "stg_lines": "lineitem.l_orderkey order_id rename; lineitem.l_linenumber l_linenumber passthrough; lineitem.l_suppkey supplier_id rename; lineitem.l_extendedprice net_price arithmetic; lineitem.l_discount net_price arithmetic; lineitem.l_quantity l_quantity passthrough",
    "nations": "nation.n_nationkey nation_id rename; nation.n_name nation_name rename; region.r_name region_name rename",
    "order_totals": "stg_lines.order_id order_id passthrough; stg_lines.net_price net_total aggregation; stg_lines.l_quantity quantity aggregation; __literal__.COUNT(*) n_lines literal",
    "orders_enriched": "stg_orders.order_id order_id passthrough; stg_orders.customer_id customer_id passthrough; stg_orders.o_orderstatus is_finished conditional; order_totals.net_total net_total passthrough; stg_orders.o_orderstatus status function",
    "customer_orders": "stg_orders.customer_id customer_id passthrough; stg_orders.order_id order_id passthrough; stg_orders.customer_id order_sequence window; stg_orders.o_orderdate order_sequence window; stg_orders.order_id order_sequence window",
    "first_orders": "stg_orders.customer_id customer_id passthrough; stg_orders.order_id order_id passthrough; stg_orders.o_totalprice o_totalprice passthrough",
    "parties": "customer.c_name party_name rename; supplier.s_name party_name rename; customer.c_acctbal balance rename; supplier.s_acctbal balance rename",
    "customers_all": "stg_customers.customer_id customer_id passthrough; stg_customers.customer_name customer_name passthrough; stg_customers.nation_id nation_id passthrough; stg_customers.balance balance passthrough",
    "customers_public": "stg_customers.customer_id customer_id passthrough; stg_customers.customer_name customer_name passthrough; stg_customers.nation_id nation_id passthrough",
    "big_orders": "stg_orders.order_id order_id passthrough; stg_orders.o_totalprice total aggregation",
    "price_bands": "part.p_partkey part_id rename; part.p_retailprice price rename; __literal__.'EUR' currency literal",
    "mart_customers": "stg_customers.customer_id customer_id passthrough; stg_customers.customer_name name rename; nations.region_name region_name passthrough; orders_enriched.net_total revenue function; orders_enriched.net_total mean_order function; orders_enriched.order_id mean_order function",
}


def _expected_rows(model: str) -> str:
    rows = []
    for part in EXPECTED[model].split("; "):
        source, target, kind = part.rsplit(" ", 2)
        table, column = source.split(".", 1)
        rows.append("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (table, column, target, kind)) + ")")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(source_model, source_column, target_column, transform_type)"


for _name, _, _ in P.MODELS:
    _add(f"lineage_{_name}", lambda spark, d, n=_name: P.project_edges(spark, d).filter(F.col("target_model") == n).select("source_model", "source_column", "target_column", "transform_type"), _expected_rows(_name))
    _add(f"model_{_name}", lambda spark, d, n=_name: P.run_model(spark, d, n), P.model_sql(_name))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base columns of the mart's revenue, traced over the sample project."""
    return G.trace(P.project_edges(spark, sf_dir), "mart_customers", "revenue")[1]


_add("lineage_trace_revenue", flagship, "SELECT * FROM (VALUES ('lineitem', 'l_extendedprice'), ('lineitem', 'l_discount')) t(model, \"column\")")
_add("lineage_impact_discount", lambda spark, d: G.impact(P.project_edges(spark, d), "lineitem", "l_discount")[1], "SELECT * FROM (VALUES ('stg_lines', 'net_price'), ('order_totals', 'net_total'), ('orders_enriched', 'net_total'), ('mart_customers', 'revenue'), ('mart_customers', 'mean_order')) t(model, \"column\")")

artifact_queries.over_sample(EXPECTED)
QUERIES |= artifact_queries.QUERIES
ORACLE_SQL |= artifact_queries.ORACLE_SQL
