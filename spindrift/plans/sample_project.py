"""A small project over the star-schema tables: models as SQL, used by queries, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.dialect import qualify_to_filter
from spindrift.plans.build import build
from spindrift.sources.store import EDGES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Models in dependency order: name, what it reads, SQL (also valid in DuckDB).
MODELS: list[tuple[str, tuple[str, ...], str]] = [
    ("stg_customers", ("customer",), "SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey AS nation_id, CAST(c_acctbal AS DOUBLE) AS balance FROM customer"),
    ("stg_orders", ("orders",), "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, o_totalprice, o_orderdate FROM orders"),
    ("stg_lines", ("lineitem",), "SELECT l_orderkey AS order_id, l_linenumber, l_suppkey AS supplier_id, l_extendedprice * (1 - l_discount) AS net_price, l_quantity FROM lineitem"),
    ("nations", ("nation", "region"), "SELECT n.n_nationkey AS nation_id, n.n_name AS nation_name, r.r_name AS region_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"),
    ("order_totals", ("stg_lines",), "WITH lines AS (SELECT order_id, net_price, l_quantity FROM stg_lines), summed AS (SELECT order_id, SUM(net_price) AS net_total, SUM(l_quantity) AS quantity, COUNT(*) AS n_lines FROM lines GROUP BY order_id) SELECT order_id, net_total, quantity, n_lines FROM summed"),
    ("orders_enriched", ("stg_orders", "order_totals"), "SELECT o.order_id, o.customer_id, CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_finished, t.net_total, LOWER(o.o_orderstatus) AS status FROM stg_orders o LEFT JOIN order_totals t ON o.order_id = t.order_id"),
    ("customer_orders", ("stg_orders",), "SELECT customer_id, order_id, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY o_orderdate, order_id) AS order_sequence FROM stg_orders"),
    ("first_orders", ("stg_orders",), "SELECT customer_id, order_id, o_totalprice FROM stg_orders QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY o_orderdate, order_id) = 1"),
    ("parties", ("customer", "supplier"), "SELECT c_name AS party_name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier"),
    ("customers_all", ("stg_customers",), "SELECT * FROM stg_customers"),
    ("customers_public", ("stg_customers",), "SELECT * EXCEPT (balance) FROM stg_customers"),
    ("big_orders", ("stg_orders",), "SELECT s.order_id, s.total FROM (SELECT order_id, MAX(o_totalprice) AS total FROM stg_orders GROUP BY order_id) s WHERE s.total > 1000"),
    ("price_bands", ("part",), "WITH bands AS (SELECT p_partkey AS part_id, p_retailprice FROM part), part AS (SELECT part_id, p_retailprice AS price, 'EUR' AS currency FROM bands) SELECT part_id, price, currency FROM part"),
    ("mart_customers", ("stg_customers", "nations", "orders_enriched"), "SELECT c.customer_id, c.customer_name AS name, n.region_name, COALESCE(SUM(o.net_total), 0) AS revenue, ROUND(SUM(o.net_total) / COUNT(o.order_id), 2) AS mean_order FROM stg_customers c JOIN nations n ON c.nation_id = n.nation_id LEFT JOIN orders_enriched o ON o.customer_id = c.customer_id GROUP BY c.customer_id, c.customer_name, n.region_name"),
]

#: Columns that hold sums of numbers with four places, whose last digits depend on the order of adding: results show four.
SUMS = {"order_totals": ("net_total", "quantity"), "orders_enriched": ("net_total",), "mart_customers": ("revenue", "mean_order")}


def project(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None) -> tuple[list[dict], dict]:
    """(edges, stats) of the sample models, with the schemas of the Parquet tables as catalog."""
    rows = [{"unique_id": f"model.sample.{n}", "name": n, "resource_type": "model", "compiled_sql": q, "depends_on": [f"model.sample.{d}" for d in deps]} for n, deps, q in MODELS if only is None or n in only]
    schemas = {t: {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{sf_dir}/{t}.parquet").schema} for t in TABLES}
    lookup = {n: n for n in (*TABLES, *(m[0] for m in MODELS))}
    return build(spark, rows, schemas, lookup)[:2]


def project_edges(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """Edges of the sample models, without duplicates."""
    fields = [x.split(" ")[0] for x in EDGES.split(", ")]
    return spark.createDataFrame([tuple(e[f] for f in fields) for e in project(spark, sf_dir, only)[0]], EDGES)


def run_model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run one model on the tables; the models it reads become views with its queries in them."""
    known = {n: (deps, q) for n, deps, q in MODELS}

    def make(n: str) -> None:
        if n in known:
            for d in known[n][0]:
                make(d)
            spark.sql(qualify_to_filter(known[n][1])).createOrReplaceTempView(n)
        else:
            spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)

    make(name)
    out = spark.table(name)
    return out.withColumns({c: F.round(c, 4) for c in SUMS.get(name, ())}) if name in SUMS else out


def model_sql(name: str) -> str:
    """The same model as one DuckDB query."""
    known = {n: (deps, q) for n, deps, q in MODELS}
    order: list[str] = []

    def need(n: str) -> None:
        for d in known[n][0]:
            if d in known:
                need(d)
        if n not in order:
            order.append(n)

    need(name)
    shown = f" REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in SUMS[name])})" if name in SUMS else ""
    return "WITH " + ", ".join(f"{n} AS ({known[n][1].replace('EXCEPT (', 'EXCLUDE (')})" for n in order) + f" SELECT *{shown} FROM {name}"
