"""Statements in the words of other systems, with the edges derived from them by hand: used by queries and tests."""

from __future__ import annotations

#: Schemas of the known tables; x, y and t are unknown.
SCHEMA = {"stg_orders": {"order_id": "INT", "status": "TEXT", "contact.active": "BOOL"}, "t1": {"id": "INT", "a": "INT"}, "t2": {"id": "INT", "c": "INT"}}


def e(*rows: str) -> set[tuple[str, ...]]:
    """Edges from lines of source model, source column, target column, type."""
    return {tuple(r.split()) for r in rows}


#: Dialect, statement, edges; no set of edges: the statement must only be parsed.
FOREIGN = [
    ("postgres", "SELECT a::varchar AS b, c::numeric(10, 2) AS d, f::timestamptz AS g, h::my_enum AS i, j::text[] AS k FROM x", e("x a b cast", "x c d cast", "x f g cast", "x h i cast", "x j k cast")),
    ("postgres", "SELECT CAST(a AS VARCHAR) AS b, CAST(c AS character varying(5)) AS d, CAST(f AS double precision) AS g FROM x", e("x a b cast", "x c d cast", "x f g cast")),
    ("snowflake", "SELECT CAST(a AS NUMBER(38, 0)) AS b, c::NUMBER AS d, f::TIMESTAMP_TZ AS g FROM x", e("x a b cast", "x c d cast", "x f g cast")),
    ("postgres", "SELECT (x.a AT TIME ZONE 'UTC') AS b, c FROM x", e("x a b function", "x c c passthrough")),
    ("snowflake", "SELECT * EXCLUDE (status) FROM stg_orders", e("stg_orders order_id order_id passthrough")),
    ("duckdb", "SELECT * EXCLUDE status FROM stg_orders", e("stg_orders order_id order_id passthrough")),
    ("bigquery", "SELECT * REPLACE (UPPER(status) AS status) FROM stg_orders", e("stg_orders order_id order_id passthrough", "stg_orders status status function")),
    ("snowflake", "SELECT o.* RENAME (status AS state) FROM stg_orders o", e("stg_orders order_id order_id passthrough", "stg_orders status state rename")),
    ("bigquery", "SELECT t.a, item AS thing FROM t, UNNEST(t.items) AS item", e("t a a passthrough", "t items thing function")),
    ("bigquery", "SELECT t.a, item, o FROM t CROSS JOIN UNNEST(t.items) AS item WITH OFFSET AS o", e("t a a passthrough", "t items item function", "t items o function")),
    ("postgres", "SELECT a, unnest(b) AS c FROM x", e("x a a passthrough", "x b c function")),
    ("snowflake", "SELECT t.a, f.value::string AS v FROM t, LATERAL FLATTEN(input => t.items, outer => true) f", e("t a a passthrough", "t items v cast")),
    ("snowflake", "SELECT src:user.name::varchar AS n, a FROM x", e("x src n cast", "x a a passthrough")),
    ("postgres", "SELECT a ->> 'k' AS b, x.c -> 'd' ->> 'e' AS f FROM x", e("x a b function", "x c f function")),
    ("postgres", "SELECT a ~ '^z' AS b, c !~* 'q' AS d FROM x", e("x a b complex", "x c d complex")),
    ("postgres", "WITH q AS MATERIALIZED (SELECT a FROM x), r AS NOT MATERIALIZED (SELECT b FROM y) SELECT a, b FROM q, r", e("x a a passthrough", "y b b passthrough")),
    ("tsql", "SELECT TOP 10 [a], [b c] AS d FROM [x]", e("x a a passthrough") | {("x", "b c", "d", "rename")}),
    ("tsql", "SELECT TOP (5) PERCENT CONVERT(varchar(10), a, 120) AS b FROM x ORDER BY a OFFSET 5 ROWS FETCH NEXT 10 ROWS ONLY", e("x a b cast")),
    ("mysql", "SELECT a FROM x LIMIT 5, 10", e("x a a passthrough")),
    ("bigquery", "SELECT a, ARRAY(SELECT b FROM y) AS c FROM x", e("x a a passthrough", "y b c complex")),
    ("snowflake", "SELECT $1 AS a FROM x", e("x $1 a rename")),
    ("bigquery", "SELECT a FROM x FOR SYSTEM_TIME AS OF TIMESTAMP_SUB(CURRENT_TIMESTAMP(), INTERVAL 1 HOUR) WHERE a > 1", e("x a a passthrough")),
    ("postgres", "SELECT DISTINCT ON (a) a, b FROM x ORDER BY a, c", e("x a a passthrough", "x b b passthrough")),
    (None, "SELECT a, current_date AS d, current_timestamp AS t FROM x", e("x a a passthrough", "__literal__ current_date d literal", "__literal__ current_timestamp t literal")),
    ("bigquery", "SELECT DATE_DIFF(a, b, DAY) AS d FROM x", e("x a d function", "x b d function")),
    (None, "SELECT id, a FROM t1 LEFT SEMI JOIN t2 ON t1.id = t2.id", e("t1 id id passthrough", "t1 a a passthrough")),
    (None, "SELECT id FROM t1 LEFT ANTI JOIN t2 ON t1.id = t2.id", e("t1 id id passthrough")),
    (None, "SELECT EXISTS (SELECT 1 FROM t2 WHERE t2.id = t1.id) AS f FROM t1", e("t2 id f complex", "t1 id f complex")),
    (None, "SELECT a IN (SELECT c FROM t2) AS f FROM t1", e("t1 a f complex", "t2 c f complex")),
    (None, "SELECT * FROM stg_orders PIVOT (SUM(order_id) FOR status IN ('A' AS a, 'B' AS b))", e("stg_orders order_id a aggregation", "stg_orders order_id b aggregation")),
    (None, "SELECT t1.a.b AS c FROM t1", e("t1 a c complex")),
    (None, "SELECT id FROM t1 INTERSECT SELECT id FROM t2", e("t1 id id passthrough", "t2 id id passthrough")),
    # nothing traced, one known table: its columns pass
    (None, "SELECT * FROM (SELECT u.* FROM (SELECT array_agg(s)[0] AS u FROM stg_orders s GROUP BY order_id))", e("stg_orders order_id order_id passthrough", "stg_orders status status passthrough")),
    (None, "SELECT t1.*, t2.c FROM t1 JOIN t2 ON t1.id = t2.id", e("t1 id id passthrough", "t1 a a passthrough", "t2 c c passthrough")),
    (None, "SELECT a FROM x WHERE a > 1 ORDER BY a DESC LIMIT 5", e("x a a passthrough")),
    (None, "SELECT a FROM x EXCEPT SELECT b FROM y", e("x a a passthrough", "y b a rename")),
    (None, "SELECT 1 AS one, 'z' AS z, NULL AS n FROM x", e("__literal__ 1 one literal", "__literal__ 'z' z literal", "__literal__ NULL n literal")),
    ("bigquery", "SELECT u.status AS s FROM (SELECT array_agg(o ORDER BY order_id DESC LIMIT 1)[OFFSET(0)] AS u FROM stg_orders o GROUP BY order_id)", None),
]
