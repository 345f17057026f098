"""The lineage store: Parquet tables in one folder, with results per model for incremental builds."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHAIN = "array<struct<step:string,sql:string,type:string>>"
EDGES = f"source_model string, source_column string, target_model string, target_column string, transform_type string, transform_sql string, transform_chain {CHAIN}, model_unique_id string, resolution_status string"
RESULTS = f"unique_id string, sql_hash string, edges array<struct<{', '.join(x.replace(' ', ':', 1) for x in EDGES.split(', '))}>>, columns_attempted int, columns_traced int, failed_columns array<string>, ambiguous_columns array<string>, unresolved_columns array<string>, output_columns array<string>"


def project_key(*parts: bytes | str | None) -> str:
    """SHA-256 over what a build depends on: manifest, catalog, dialect, selection."""
    h = hashlib.sha256()
    for p in parts:
        raw = p if isinstance(p, bytes) else (p or "").encode()
        h.update(len(raw).to_bytes(8, "little") + raw)
    return h.hexdigest()


def sql_hash(sql: Column) -> Column:
    """The first 20 hex digits of the SHA-1."""
    return F.substring(F.sha1(sql), 1, 20)


def save(folder: str, key: str, models: DataFrame, edges: DataFrame, stats: dict) -> None:
    """Replace the tables meta, models and edges. Edges are sorted by target, so that reads of a target skip most of them."""
    spark = edges.sparkSession
    models.write.mode("overwrite").parquet(f"{folder}/models")
    edges.repartitionByRange("target_model", "target_column").sortWithinPartitions("target_model", "target_column").write.mode("overwrite").parquet(f"{folder}/edges")
    # the key is written last: a store without it, or with another, counts as absent
    spark.createDataFrame([(key, json.dumps(stats))], "key string, stats string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def load(spark: SparkSession, folder: str, key: str) -> tuple[DataFrame, DataFrame, dict] | None:
    """(models, edges, stats), or None if the store is missing, unreadable or of another key.

    Edges of an older form lack a status; they count as resolved.
    """
    try:
        meta = spark.read.parquet(f"{folder}/meta").first()
        if meta is None or meta["key"] != key:
            return None
        models = spark.read.parquet(f"{folder}/models")
        edges = spark.read.option("mergeSchema", "true").parquet(f"{folder}/edges")
        for name, kind in (x.split(" ", 1) for x in EDGES.split(", ")):
            if name not in edges.columns:
                edges = edges.withColumn(name, F.lit(None).cast(kind))
        edges = edges.withColumn("resolution_status", F.coalesce("resolution_status", F.lit("resolved")))
        return models, edges.select(*(x.split(" ", 1)[0] for x in EDGES.split(", "))), json.loads(meta["stats"])
    except Exception as e:  # a store that can't be read is built anew
        if type(e).__name__ not in ("AnalysisException", "Py4JJavaError", "JSONDecodeError"):
            raise
        return None


def save_results(folder: str, results: DataFrame) -> None:
    """Append results of models; the latest of a (unique_id, sql_hash) counts."""
    results.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/results")


def load_results(spark: SparkSession, folder: str) -> DataFrame:
    """The latest result of every (unique_id, sql_hash); none if there are none yet."""
    try:
        rows = spark.read.option("mergeSchema", "true").parquet(f"{folder}/results")
    except Exception as e:
        if type(e).__name__ != "AnalysisException":
            raise
        return spark.createDataFrame([], RESULTS)
    last = rows.withColumn("place", F.row_number().over(Window.partitionBy("unique_id", "sql_hash").orderBy(F.desc("saved_at"))))
    names = [x.split(" ", 1)[0] for x in ("unique_id", "sql_hash", "edges", "columns_attempted", "columns_traced", "failed_columns", "ambiguous_columns", "unresolved_columns", "output_columns")]
    return last.filter("place = 1").select(*names)


def work_list(models: DataFrame, results: DataFrame) -> DataFrame:
    """Models (unique_id, sql_hash, ...) without a stored result."""
    return models.join(results.select("unique_id", "sql_hash"), ["unique_id", "sql_hash"], "left_anti")


def export_json(edges: DataFrame) -> DataFrame:
    """One row (json) with models, nodes, edges and counts of a graph; for graphs that fit one document."""
    from spindrift.operators.graph import nodes_of

    nodes = nodes_of(edges)
    parts = nodes.agg(F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_list(F.struct("model", "column"))).alias("nodes"))
    listed = edges.agg(F.array_sort(F.collect_list(F.struct("source_model", "source_column", "target_model", "target_column", "transform_type", "transform_sql", "transform_chain", "model_unique_id", "resolution_status"))).alias("edges"))
    both = parts.crossJoin(listed)
    stats = F.struct(F.size("models").alias("models"), F.size("nodes").alias("nodes"), F.size("edges").alias("edges"))
    return both.select(F.to_json(F.struct("models", "nodes", "edges", stats.alias("stats"))).alias("json"))


def export_html(edges: DataFrame, path: str, limit: int = 5000) -> None:
    """A page with the models as circles and their connections; at most limit connections, the largest."""
    from spindrift.operators.reports import model_rollup

    rows = [r.asDict() for r in model_rollup(edges).select("source_model", "target_model", "cnt", "dominant").orderBy(F.desc("cnt"), "source_model", "target_model").limit(limit).collect()]
    page = """<!doctype html><meta charset="utf-8"><title>Lineage</title><canvas id="c" width="1200" height="900"></canvas><script>
const links = DATA, names = [...new Set(links.flatMap(l => [l.source_model, l.target_model]))], at = {};
names.forEach((n, i) => at[n] = [600 + 400 * Math.cos(2 * Math.PI * i / names.length), 450 + 400 * Math.sin(2 * Math.PI * i / names.length)]);
const g = document.getElementById("c").getContext("2d");
for (const l of links) { g.lineWidth = 1 + Math.log(l.cnt); g.globalAlpha = .4; g.beginPath(); g.moveTo(...at[l.source_model]); g.lineTo(...at[l.target_model]); g.stroke(); }
g.globalAlpha = 1; for (const n of names) { g.beginPath(); g.arc(...at[n], 5, 0, 7); g.fill(); g.fillText(n, at[n][0] + 8, at[n][1]); }
</script>"""
    with open(path, "w", encoding="utf-8") as f:
        f.write(page.replace("DATA", json.dumps(rows).replace("</", "<\\/")))
