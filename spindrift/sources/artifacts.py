"""Project artifacts as DataFrames: models, schemas, dependencies and table names."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.exceptions import CatalogParseError, ManifestNotFoundError, ManifestParseError

_COLUMN = "struct<name:string,description:string,data_type:string>"
_NODE = f"struct<unique_id:string,name:string,alias:string,resource_type:string,compiled_code:string,compiled_sql:string,raw_code:string,raw_sql:string,depends_on:struct<nodes:array<string>,macros:array<string>>,columns:map<string,{_COLUMN}>,database:string,schema:string,original_file_path:string>"
MANIFEST = f"struct<metadata:struct<adapter_type:string,project_name:string>,nodes:map<string,{_NODE}>,sources:map<string,{_NODE}>>"
_TABLE = "struct<metadata:struct<type:string,schema:string,name:string,database:string>,columns:map<string,struct<type:string,index:int,name:string,comment:string>>>"
CATALOG = f"struct<nodes:map<string,{_TABLE}>,sources:map<string,{_TABLE}>>"
#: Kinds of nodes that are models here.
RESOURCES = ("model", "source", "seed", "snapshot")
LAYERS = ("base", "stg", "int", "fct", "dim", "rep", "mart")


def _document(spark: SparkSession, path: str, schema: str, error: type[Exception]) -> DataFrame:
    """One row with the parsed document; keys that the schema doesn't name are never built."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("d"), F.get_json_object("value", "$").isNotNull().alias("ok"))
    row = parsed.select("ok", F.coalesce(F.col("d.nodes").isNotNull() | F.col("d.sources").isNotNull(), F.lit(False)).alias("any")).first()
    if row is None or not row["ok"]:
        raise error(f"{path} is not valid JSON")
    return parsed.select("d.*")


def first_filled(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str | None]]:
    """(models, metadata): rows ord, unique_id, name, resource_type, database, schema_name, compiled_sql, depends_on, columns, original_file_path.

    Nodes come first, then sources; a later key wins. A source whose name occurs on several sources of which it has
    a schema is called schema.table.
    """
    if "://" not in path and not os.path.exists(path):
        raise ManifestNotFoundError(path)
    doc = _document(spark, path, MANIFEST, ManifestParseError)
    meta = doc.select("metadata.*").first()
    parts = [doc.select(F.lit(k).alias("part"), F.posexplode(F.coalesce(name, F.create_map().cast(f"map<string,{_NODE}>"))).alias("place", "uid", "n")) for k, name in enumerate(("nodes", "sources"))]
    raw = parts[0].unionByName(parts[1]).filter(F.col("n.resource_type").isin(*RESOURCES) & F.col("n.name").isNotNull())
    raw = raw.withColumn("last", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("part")))).filter("last = 1")
    raw = raw.withColumn("short", first_filled(F.col("n.alias"), F.col("n.name")))
    same = F.count("*").over(Window.partitionBy(F.col("n.resource_type"), "short"))
    qualified = (F.col("n.resource_type") == "source") & (same > 1) & (F.coalesce(F.col("n.schema"), F.lit("")) != "")
    models = raw.select(
        (F.col("part").cast("long") * 2**32 + F.col("place")).alias("ord"), F.coalesce("n.unique_id", "uid").alias("unique_id"), F.when(qualified, F.concat_ws(".", "n.schema", "short")).otherwise(F.col("short")).alias("name"), F.col("short").alias("short_name"),
        F.col("n.resource_type").alias("resource_type"), F.col("n.database").alias("database"), F.col("n.schema").alias("schema_name"),
        first_filled(F.col("n.compiled_code"), F.col("n.compiled_sql"), F.col("n.raw_code"), F.col("n.raw_sql")).alias("compiled_sql"),
        F.coalesce(F.col("n.depends_on.nodes"), F.array().cast("array<string>")).alias("depends_on"), F.col("n.columns").alias("columns"), F.col("n.original_file_path").alias("original_file_path"),
    )
    return models, (meta.asDict() if meta else {})


def read_catalog(spark: SparkSession, path: str, models: DataFrame) -> DataFrame:
    """Schema rows (table, ordinal, column, data_type): lower-cased columns in catalog order, type TEXT where missing."""
    doc = _document(spark, path, CATALOG, CatalogParseError)
    parts = [doc.select(F.explode(F.coalesce(name, F.create_map().cast(f"map<string,{_TABLE}>"))).alias("unique_id", "t")) for name in ("nodes", "sources")]
    rows = parts[0].unionByName(parts[1]).select("unique_id", F.posexplode("t.columns").alias("place", "key", "c"))
    named = rows.join(models.select("unique_id", "name"), "unique_id", "left")
    table = F.coalesce("name", F.element_at(F.split("unique_id", r"\."), -1))
    return named.select(table.alias("table"), F.coalesce(F.col("c.index"), F.col("place")).alias("ordinal"), F.lower(F.coalesce(F.col("c.name"), F.col("key"))).alias("column"), F.coalesce(F.nullif(F.col("c.type"), F.lit("")), F.lit("TEXT")).alias("data_type"))


def documented_schemas(models: DataFrame) -> DataFrame:
    """Schema rows of the columns that sources document in the manifest."""
    rows = models.filter("resource_type = 'source'").select(F.col("name").alias("table"), F.posexplode("columns").alias("ordinal", "key", "c"))
    return rows.select("table", "ordinal", F.lower(F.coalesce(F.col("c.name"), F.col("key"))).alias("column"), F.coalesce(F.nullif(F.col("c.data_type"), F.lit("")), F.lit("TEXT")).alias("data_type"))


def find_catalog(manifest: str) -> str | None:
    """The catalog beside a manifest, if there is one."""
    beside = Path(manifest).with_name("catalog.json")
    return str(beside) if beside.exists() else None


def table_lookup(models: DataFrame) -> DataFrame:
    """(form, canonical): lower-cased table, schema.table and database.schema.table; the last of the manifest wins."""
    forms = [F.col("short_name"), F.concat_ws(".", "schema_name", "short_name"), F.concat_ws(".", "database", "schema_name", "short_name")]
    needs = [F.lit(True), F.coalesce(F.col("schema_name"), F.lit("")) != "", (F.coalesce(F.col("database"), F.lit("")) != "") & (F.coalesce(F.col("schema_name"), F.lit("")) != "")]
    every = F.filter(F.array(*(F.when(n, F.lower(f)) for f, n in zip(forms, needs)), F.lower("name")), lambda x: x.isNotNull())
    rows = models.select("ord", F.explode(F.array_distinct(every)).alias("form"), F.col("name").alias("canonical"))
    return rows.groupBy("form").agg(F.max_by("canonical", "ord").alias("canonical"))


def name_collisions(models: DataFrame) -> DataFrame:
    """(name, unique_ids, n): names of more than one node."""
    return models.groupBy("name").agg(F.array_sort(F.collect_list("unique_id")).alias("unique_ids"), F.count("*").alias("n")).filter("n > 1")


def dependency_edges(models: DataFrame) -> DataFrame:
    """(parent, child): unique_ids of known models only."""
    known = models.select(F.col("unique_id").alias("parent"))
    return models.select(F.explode("depends_on").alias("parent"), F.col("unique_id").alias("child")).join(known, "parent", "left_semi").distinct()


def analyzable(models: DataFrame) -> DataFrame:
    """Models with SQL that are no sources; templates left in the SQL rule a model out."""
    sql = F.col("compiled_sql")
    return models.filter((F.col("resource_type") != "source") & (F.trim(sql) != "")).withColumn("templated", sql.contains("{{") | sql.contains("{%"))


def selected(models: DataFrame, select: str | None, include_downstream: bool = False) -> DataFrame:
    """The models that a comma list names (+ signs are ignored), with all that they depend on.

    Names match without regard to case. Nothing named or no match: all models. With include_downstream also what
    depends on them.
    """
    from spindrift.operators.graph import reachable

    wanted = [w.strip().strip("+").lower() for w in (select or "").split(",") if w.strip().strip("+")]
    if not wanted:
        return models
    seeds = models.filter(F.lower("name").isin(*wanted)).select(F.col("unique_id").alias("node"))
    if seeds.isEmpty():
        return models
    edges = dependency_edges(models)
    up = reachable(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")), seeds)
    found = seeds.union(up)
    if include_downstream:
        found = found.union(reachable(edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")), seeds))
    return models.join(found.withColumnRenamed("node", "unique_id").distinct(), "unique_id", "left_semi")


def suggestions(models: DataFrame, name: str, limit: int = 8) -> DataFrame:
    """Names that hold the word, stand in it, or share its first six characters."""
    low = name.strip().strip("+").lower()
    n = F.lower("name")
    return models.select("name").distinct().filter(n.contains(low) | F.lit(low).contains(n) | n.startswith(low[:6])).orderBy("name").limit(limit)


def layer(name: Column, resource_type: Column) -> Column:
    """source, or the prefix of a model's name if it is a known layer's, else other."""
    out = F.when(resource_type == "source", "source")
    for p in LAYERS:
        out = out.when(F.lower(name).startswith(p + "_"), p)
    return out.otherwise("other")


def inspect(models: DataFrame, schemas: DataFrame, hunted: str | None = None) -> DataFrame:
    """Per model: in the catalog or not, its number of columns, templates left, and whether its SQL names a column."""
    counts = schemas.groupBy(F.col("table").alias("name")).agg(F.count("*").alias("n_columns"))
    sql = F.col("compiled_sql")
    named = F.instr(F.lower(sql), F.lit((hunted or "").lower())) > 0 if hunted else F.lit(False)
    return models.join(counts, "name", "left").select("name", F.col("n_columns").isNotNull().alias("in_catalog"), F.coalesce("n_columns", F.lit(0)).alias("n_columns"), (sql.contains("{{") | sql.contains("{%")).alias("templated"), named.alias("names_column"))


def best_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    """Which job runs to take artifacts from: successful ones (status 10), newest first, those with both artifacts ahead."""
    newest = runs.filter("status = 10").orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)
    return newest.filter("has_manifest").orderBy(F.desc("has_catalog"), F.desc("created_at"), F.desc("run_id"))


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file, put into the environment where they aren't set yet."""
    found = {}
    for line in Path(path).read_text().splitlines() if os.path.exists(path) else ():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            found[key] = value.strip("'\"")
            os.environ.setdefault(key, found[key])
    return found
