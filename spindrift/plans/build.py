"""Building a project's lineage: models in dependency order, schemas passed on, results kept per model."""

from __future__ import annotations

import hashlib
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.dialect import dialect_of
from spindrift.functions.transforms import LITERAL_MODEL
from spindrift.operators import graph as G
from spindrift.plans.analyze import Analysis, analyze_sql, jinja
from spindrift.sources import artifacts, store

#: A model's columns join the analysis schema from this many proper ones on.
PROMOTED_FROM = 3
SERVICE_PREFIXES = ("_sdc_", "_dbt_")


def ranked(models: list[dict]) -> list[list[dict]]:
    """Models by dependency level; a cycle's models come last, in manifest order."""
    known = {m["unique_id"]: m for m in models}
    waiting = {u: {d for d in m["depends_on"] if d in known and d != u} for u, m in known.items()}
    out = []
    while waiting:
        ready = [u for u, deps in waiting.items() if not deps & waiting.keys()] or list(waiting)
        out.append([known[u] for u in ready])
        for u in ready:
            del waiting[u]
    return out


def build(spark: SparkSession, models: list[dict], schemas: dict[str, dict[str, str]], lookup: dict[str, str], *, dialect: str | None = None, cached: dict[tuple[str, str], Analysis] | None = None, max_columns: int | None = None) -> tuple[list[dict], dict, list[tuple[str, str, Analysis]]]:
    """(edges, stats, results) of models in their order.

    Output columns of each model join the schema of later levels with the types of their sources (else TEXT). They
    also join the schema that analysis sees if the model isn't in the catalog and has at least three columns that
    aren't service columns or fields. A model without edges is tried again with catalog columns only.
    """
    began = time.perf_counter()
    catalog = {t: dict(c) for t, c in schemas.items()}
    cumulative = {t: dict(c) for t, c in schemas.items()}
    visible = {t: dict(c) for t, c in schemas.items()}
    edges: list[dict] = []
    results = []
    stats = {"total_models": len(models), "analyzed_models": 0, "skipped_models": 0, "failed_models": 0, "columns_attempted": 0, "columns_traced": 0, "unresolved_models": [], "failed_columns": []}
    for level in ranked(models):
        for m in level:
            sql = m["compiled_sql"] or ""
            if m["resource_type"] == "source" or not sql.strip():
                stats["skipped_models"] += 1
                continue
            # a result depends on the SQL and on the columns of what it reads
            upstream = sorted((t, tuple(c)) for t, c in visible.items() if t.lower().rpartition(".")[2] in sql.lower())
            key = hashlib.sha1(f"{sql}\x00{dialect}\x00{upstream}".encode()).hexdigest()[:20]
            found = (cached or {}).get((m["unique_id"], key))
            if found is None:
                options = dict(dialect=dialect, unique_id=m["unique_id"], max_columns=max_columns)
                found = analyze_sql(spark, sql, m["name"], visible, lookup, **options)
                if not found.edges and found.error is None and not jinja(sql):
                    again = analyze_sql(spark, sql, m["name"], catalog, lookup, **options)
                    found = again if again.edges else found
                results.append((m["unique_id"], key, found))
            stats["columns_attempted"] += found.columns_attempted
            stats["columns_traced"] += found.columns_traced
            stats["failed_columns"] += [f"{m['name']}.{c}" for c in found.failed_columns]
            if found.edges:
                stats["analyzed_models"] += 1
            else:
                stats["failed_models"] += 1
                stats["unresolved_models"].append(m["name"])
            for e in found.edges:
                source = e["source_model"]
                edges.append(e | {"source_model": source if source == LITERAL_MODEL else lookup.get(source.lower(), source)})
            own = {}
            first = {}
            for e in found.edges:
                first.setdefault(e["target_column"].lower(), e)
            for c in dict.fromkeys([*found.output_columns, *(e["target_column"] for e in found.edges)]):
                e = first.get(c.lower())
                theirs = cumulative.get(e["source_model"], {}).get(e["source_column"].lower()) if e else None
                own[c.lower()] = catalog.get(m["name"], {}).get(c.lower()) or theirs or "TEXT"
            cumulative.setdefault(m["name"], {}).update({c: t for c, t in own.items() if c not in cumulative.get(m["name"], {})})
            proper = [c for c in own if "." not in c and not c.startswith(SERVICE_PREFIXES)]
            if m["name"] not in catalog and len(proper) >= PROMOTED_FROM:
                visible[m["name"]] = {c: own[c] for c in own if "." not in c}
    possible = stats["total_models"] - stats["skipped_models"]
    stats["success_rate"] = round(stats["analyzed_models"] / possible, 3) if possible else 1.0
    stats["column_coverage"] = round(stats["columns_traced"] / stats["columns_attempted"], 3) if stats["columns_attempted"] else 1.0
    stats["seconds"] = round(time.perf_counter() - began, 3)
    return edges, stats, results


class LineageGraph:
    """Column lineage of a project: reads its artifacts, builds or loads the edges, answers questions about them."""

    _memory: dict[str, tuple] = {}

    def __init__(self, spark: SparkSession, manifest: str, catalog: str | None = None, *, dialect: str | None = None, select: str | None = None, cache_dir: str | None = None, use_cache: bool = True) -> None:
        self.spark = spark
        models, meta = artifacts.read_manifest(spark, manifest)
        catalog = catalog or artifacts.find_catalog(manifest)
        self.dialect = dialect or dialect_of(meta.get("adapter_type"))
        read = lambda p: Path(p).read_bytes() if p and "://" not in p else p
        self.key = store.project_key(read(manifest), read(catalog), self.dialect, select)
        self.folder = f"{cache_dir}/{hashlib.sha1(str(manifest).encode()).hexdigest()[:16]}" if cache_dir else None
        kept = self._memory.get(self.key) if use_cache else None
        if kept is None and use_cache and self.folder:
            kept = store.load(spark, self.folder, self.key)
        if kept is None:
            kept = self._built(models, catalog, select, use_cache)
        self.models, self.edges, self.build_stats = kept
        if use_cache:
            self._memory[self.key] = kept

    def _built(self, models: DataFrame, catalog: str | None, select: str | None, use_cache: bool) -> tuple:
        chosen = artifacts.selected(models, select)
        schemas: dict[str, dict[str, str]] = {}
        documented = artifacts.documented_schemas(models)
        parts = [documented] if catalog is None else [artifacts.read_catalog(self.spark, catalog, models), documented]
        # artifacts describe a project, not its data: they are read whole on the driver
        for k, part in enumerate(parts):
            known = set(schemas) if k else set()
            for r in part.orderBy("table", "ordinal", "column").collect():
                if r["table"] not in known:
                    schemas.setdefault(r["table"], {})[r["column"]] = r["data_type"]
        lookup = {r["form"]: r["canonical"] for r in artifacts.table_lookup(models).collect()}
        rows = [r.asDict() for r in chosen.select("ord", "unique_id", "name", "resource_type", "compiled_sql", "depends_on").orderBy("ord").collect()]
        cached = {}
        if use_cache and self.folder:
            for r in store.load_results(self.spark, self.folder).collect():
                cached[r["unique_id"], r["sql_hash"]] = Analysis([e.asDict(True) for e in r["edges"]], r["columns_attempted"], r["columns_traced"], r["failed_columns"], r["ambiguous_columns"], r["unresolved_columns"], r["output_columns"])
        found, stats, results = build(self.spark, rows, schemas, lookup, dialect=self.dialect, cached=cached)
        numbered = self.spark.createDataFrame([(i, *(e[k.split(" ")[0]] for k in store.EDGES.split(", "))) for i, e in enumerate(found)], f"ord long, {store.EDGES}")
        edges = G.merged(numbered).drop("ord")
        if self.folder:
            store.save(self.folder, self.key, chosen, edges, stats)
            if results:
                fields = [x.split(" ")[0] for x in store.EDGES.split(", ")]
                store.save_results(self.folder, self.spark.createDataFrame([(u, k, [tuple(e[f] for f in fields) for e in a.edges], a.columns_attempted, a.columns_traced, a.failed_columns, a.ambiguous_columns, a.unresolved_columns, a.output_columns) for u, k, a in results], store.RESULTS))
        return chosen, edges.cache(), stats

    @classmethod
    def clear_cache(cls) -> None:
        """Forget the graphs in memory."""
        cls._memory.clear()

    def trace(self, model: str, column: str) -> tuple[DataFrame, DataFrame]:
        return G.trace(self.edges, model, column)

    def impact(self, model: str, column: str) -> tuple[DataFrame, DataFrame]:
        return G.impact(self.edges, model, column)

    def edges_between(self, source: str, target: str) -> DataFrame:
        return G.edges_between(self.edges, source, target)

    def model_dependencies(self, model: str) -> DataFrame:
        return G.model_dependencies(self.edges, model)

    def all_models(self) -> DataFrame:
        return G.all_models(self.edges)

    def all_columns(self, model: str) -> DataFrame:
        return G.all_columns(self.edges, model)

    def search_columns(self, text: str) -> DataFrame:
        return G.search_columns(self.edges, text)

    def transforms_by_type(self, kind: str) -> DataFrame:
        return G.transforms_by_type(self.edges, kind)

    def stats(self) -> DataFrame:
        return G.stats(self.edges)

    def add_edges(self, more: DataFrame) -> None:
        """Put edges in; one of a pair that is there is replaced if the new one is at least as significant."""
        old = self.edges.withColumn("ord", F.lit(0).cast("long"))
        self.edges = G.merged(old.unionByName(more.withColumn("ord", F.lit(1).cast("long")))).drop("ord")

    def to_frames(self) -> tuple[DataFrame, DataFrame]:
        return G.frames(self.spark, self.edges)

    def to_dict(self) -> dict:
        """The graph with the build's statistics, as one document."""
        return json.loads(store.export_json(self.edges).first()["json"]) | {"build_stats": self.build_stats}
