"""Command line: trace, impact, stats, export, list-models, list-columns; JSON on standard output."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindrift", description="Column lineage of a project")
    p.add_argument("-m", "--manifest", required=True)
    p.add_argument("-c", "--catalog")
    p.add_argument("-d", "--dialect")
    p.add_argument("-s", "--select")
    p.add_argument("--cache-dir")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("trace", "impact"):
        q = sub.add_parser(name)
        q.add_argument("model")
        q.add_argument("column")
    sub.add_parser("stats")
    q = sub.add_parser("export")
    q.add_argument("-o", "--output")
    sub.add_parser("list-models")
    q = sub.add_parser("list-columns")
    q.add_argument("model")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from spindrift.plans.build import LineageGraph

    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("spindrift").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "ERROR")
    g = LineageGraph(spark, a.manifest, a.catalog, dialect=a.dialect, select=a.select, cache_dir=a.cache_dir)
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    if a.command == "trace":
        edges, roots = g.trace(a.model, a.column)
        out = {"target": f"{a.model}.{a.column}", "edges": rows(edges), "source_columns": [f"{r['model']}.{r['column']}" for r in rows(roots)]}
    elif a.command == "impact":
        edges, hit = g.impact(a.model, a.column)
        out = {"source": f"{a.model}.{a.column}", "edges": rows(edges), "affected_columns": [f"{r['model']}.{r['column']}" for r in rows(hit)]}
    elif a.command == "stats":
        out = rows(g.stats())[0] | {"build_stats": g.build_stats}
    elif a.command == "export":
        out = g.to_dict()
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                json.dump(out, f, indent=2)
            return 0
    elif a.command == "list-models":
        out = [r["model"] for r in rows(g.all_models())]
    else:
        out = [r["column"] for r in rows(g.all_columns(a.model))]
    json.dump(out, sys.stdout, indent=2)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
