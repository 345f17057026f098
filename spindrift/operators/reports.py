"""Reports over edges: counts, rollups, neighbours, and labels."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.transforms import LITERAL_MODEL, TRIVIAL
from spindrift.operators.graph import all_pairs, as_graph


def counts(models: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: models, edges, distinct target columns and target models."""
    e = edges.agg(F.count("*").alias("edges"), F.countDistinct("target_column").alias("target_columns"), F.countDistinct("target_model").alias("target_models"))
    return models.agg(F.count("*").alias("models")).crossJoin(e)


def transform_breakdown(edges: DataFrame) -> DataFrame:
    """(transform_type, cnt), most frequent first."""
    return edges.groupBy("transform_type").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "transform_type")


def transform_bars(edges: DataFrame, width: int = 40) -> DataFrame:
    """Breakdown with percentages and bars of at most width characters."""
    total = Window.partitionBy()
    share = F.col("cnt") / F.sum("cnt").over(total)
    return transform_breakdown(edges).select("transform_type", "cnt", F.round(share * 100, 1).alias("percent"), F.expr(f"repeat('#', cast(floor(cnt / sum(cnt) over () * {width}) as int))").alias("bar"))


def top_models(edges: DataFrame, limit: int = 20) -> DataFrame:
    """(target_model, cnt): models with most inbound edges; equal ones by name."""
    return edges.groupBy("target_model").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "target_model").limit(limit)


KEYS = ("target_model", "target_column", "source_model", "source_column")


def sample_edges(edges: DataFrame, limit: int = 20) -> DataFrame:
    return edges.orderBy(*KEYS).limit(limit)


def inbound(edges: DataFrame, model: str) -> DataFrame:
    """Edges into a model (any case), by target column and source."""
    return edges.filter(F.lower("target_model") == model.lower()).orderBy("target_column", "source_model", "source_column")


def outbound(edges: DataFrame, model: str, limit: int = 30) -> DataFrame:
    """Edges out of a model (any case), by target."""
    return edges.filter(F.lower("source_model") == model.lower()).orderBy(*KEYS).limit(limit)


def find_columns(edges: DataFrame, column: str, limit: int = 30) -> DataFrame:
    """(target_model, target_column) of a name, in any case."""
    return edges.filter(F.lower("target_column") == column.lower()).select("target_model", "target_column").distinct().orderBy("target_model", "target_column").limit(limit)


def list_models(models: DataFrame, limit: int = 50) -> DataFrame:
    return models.select("name", "resource_type").orderBy("name", "resource_type").limit(limit)


def model_rollup(edges: DataFrame) -> DataFrame:
    """(source_model, target_model, cnt, types, dominant): edges between models without those of a model to itself.

    types maps each transform type to its count; dominant is the most frequent, of equal ones the first by name.
    One shuffle by model pair and type, one by model pair.
    """
    by_type = edges.filter("source_model <> target_model").groupBy("source_model", "target_model", "transform_type").agg(F.count("*").alias("n"))
    out = by_type.groupBy("source_model", "target_model").agg(F.sum("n").alias("cnt"), F.array_sort(F.collect_list(F.struct("transform_type", "n"))).alias("t"), F.min_by("transform_type", F.struct((-F.col("n")).alias("n"), "transform_type")).alias("dominant"))
    return out.select("source_model", "target_model", "cnt", F.map_from_entries("t").alias("types"), "dominant")


def degrees(edges: DataFrame) -> DataFrame:
    """(model, in_degree, out_degree, degree) over model pairs."""
    pairs = edges.filter("source_model <> target_model").select("source_model", "target_model").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("source_model").alias("model"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_model").alias("model"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("model").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def pair_stats(edges: DataFrame) -> DataFrame:
    """One row (models, connections, column_edges)."""
    r = model_rollup(edges)
    ends = r.select(F.col("source_model").alias("m")).union(r.select("target_model")).agg(F.countDistinct("m").alias("models"))
    return ends.crossJoin(r.agg(F.count("*").alias("connections"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("column_edges")))


def neighbours(edges: DataFrame) -> DataFrame:
    """(model, up, down): neighbouring models with their edge counts, largest first."""
    r = model_rollup(edges)
    item = lambda c: F.struct((-F.col("cnt")).alias("k"), F.col(c).alias("name"), F.col("cnt").alias("cnt"))
    tidy = lambda c: F.transform(F.array_sort(F.coalesce(F.col(c), F.array().cast("array<struct<k:bigint,name:string,cnt:bigint>>"))), lambda x: F.struct(x["name"].alias("name"), x["cnt"].alias("cnt"))).alias(c)
    up = r.groupBy(F.col("target_model").alias("model")).agg(F.collect_list(item("source_model")).alias("up"))
    down = r.groupBy(F.col("source_model").alias("model")).agg(F.collect_list(item("target_model")).alias("down"))
    return up.join(down, "model", "full").select("model", tidy("up"), tidy("down"))


def resolution_breakdown(edges: DataFrame) -> DataFrame:
    """(resolution_status, cnt) of the edges in the trace of every target column, each trace counted on its own.

    A trace holds an edge once, however often its row is repeated.
    """
    graph = as_graph(edges).select("src", "dst", "resolution_status").distinct()
    closed = all_pairs(graph.select("src", "dst")).select(F.col("start").alias("dst_in"), F.col("node").alias("target"))
    own = graph.select("dst").distinct().select(F.col("dst").alias("dst_in"), F.col("dst").alias("target"))
    inside = graph.join(closed.union(own).distinct(), graph.dst == F.col("dst_in")).join(graph.select(F.col("dst").alias("target")).distinct(), "target", "left_semi")
    return inside.groupBy("resolution_status").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "resolution_status")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def connected_pair(edges: DataFrame) -> DataFrame:
    """One (source_model, target_model) with an edge between different models, the first by name."""
    return edges.filter((F.col("source_model") != F.col("target_model")) & (F.col("source_model") != LITERAL_MODEL)).select("source_model", "target_model").distinct().orderBy("source_model", "target_model").limit(1)


def trace_report(trace: DataFrame, roots: DataFrame) -> dict[str, DataFrame]:
    """Parts of a trace: roots by model, literals, counts by type and by status, renamed pairs."""
    return {
        "roots": roots.filter(F.col("model") != LITERAL_MODEL).groupBy("model").agg(F.array_sort(F.collect_set("column")).alias("columns")).orderBy("model"),
        "literals": trace.filter(F.col("source_model") == LITERAL_MODEL).select("source_column", "target_model", "target_column").distinct().orderBy("source_column", "target_model", "target_column"),
        "types": transform_breakdown(trace),
        "statuses": trace.groupBy("resolution_status").agg(F.count("*").alias("cnt")).orderBy("resolution_status"),
        "renames": trace.filter((F.col("transform_type") == "rename") & (F.lower("source_column") != F.lower("target_column"))).select("source_column", "target_column").distinct().orderBy("source_column", "target_column"),
    }


def grouped_edges(edges: DataFrame, key: str) -> DataFrame:
    """Edges in the order of a key (source model, target column), each with the number of edges in its group.

    The order is a range sort, so that a group of any size is spread over tasks; no group is gathered in one row.
    """
    sizes = edges.groupBy(key).agg(F.count("*").alias("group_size"))
    rest = [c for c in (*KEYS, "transform_type") if c != key]
    return edges.join(sizes, key).select(key, "group_size", *rest).orderBy(key, *rest)


def trivial_sql(sql: Column, column: Column) -> Column:
    """Whether SQL is nothing but the column's name, qualified and quoted or not."""
    bare = F.regexp_replace(F.trim(sql), '[`"\\[\\]]', "")
    return F.lower(F.element_at(F.split(bare, r"\."), -1)) == F.lower(column)


def labels(edges: DataFrame, width: int = 60) -> DataFrame:
    """edges with label (renames show as such), note (unless resolved) and shown (SQL wrapped at width)."""
    renamed = F.col("transform_type").isin(*TRIVIAL) & (F.lower("source_column") != F.lower("target_column"))
    label = F.when(renamed, F.concat(F.lit("rename: "), "source_column", F.lit(" -> "), "target_column")).otherwise(F.col("transform_type"))
    note = F.when(F.col("resolution_status") != "resolved", F.concat(F.lit("["), "resolution_status", F.lit("]"))).otherwise(F.lit(""))
    shown = F.when(trivial_sql(F.col("transform_sql"), F.col("source_column")), F.lit("")).otherwise(F.regexp_replace(F.col("transform_sql"), f"(.{{{width}}})(?=.)", "$1\n"))
    return edges.withColumns({"label": label, "note": note, "shown": shown})


def chain_steps(chain: Column, limit: int = 4) -> Column:
    """The first steps of a chain that do something."""
    return F.slice(F.filter(chain, lambda s: ~s["type"].isin("passthrough", "unknown")), 1, limit)


def known_cases(found: DataFrame, cases: DataFrame) -> DataFrame:
    """cases (model, column, min_sources, max_sources, statuses) with n_sources and ok.

    found (model, column, n_sources, statuses): ok if the number lies in the range and no other status occurs.
    """
    got = found.select("model", "column", "n_sources", F.col("statuses").alias("seen"))
    n = F.coalesce("n_sources", F.lit(0))
    ok = n.between(F.col("min_sources"), F.col("max_sources")) & (F.size(F.array_except(F.coalesce("seen", F.array().cast("array<string>")), "statuses")) == 0)
    return cases.join(got, ["model", "column"], "left").select("model", "column", "min_sources", "max_sources", n.alias("n_sources"), ok.alias("ok"))


def timed(stages: list[tuple[str, Callable]]) -> list[tuple[str, float]]:
    """Seconds of each stage, run in order."""
    out = []
    for name, run in stages:
        began = time.perf_counter()
        run()
        out.append((name, time.perf_counter() - began))
    return out


def success(total: Column, skipped: Column, analyzed: Column, attempted: Column, traced: Column) -> tuple[Column, Column]:
    """(success_rate, column_coverage) at three places, half to even; 1 where nothing could be done."""
    rate = lambda part, whole: F.when(whole == 0, F.lit(1.0)).otherwise(F.bround(part / whole, 3))
    return rate(analyzed, total - skipped), rate(traced, attempted)
