"""Closures, order and selection over directed edges, all as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.exceptions import ColumnNotFoundError, LineageError
from spindrift.sources.shared import discard, written

#: A closure of at most so many edges is followed by filters and put in order on the driver; larger ones by joins.
SMALL = 100_000
#: A frontier of at most so many nodes is looked up by a filter with their names, a larger one by a broadcast list.
FEW = 100
#: So many rounds' tables are read side by side before they become one.
COMPACT = 16


class _Rounds:
    """Tables of the rounds of a loop, read as one; every COMPACT rounds they are written anew as one."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.parts, self.stale, self.all = spark, name, [], [], None

    def add(self, df: DataFrame) -> DataFrame:
        table, path = written(df, self.name)
        self.all = table if self.all is None else self.all.union(table)
        self.parts.append(path)
        if len(self.parts) > COMPACT:
            self.compact()
        return table

    def compact(self) -> DataFrame:
        """One table of all rounds; those of the rounds but the last, which a frontier may still read, are deleted."""
        old = self.parts
        self.all, path = written(self.all, self.name)
        self.parts = [path]
        discard(self.spark, *old[:-1], *self.stale)
        self.stale = old[-1:]
        return self.all


def reachable(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """Nodes reached from seeds (node) over edges (src, dst) in one step or more. Cycles end by themselves.

    The edges are written once. Each round joins the frontier with them, drops what was seen and writes the rest; only
    the test for an empty frontier comes to the driver. The result is one table. With rounds, a closure that needs
    more raises LineageError.
    """
    spark = edges.sparkSession
    graph, path = written(edges.select("src", "dst"), "graph-edges")
    seen, frontier, done = _Rounds(spark, "graph-seen"), seeds.select("node").distinct(), 0
    while True:
        step = graph.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = seen.add(step if seen.all is None else step.join(seen.all, "node", "left_anti"))
        if frontier.isEmpty():
            found = seen.compact()
            discard(spark, path, *seen.stale)
            return found
        done += 1
        if rounds is not None and done >= rounds:
            raise LineageError(f"the closure isn't complete after {rounds} rounds")


def all_pairs(edges: DataFrame) -> DataFrame:
    """(start, node) for every path of one step or more: each round puts an edge behind the pairs that the last one found."""
    spark = edges.sparkSession
    graph, path = written(edges.select("src", "dst").distinct(), "graph-edges")
    seen = _Rounds(spark, "graph-pairs")
    new = seen.add(graph.select(F.col("src").alias("start"), F.col("dst").alias("node")))
    while not new.isEmpty():
        longer = new.withColumnRenamed("node", "src").join(graph, "src").select("start", F.col("dst").alias("node")).distinct()
        new = seen.add(longer.join(seen.all, ["start", "node"], "left_anti"))
    discard(spark, path, *seen.stale)
    return seen.all


def _ordered(nodes: list, edges: list[tuple]) -> dict:
    """Levels of a small graph: 0 for roots, else one more than the highest parent's; a cycle gets the level where the order stops."""
    known = set(nodes)
    below: dict = {n: set() for n in known}
    for a, b in edges:
        if a in known and b in known:
            below[a].add(b)
    waits = dict.fromkeys(known, 0)
    for children in below.values():
        for b in children:
            waits[b] += 1
    out, ready, level = {}, [n for n in known if not waits[n]], 0
    while ready:
        after = []
        for n in ready:
            out[n] = level
            for b in below[n]:
                waits[b] -= 1
                if not waits[b]:
                    after.append(b)
        ready, level = after, level + 1
    return out | {n: level for n in known if n not in out}


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 for roots, else one more than the highest parent's. Edges of unknown nodes are left out.

    Nodes on a cycle, and those behind one, get the level at which the ordering stopped. A graph of at most SMALL
    nodes and edges is ordered on the driver. Else each round joins the nodes that became ready with the edges and
    counts, for the nodes that they lead to, how many parents are done; a node is ready when all are.
    """
    spark = nodes.sparkSession
    known, known_path = written(nodes.select("node").distinct(), "graph-nodes")
    listed = [r[0] for r in known.limit(SMALL + 1).collect()]
    if len(listed) <= SMALL:
        pairs = [tuple(r) for r in edges.select("src", "dst").distinct().limit(SMALL + 1).collect()]
        if len(pairs) <= SMALL:
            discard(spark, known_path)
            return spark.createDataFrame(list(_ordered(listed, pairs).items()), "node string, level int")
    ends = known.withColumnRenamed("node", "src"), known.withColumnRenamed("node", "dst")
    inside, path = written(edges.select("src", "dst").distinct().join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi"), "graph-edges")
    need, need_path = written(inside.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("need")), "graph-need")
    met, level = _Rounds(spark, "graph-level"), 0
    ready = met.add(known.join(need, "node", "left_anti").select("node", F.lit(0).cast("long").alias("n"), F.lit(0).alias("level"), F.lit(True).alias("ready")))
    while not ready.isEmpty():
        level += 1
        touched = inside.join(ready.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
        before = met.all.filter("not ready").groupBy("node").agg(F.sum("n").alias("before"))
        now = touched.join(before, "node", "left").join(need, "node")
        ready = met.add(now.select("node", "n", F.lit(level).alias("level"), (F.col("n") + F.coalesce("before", F.lit(0)) == F.col("need")).alias("ready"))).filter("ready")
    done = met.all.filter("ready").select("node", "level")
    every, _ = written(done.union(known.join(done, "node", "left_anti").select("node", F.lit(level).alias("level"))), "graph-levels")
    discard(spark, known_path, path, need_path, *met.parts, *met.stale)
    return every


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, rank): a total order in which parents come first; within a level by name.

    Levels are dealt by range and written; a rank is the place within its range behind the rows of the ranges before.
    """
    dealt, _ = written(levels(nodes, edges).repartitionByRange("level", "node").withColumn("part", F.spark_partition_id()), "graph-order")
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per task
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    first = nodes.sparkSession.createDataFrame(before, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("level", "node"))
    return dealt.withColumn("place", place).join(F.broadcast(first), "part").select("node", (F.col("before") + F.col("place")).alias("rank"))


def node_id(model: Column, column: Column) -> Column:
    """One string for a column of a model; the separator can't occur in names."""
    return F.concat_ws("\x1f", model, column)


def as_graph(edges: DataFrame) -> DataFrame:
    """Lineage edges with src and dst."""
    return edges.withColumns({"src": node_id(F.col("source_model"), F.col("source_column")), "dst": node_id(F.col("target_model"), F.col("target_column"))})


def nodes_of(edges: DataFrame) -> DataFrame:
    """Distinct (model, column) of both ends."""
    return edges.select(F.col("source_model").alias("model"), F.col("source_column").alias("column")).union(edges.select("target_model", "target_column")).distinct()


def resolve(edges: DataFrame, model: str, column: str) -> tuple[str, str]:
    """The column as the graph spells it: exact, else without regard to case, else ColumnNotFoundError."""
    for end in ("target", "source"):
        if not edges.filter((F.col(f"{end}_model") == model) & (F.col(f"{end}_column") == column)).isEmpty():
            return model, column
    every = nodes_of(edges)
    hit = every.filter((F.lower("model") == model.lower()) & (F.lower("column") == column.lower())).orderBy("model", "column").first()
    if hit is None:
        there = [r["column"] for r in every.filter(F.lower("model") == model.lower()).select("column").distinct().orderBy("column").collect()]
        raise ColumnNotFoundError(f"no column {column} in {model}; it has: {', '.join(there) or 'none'}")
    return hit["model"], hit["column"]


ORDER = ("source_model", "source_column", "target_model", "target_column")


def ordered_edges(graph: DataFrame) -> DataFrame:
    """Edges by the level of their source in this subgraph, then by names."""
    ends = graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct()
    rank = levels(ends, graph.select("src", "dst")).select(F.col("node").alias("src"), F.col("level").alias("rank"))
    return graph.join(rank, "src").orderBy("rank", *ORDER)


def _few(edges: DataFrame, start: tuple[str, str], back: bool):
    """All edges behind (or before) a column as an Arrow table, hop by hop; None where that are more than SMALL.

    A hop looks its frontier up by name, and the models' names reach the scan: of a store sorted by target few row
    groups are read, of a union the branches that can hold the models.
    """
    import pyarrow as pa

    near, far = ("target", "source") if back else ("source", "target")
    spark, seen, frontier, parts, size = edges.sparkSession, {start}, {start}, [], 0
    while frontier:
        models = sorted({m for m, _ in frontier})
        if len(frontier) <= FEW:
            wanted = F.lit(False)
            for model in models:
                wanted = wanted | ((F.col(f"{near}_model") == model) & F.col(f"{near}_column").isin(sorted(c for m, c in frontier if m == model)))
            hop = edges.filter(wanted)
        else:
            listed = spark.createDataFrame(pa.table(dict(zip((f"{near}_model", f"{near}_column"), map(list, zip(*sorted(frontier)))))))
            hop = edges.filter(F.col(f"{near}_model").isin(models)).join(F.broadcast(listed), [f"{near}_model", f"{near}_column"], "left_semi")
        got = hop.select(*edges.columns).limit(SMALL - size + 1).toArrow()
        size += got.num_rows
        if size > SMALL:
            return None
        parts.append(got)
        frontier = set(zip(got[f"{far}_model"].to_pylist(), got[f"{far}_column"].to_pylist())) - seen
        seen |= frontier
    return pa.concat_tables(parts)


def _closure(edges: DataFrame, model: str, column: str, back: bool) -> tuple[DataFrame, DataFrame, tuple[str, str]]:
    """(edges among the nodes of a column's closure, in order; the closure's nodes (model, column) with it; the column)."""
    spark, start = edges.sparkSession, resolve(edges, model, column)
    rows = _few(edges, start, back)
    if rows is not None:
        import pyarrow as pa

        listed = [tuple(zip(rows[f"{e}_model"].to_pylist(), rows[f"{e}_column"].to_pylist())) for e in ("source", "target")]
        ends = sorted({*listed[0], *listed[1], start})
        level = _ordered(ends, list(zip(*listed)))
        ranked = rows.append_column("_rank", pa.array([level[n] for n in listed[0]], pa.int64())).sort_by([(c, "ascending") for c in ("_rank", *ORDER)])
        found = spark.createDataFrame(pa.table({"model": [m for m, _ in ends], "column": [c for _, c in ends]}))
        return spark.createDataFrame(ranked.drop_columns("_rank"), edges.schema), found, start
    graph = as_graph(edges)
    seeds = spark.createDataFrame([("\x1f".join(start),)], "node string")
    steps = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if back else graph.select("src", "dst")
    found = reachable(steps, seeds).union(seeds).distinct()
    # a closure holds all edges into its nodes (upstream) or out of them (downstream)
    end = "dst" if back else "src"
    inside, _ = written(graph.join(found.withColumnRenamed("node", end), end, "left_semi").select(*graph.columns), "graph-inside")
    return ordered_edges(inside).select(*edges.columns), _split(found), start


def trace(edges: DataFrame, model: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(edges, source_columns) upstream of a column: edges among its ancestors and it, in order; ancestors without sources of their own.

    A column without sources is its own source column.
    """
    inside, found, _ = _closure(edges, model, column, True)
    fed = inside.select(F.col("target_model").alias("model"), F.col("target_column").alias("column"))
    return inside, found.join(fed, ["model", "column"], "left_anti").orderBy("model", "column")


def impact(edges: DataFrame, model: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(edges, affected_columns) downstream of a column; the column itself isn't affected, unless a cycle leads back."""
    inside, found, start = _closure(edges, model, column, False)
    return inside, found.filter((F.col("model") != start[0]) | (F.col("column") != start[1])).orderBy("model", "column")


def _split(nodes: DataFrame) -> DataFrame:
    parts = F.split("node", "\x1f")
    return nodes.select(parts[0].alias("model"), F.coalesce(F.get(parts, 1), F.lit("")).alias("column"))


def edges_between(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Edges from one model to another; names as written."""
    return edges.filter((F.col("source_model") == source) & (F.col("target_model") == target))


def model_dependencies(edges: DataFrame, model: str) -> DataFrame:
    """(model): distinct models one step upstream, sorted, without itself."""
    return edges.filter((F.col("target_model") == model) & (F.col("source_model") != model)).select(F.col("source_model").alias("model")).distinct().orderBy("model")


def all_models(edges: DataFrame) -> DataFrame:
    return nodes_of(edges).select("model").distinct().orderBy("model")


def all_columns(edges: DataFrame, model: str) -> DataFrame:
    return nodes_of(edges).filter(F.col("model") == model).select("column").distinct().orderBy("column")


def search_columns(edges: DataFrame, text: str) -> DataFrame:
    """Columns that hold the text literally, without regard to case."""
    return nodes_of(edges).filter(F.lower("column").contains(text.lower())).orderBy("model", "column")


def transforms_by_type(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("transform_type") == kind)


def stats(edges: DataFrame) -> DataFrame:
    """One row (models, nodes, edges)."""
    n = nodes_of(edges).agg(F.countDistinct("model").alias("models"), F.count("*").alias("nodes"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges")))


def merged(edges: DataFrame) -> DataFrame:
    """One edge per pair of columns: the most significant transform, of equal ones the latest (by ord)."""
    from spindrift.functions.transforms import PRIORITY

    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[F.col("transform_type")], F.lit(0))
    names = [c for c in edges.columns if c not in ("source_model", "source_column", "target_model", "target_column")]
    best = edges.groupBy("source_model", "source_column", "target_model", "target_column").agg(F.max_by(F.struct(*names), F.struct(rank.alias("rank"), "ord")).alias("e"))
    return best.select("source_model", "source_column", "target_model", "target_column", "e.*").select(*edges.columns)


def first_wins(edges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one that came first."""
    names = [c for c in edges.columns if c not in keys]
    return edges.groupBy(*keys).agg(F.min_by(F.struct(*names), order).alias("e")).select(*keys, "e.*").select(*edges.columns)


def frames(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for graph libraries."""
    return nodes_of(edges), edges
