"""Near-duplicate vectors: codes by iterative quantisation, multi-index tables, exact cosine afterwards."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import components, discard, written

THRESHOLD = 0.98
#: Fewest bits by which a table looks vectors up. Bits grow so that random vectors of a label are spread over buckets of about FULL.
BITS, FULL = 12, 16
#: As many tables are made as leave a pair at the threshold without a common bucket so seldom.
MISSED = 1e-4
#: Vectors of which the rotation is learnt; every vector is indexed.
SAMPLE = 4000
ROUNDS = 20
#: A bucket with more members is dealt into blocks of about this many, compared block by block.
BLOCK = 2048
#: Runs of at most so many rows are compared many at a time.
SHORT = 48


def tables_for(bits: int, threshold: float = THRESHOLD) -> int:
    """Tables of so many bits that a pair at the threshold needs: a bit differs with the share of its angle in a half turn."""
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if same >= 1 - MISSED else math.ceil(math.log(MISSED) / math.log1p(-same))


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 11) -> np.ndarray:
    """Projections: columns whose signs are the code's bits.

    Each group of as many bits as dimensions is one orthogonal rotation. It starts at random and is turned in
    alternation: signs of the rotated sample, then the rotation that comes nearest to those signs (a Procrustes
    problem). A sample too small to learn from leaves the random rotation. Vectors aren't centred: the angle between
    two of them, which decides how many bits differ, is then the one that the cosine tells.
    """
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    groups = []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(ROUNDS if n >= 2 * d else 0):
            codes = np.where(sample @ r >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(sample.T @ codes)
            r = u @ v
        groups.append(r)
    return np.concatenate(groups, axis=1)[:, :bits]


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 in double precision, and which of them have a direction at all."""
    ok = np.isfinite(x).all(axis=1)
    x = np.where(ok[:, None], x, 0)
    most = np.abs(x).max(axis=1, initial=0)
    ok &= most > 0
    x = x / np.where(ok, most, 1)[:, None]
    return x / np.where(ok, np.sqrt((x * x).sum(axis=1)), 1)[:, None], ok


def _by_size(column):
    """(rows, matrix) for each length of the vectors of an Arrow list column; null components are NaN, null and empty vectors are left out."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        yield rows, values[starts[rows][:, None] + np.arange(size)]


def _noted(stream):
    """Identity of every vector: digest of its label and values; null where it can't link."""
    import pyarrow as pa

    for batch in stream:
        labels = batch.column("label").to_pylist()
        nodes: list[bytes | None] = [None] * batch.num_rows
        for rows, x in _by_size(batch.column("embedding")):
            x += 0.0  # one zero
            for i, raw, ok in zip(rows.tolist(), x, _unit(x)[1]):
                if ok and labels[i] is not None:
                    nodes[i] = hashlib.md5(f"{labels[i]}:".encode() + raw.tobytes()).digest()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.binary()), batch.column("label"), batch.column("embedding")], ["vec_id", "node", "label", "embedding"])


def _indexed(learnt: dict[int, np.ndarray], tables: int, bits: int):
    def run(stream):
        import pyarrow as pa

        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in stream:
            keys = np.zeros((batch.num_rows, tables), np.int64)
            for rows, x in _by_size(batch.column("embedding")):
                size = x.shape[1]
                turn = learnt[size] if size in learnt else learn_rotations(np.zeros((0, size)), tables * bits)
                keys[rows] = (_unit(x)[0] @ turn >= 0).reshape(len(rows), tables, bits) @ weights
            flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), keys.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "label", "size", "copies", "embedding")] + [flat], ["node", "label", "size", "copies", "embedding", "keys"])

    return run


def _compared(threshold: float):
    """Links within each run of rows of one group: per vector its partners' copies and the first of the run that it reaches."""
    names = ["label", "size", "table", "key", "i", "j"]

    def pairs(x, run, lengths):
        """Row numbers of near pairs: of short runs at each distance at once, of a longer one by its matrix product."""
        small = lengths <= SHORT
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for s in range(1, int(lengths[small].max(initial=0))):
            a = np.flatnonzero((run[s:] == run[:-s]) & small[run[:-s]])
            a = a[np.einsum("ij,ij->i", x[a], x[a + s]) >= threshold]
            found.append((a, a + s))
        starts = np.cumsum(lengths) - lengths
        for r in np.flatnonzero(~small):
            own = slice(starts[r], starts[r] + lengths[r])
            a, b = np.nonzero(np.triu(x[own] @ x[own].T >= threshold, 1))
            found.append((a + starts[r], b + starts[r]))
        return (np.concatenate(c) for c in zip(*found))

    def linked(rows, run, lengths):
        """(nodes, links, peers) of the runs of a table of rows."""
        import pyarrow as pa

        out_links, root = np.zeros(len(run), np.int64), np.arange(len(run))
        part, i, j, table, copies = (rows[c].to_numpy() for c in ("part", "i", "j", "table", "copies"))
        keys = rows["keys"].combine_chunks()
        keys = keys.flatten().to_numpy().reshape(len(run), -1)
        for at, x in _by_size(rows["embedding"]):
            # a run has vectors of one length only
            kept, own = np.unique(run[at], return_inverse=True)
            a, b = (at[c] for c in pairs(_unit(x)[0], own, lengths[kept]))
            on = ((i[a] == j[a]) | (part[a] != part[b])) & ((keys[a] == keys[b]).argmax(axis=1) == table[a])  # a pair counts in the first table where it meets
            a, b = a[on], b[on]
            out_links += np.bincount(a, copies[b], len(run)).astype(np.int64) + np.bincount(b, copies[a], len(run)).astype(np.int64)
            while True:
                low = np.minimum(root[a], root[b])
                before = root.copy()
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                root = root[root]
                if (root == before).all():
                    break
        on = np.flatnonzero(out_links)
        node = rows["node"]
        return pa.RecordBatch.from_arrays([node.take(pa.array(on)).combine_chunks(), pa.array(out_links[on]), node.take(pa.array(root[on])).combine_chunks()], ["node", "links", "peer"])

    def run(stream):
        import pyarrow as pa

        open_run = None
        for batch in stream:
            rows = pa.Table.from_batches([batch])
            rows = rows if open_run is None else pa.concat_tables([open_run, rows])
            new = np.zeros(rows.num_rows, bool)
            for c in names:
                column = rows[c].combine_chunks().dictionary_encode().indices if c == "label" else rows[c]
                values = column.to_numpy()
                new[1:] |= values[1:] != values[:-1]
            # the last run may go on in the next batch
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0
            open_run = rows.slice(last)
            if last:
                run_of = np.cumsum(new[:last])
                yield linked(rows.slice(0, last).combine_chunks(), run_of, np.bincount(run_of))
        if open_run is not None and open_run.num_rows:
            n = open_run.num_rows
            yield linked(open_run.combine_chunks(), np.zeros(n, np.int64), np.array([n]))

    return run


def near_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, bits: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, label, embedding).

    Two rows link if their labels are equal and the cosine in double precision is at least threshold. Vectors that
    are null, empty or zero, or hold null or non-finite components, and rows without label link with nothing, as do
    vectors of different length. n_links counts other rows; component_id is the smallest vec_id reached; kept marks
    the rows that hold it. Null vec_id: the row takes part, its component has the smallest id there is, or null.
    Other columns are ignored; a repeated vec_id gives a row each time.

    Equal vectors of a label are one node with a number of copies. A node is indexed in every table by its own bits
    of the code; members of a bucket are compared exactly, and a pair counts in the first table where it meets. Bits
    grow with the logarithm of the largest label's nodes and tables with the bits, so that a pair at the threshold
    misses all tables less than once in 10,000 for random rotations, while buckets stay small. Large buckets are dealt
    into blocks, and every two blocks meet in a task of their own; links leave a task as sums and local components,
    so no row is made per pair.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    noted, _ = written(base.mapInArrow(_noted, "vec_id long, node binary, label string, embedding array<double>"), "vectors")
    nodes = noted.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("size", F.size("embedding"))
    nodes, nodes_path = written(nodes, "vector-nodes")
    if bits is None:
        most = nodes.groupBy("label", "size").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        bits = min(60, max(BITS, math.ceil(math.log2(max(1, most / FULL)))))
    tables = tables_for(bits, threshold)
    learnt = {rows_x[1].shape[1]: learn_rotations(_unit(rows_x[1])[0], tables * bits) for rows_x in _by_size(nodes.orderBy("node").limit(sample).select("embedding").toArrow()["embedding"])}
    index = nodes.mapInArrow(_indexed(learnt, tables, bits), "node binary, label string, size int, copies long, embedding array<double>, keys array<long>")
    index, index_path = written(index, "vector-index")
    bucket = ["label", "size", "table", "key"]
    slots = index.select("node", "label", "size", F.posexplode("keys").alias("table", "key"))
    counts = slots.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1")
    met = slots.join(counts, bucket).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*bucket, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node")
    full = met.join(index.select("node", "copies", "embedding", "keys"), "node")
    dealt = full.repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j", "node")
    links, links_path = written(dealt.mapInArrow(_compared(threshold), "node binary, links long, peer binary"), "vector-links")
    label = components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")), "vector-cc")
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies").join(degree, "node", "left").join(label, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    known, _ = written(known, "vector-known")
    # the table of all rows is one side of each join and the other side has a row per key, so that a hot key's rows can be split
    rows, _ = written(noted.select("vec_id", "node").join(known, "node", "left"), "vector-rows")
    least, _ = written(rows.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("least")), "vector-least")
    out = rows.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    discard(spark, index_path, links_path, nodes_path)
    return out
