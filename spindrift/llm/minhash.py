"""Near-duplicate documents by DartMinHash signatures and banded joining."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import GOLDEN, batches, components, discard, fresh, mix64, salt, shingle_counts, short_batches, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 20
ROWS = 5
#: Where components of one band are compared with each other, blocks of about this many texts, or characters, meet at a time.
BLOCK = 512
BLOCK_CHARS = 1 << 20
COLUMNS = 4096


def dart_signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k coordinates per document: the id of the earliest dart; second result: which documents have any weight.

    Every element's weight axis is cut into the strips [0,1), [1,2), [2,4), ...; each strip throws a Poisson
    stream of darts whose arrival times, heights and coordinates depend only on the element, the strip and the
    dart's number. A dart counts if its height is under the element's weight. Two documents thus see the same
    darts in the region that they share, and a coordinate agrees with the probability of their weighted Jaccard
    similarity. The time limit starts where about k (ln k + 3) darts fall and doubles for documents that still
    miss a coordinate.
    """
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    sig = np.zeros((n_docs, k), np.uint64)
    have = total > 0
    limit = np.zeros(n_docs)
    limit[have] = k * (math.log(k) + 3) / total[have]
    todo = have.copy()
    while todo.any():
        slots, times, ids = [], [], []
        pick = todo[doc]
        e, d, w = element[pick], doc[pick], weight[pick].astype(np.float64)
        strip = 0
        while len(e):
            low, high = (0.0, 1.0) if strip == 0 else (2.0 ** (strip - 1), 2.0**strip)
            keep = w > low
            e, d, w = e[keep], d[keep], w[keep]
            seed, dd, ww, time = mix64(e + salt(strip + 1)), d, w, np.zeros(len(e))
            number = 0
            while len(seed):
                number += 1
                h = mix64(seed + salt(number))
                time = time - np.log1p(-(h >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (high - low)
                on = time <= limit[dd]
                seed, dd, ww, time, h = seed[on], dd[on], ww[on], time[on], h[on]
                dart = mix64(h ^ GOLDEN)
                height = low + (high - low) * (dart & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
                hit = height < ww
                slots.append(dd[hit].astype(np.int64) * k + (((dart >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)[hit])
                times.append(time[hit])
                ids.append(mix64(dart + np.uint64(1))[hit])
            strip += 1
        slot, time, dart = np.concatenate(slots), np.concatenate(times), np.concatenate(ids)
        order = np.argsort(-time, kind="stable")  # the earliest is written last
        found = np.zeros(n_docs * k, bool)
        found[slot] = True
        flat = sig.reshape(-1)
        flat[slot[order]] = dart[order]
        todo &= ~found.reshape(n_docs, k).all(axis=1)
        limit[todo] *= 2
    return sig, have


def _bands(size: int, bands: int, rows: int):
    def run(stream):
        import pyarrow as pa

        for batch in batches(stream, "text"):
            e, d, n = shingle_counts(batch.column("text"), size)
            sig, have = dart_signatures(e, d, n, batch.num_rows, bands * rows)
            acc = np.zeros((batch.num_rows, bands), np.uint64)
            for r in range(rows):
                acc = mix64(acc + sig.reshape(-1, bands, rows)[:, :, r] + salt(r + 1))
            acc = mix64(acc + np.arange(bands, dtype=np.uint64) * GOLDEN)[have].view(np.int64)
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(have * bands, out=offsets[1:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), batch.column("chars"), pa.ListArray.from_arrays(offsets, acc.reshape(-1))], ["doc_id", "node", "chars", "bands"])

    return run


def _similar(size: int, threshold: float):
    def run(stream):
        import pyarrow as pa

        for batch in batches(stream, "text_a", "text_b"):
            ea, da, na = shingle_counts(batch.column("text_a"), size)
            eb, db, nb = shingle_counts(batch.column("text_b"), size)
            n = batch.num_rows
            key = np.concatenate([mix64(ea + da.astype(np.uint64) * GOLDEN), mix64(eb + db.astype(np.uint64) * GOLDEN)])
            count, doc = np.concatenate([na, nb]), np.concatenate([da, db])
            order = np.argsort(key, kind="stable")
            key, count, doc = key[order], count[order], doc[order]
            same = np.flatnonzero(key[1:] == key[:-1])
            shared = np.bincount(doc[same], weights=np.minimum(count[same], count[same + 1]), minlength=n)
            every = np.bincount(da, weights=na, minlength=n) + np.bincount(db, weights=nb, minlength=n) - shared
            ok = (every > 0) & (shared >= threshold * every - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


def _crossed(size: int, threshold: float):
    """Links between components within each run of rows of one block pair, at most one row per merge."""

    def group(rows, cross):
        import pyarrow as pa

        node, part, component, text = zip(*rows)
        m = len(node)
        label = np.unique(np.array([c.hex() for c in component]), return_inverse=True)[1]
        if label.max() == 0:
            return []
        # a counted shingle is as many elements as its count, so shared elements are the shared weight
        e, d, n = shingle_counts(pa.array(text, pa.large_string()), size)
        total = np.bincount(d, weights=n, minlength=m)
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = mix64(np.repeat(e, n) + turn.astype(np.uint64) * GOLDEN)
        of = np.repeat(d, n)
        _, ids, seen = np.unique(key, return_inverse=True, return_counts=True)
        common = np.cumsum(seen > 1) - 1
        on = seen[ids] > 1
        column, row = common[ids[on]], of[on]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        shared = np.zeros((m, m), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, (low, low + COLUMNS))
            hold = np.zeros((m, COLUMNS), np.float32)
            hold[row[a:b], column[a:b] - low] = 1
            shared += hold @ hold.T
        near = np.triu(shared >= threshold * (total[:, None] + total[None, :] - shared) - 1e-6, 1) & (label[:, None] != label[None, :]) & (total[:, None] > 0)
        if cross:
            p = np.array(part)
            near &= p[:, None] != p[None, :]
        out = []
        for x, y in zip(*np.nonzero(near)):
            if label[x] != label[y]:
                out.append((node[x], node[y]))
                label[label == label[y]] = label[x]
        return out

    def run(stream):
        import pyarrow as pa

        key, rows = None, []
        for batch in batches(stream, "text"):
            out = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "node", "part", "component", "text"))):
                if r[:3] != key:
                    if len(rows) > 1:
                        out += group(rows, key[1] != key[2])
                    key, rows = r[:3], []
                rows.append(r[3:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])
        if len(rows) > 1 and (out := group(rows, key[1] != key[2])):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])

    return run


def grouped(docs: DataFrame, size: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, component) per row of docs; component is the least node that links join to the row's."""
    spark = docs.sparkSession
    short_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({"node": F.unhex(F.md5("text")), "chars": F.length("text")})
    sig, sig_path = written(base.mapInArrow(_bands(size, bands, rows), "doc_id long, node binary, chars int, bands array<long>"), "minhash-sig")
    nodes = sig.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("chars").alias("chars"), F.first("bands").alias("bands"))
    rows_of, rows_path = written(nodes.select("node", "rep", "chars", F.explode("bands").alias("band")), "minhash-bands")
    shared = rows_of.groupBy("band").agg(F.count("*").alias("n"), F.sum("chars").alias("all_chars")).filter("n > 1")
    members, members_path = written(rows_of.join(shared, "band").select("band", "node", "rep", "n"), "minhash-members")
    # the hub is the member that meets the most others over all its bands: the text that a group's copies come from
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = members.join(score, "node").groupBy("band").agg(F.max(F.struct("score", "node"))["node"].alias("hub"))
    placed, placed_path = written(members.select("band", "node").join(hubs, "band"), "minhash-placed")
    star = placed.filter("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    wanted = members.select("node", "rep").distinct()
    # one row per wanted node: any row of the text with its smallest doc_id
    texts = base.join(wanted.hint("shuffle_hash"), (base.node == wanted.node) & base.doc_id.eqNullSafe(wanted.rep)).select(base.node, "text")
    texts, texts_path = written(texts, "minhash-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(a, "a").join(b, "b").mapInArrow(_similar(size, threshold), "a binary, b binary").distinct()

    edges, edges_path = written(verified(star), "minhash-star")
    label = components(edges, "minhash-star-cc")
    # members of one band in different components: the pairs that the comparison with the hub leaves open
    placed = placed.join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"), "hub")
    open_bands = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band")
    left = placed.join(open_bands.join(shared, "band"), "band").withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all_chars") / BLOCK_CHARS)).cast("int"))
    left = left.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "component")
    dealt = left.join(texts, "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")
    more, more_path = written(dealt.mapInArrow(_crossed(size, threshold), "a binary, b binary").distinct(), "minhash-cross")
    final = components(edges.union(more), "minhash-cc")
    discard(spark, rows_path, members_path, placed_path, texts_path, edges_path, more_path)
    # written before it is joined by component, so that the rows of a large group can be split there
    return written(sig.join(final, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component")), "minhash-rows")[0]


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row (doc_id, node, component_id, kept) per row of docs (doc_id, text; other columns are ignored).

    Texts are lower-cased and cut into words (ASCII letters, digits, non-ASCII characters); the similarity of two
    texts is the weighted Jaccard of their counted five-word shingles, and links are pairs of at least the
    threshold, verified exactly. component_id is the smallest doc_id among the rows whose texts are joined by
    links, kept marks the rows that hold it (so repeated rows of one doc_id and text are all marked).

    Equal texts are one node from the start (md5 of the bytes), so groups of copies cost a row per copy. Within a
    band every member is compared with a hub, the member that meets most others over all bands. Only bands whose
    members thereby end in different components go on: these are compared block by block, each two blocks in a task
    of their own, which gives out one row per merge and no row per pair. A band's blocks are as many as its texts'
    number or characters need. A pair at the threshold shares no band less than once in 2,000.

    Null text: as empty. A text without words equals only byte-identical texts. Null doc_id: its row takes part and
    has the component of its text; kept is then true only if no row of the component has a doc_id. Empty input:
    empty result.
    """
    by_node = grouped(docs, size, threshold, bands, rows)
    least, _ = written(by_node.groupBy("component").agg(F.min("doc_id").alias("component_id")), "minhash-least")
    return by_node.join(least, "component").select("doc_id", "node", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, *, size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates the row with the smallest doc_id.

    All columns are returned as they are. Exactly one row stays of every group: of equal doc_ids the one whose text
    has the smallest md5, of repeated rows with that doc_id and text any; rows without doc_id stay only if no row of
    their group has one. Groups are told apart by their texts, so that a doc_id may occur in several.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    one = grouped(docs, size, threshold, bands, rows).groupBy("component").agg(first.alias("o")).select(F.col("o.node").alias("_node"), F.col("o.doc_id").alias("_id"))
    node, id = fresh(docs, "_node"), fresh(docs, "_id")
    keyed = docs.withColumns({node: F.unhex(F.md5(F.coalesce("text", F.lit("")))), id: F.col("doc_id").cast("long")})
    o, k = one.select("_node", "_id").alias("o"), keyed.alias("k")
    hit = k.join(o.hint("shuffle_hash"), (F.col(f"k.{node}") == F.col("o._node")) & F.col(f"k.{id}").eqNullSafe(F.col("o._id"))).select("k.*")
    return hit.dropDuplicates([node, id]).select(*docs.columns)
