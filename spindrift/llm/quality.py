"""Quality classifier: averaged hashed word and character n-gram vectors under a softmax, trained by SGD in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import BASE, GOLDEN, batches, mix64, powers, salt, short_batches, string_bytes

BUCKETS = 1 << 15
DIMENSIONS = 8
GRAMS = (3, 4)
#: At most so many labelled documents are gathered for training, the smallest by hash of their text.
TRAINING_DOCS = 3000
EPOCHS = 8
RATE = 4.0
BATCH = 16
SEED = 7
#: Bytes of texts that are featurised at a time.
SEGMENT = 1 << 18
TOKEN = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def features(column, segment: int = SEGMENT):
    """Pieces (bucket, text number) of all features of the texts; together they hold each feature as often as it occurs.

    A text has its tokens between white space, the 3- and 4-grams of bytes within a token with its bounds, and one
    feature that every text has. Case and punctuation are kept, as they tell junk from prose.

    The bytes are taken in segments that cut long texts and long tokens too (a token's hash is carried on), so that
    beside the texts themselves only a segment's arrays are held.
    """
    data, offsets = string_bytes(column)
    n = len(offsets) - 1
    yield np.full(n, 1, np.int32), np.arange(n, dtype=np.int32)
    # texts side by side, a blank before each and one behind the last
    place = offsets[:-1] + np.arange(n)
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    body = np.ones(len(padded), bool)
    body[place] = False
    body[-1] = False
    padded[body] = data
    del body
    owner = lambda at: (np.searchsorted(place, at, "right") - 1).astype(np.int32)
    bucket = lambda h: ((h >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int32)
    up, down = powers(segment + 1)
    open_hash, open_length = 0, 0
    for a in range(0, len(padded), segment):
        part = padded[a : a + segment + max(GRAMS) - 1]
        m = min(segment, len(padded) - a)
        inside = TOKEN[part]
        symbol = np.where(inside, part, 32).astype(np.uint64)
        for g in GRAMS:
            ok = np.ones(max(0, min(m, len(part) - g + 1)), bool)
            for k in range(1, g - 1):
                ok &= inside[k : k + len(ok)]
            at = np.flatnonzero(ok)
            acc = np.full(len(at), salt(g), np.uint64)
            for k in range(g):
                acc = acc * np.uint64(0x100000001B3) + symbol[at + k]
            yield bucket(mix64(acc)), owner(a + at)
        own = inside[:m]
        before = np.append(open_length > 0, own[:-1])
        starts, ends = np.flatnonzero(own & ~before), np.flatnonzero(~own & before)
        h = np.zeros(m + 1, np.uint64)
        np.cumsum((part[:m].astype(np.uint64) + np.uint64(1)) * up[:m], out=h[1:])
        if open_length:
            to = int(ends[0]) if len(ends) else m
            open_hash = (open_hash + int(h[to]) * pow(BASE, open_length, 1 << 64)) % (1 << 64)
            open_length += to
            if not len(ends):
                continue
            yield bucket(mix64(np.array([(open_hash + open_length * int(GOLDEN)) % (1 << 64)], np.uint64))), owner(np.array([a + to - 1]))
            ends = ends[1:]
        open_hash, open_length = 0, 0
        if len(starts) > len(ends):
            s = int(starts[-1])
            open_hash, open_length = (int(h[m]) - int(h[s])) * int(down[s]) % (1 << 64), m - s
            starts = starts[:-1]
        yield bucket(mix64((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)), owner(a + ends - 1)


def _counted(stream):
    """Feature counts of labelled texts, as bytes."""
    import pyarrow as pa

    for batch in batches(stream, "text"):
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for bucket, doc in features(batch.column("text")):
            k, c = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            key, at = np.unique(np.concatenate([key, k]), return_inverse=True)
            count = np.bincount(at, np.concatenate([count, c]), len(key)).astype(np.int64)
        cuts = np.searchsorted(key, np.arange(batch.num_rows + 1) * BUCKETS)
        ids, counts = (key % BUCKETS).astype(np.uint16), np.minimum(count, 2**31 - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]), pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])], ["quality", "ids", "counts"])


def trained(rows: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """The share that each bucket adds to the log-odds of label 1, per feature of a document.

    Embeddings and the softmax layer are trained together; as a document is the mean of its vectors, both then fold
    into one number per bucket.
    """
    rng = np.random.default_rng(SEED)
    e = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    w = np.zeros((DIMENSIONS, 2))
    docs = []
    for label, ids, counts in rows:
        c = np.frombuffer(counts, np.int32)
        docs.append((int(label), np.frombuffer(ids, np.uint16).astype(np.int64), c / c.sum()))
    steps = EPOCHS * -(-len(docs) // BATCH)
    step = 0
    for _ in range(EPOCHS if docs else 0):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            part = [docs[i] for i in order[a : a + BATCH]]
            sizes = np.array([len(p[1]) for p in part])
            ids, share = np.concatenate([p[1] for p in part]), np.concatenate([p[2] for p in part])
            vectors = e[ids]
            hidden = np.add.reduceat(vectors * share[:, None], np.cumsum(sizes) - sizes, axis=0)
            logits = hidden @ w
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), [x[0] for x in part]] -= 1
            back = np.repeat(p @ w.T, sizes, axis=0) * share[:, None]
            w -= rate / len(part) * (hidden.T @ p)
            for k in range(DIMENSIONS):
                e[:, k] -= rate * np.bincount(ids, back[:, k], BUCKETS)
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float64)


def held_out(doc_id):
    """Documents that training never sees; a null doc_id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = TRAINING_DOCS) -> np.ndarray:
    """Train on at most sample labelled documents outside the held-out fifth.

    docs (doc_id, text), labels (doc_id, quality); labels that are null, neither 0 nor 1, or differ for a doc_id are
    left out. The sample takes the smallest hashes of doc_id, so it is the same for the same rows.
    """
    known = labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).filter("quality = top")
    known = known.filter(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("quality").cast("int").alias("quality"))
    ids = known.collect()  # sample rows at most
    spark = docs.sparkSession
    short_batches(spark)
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, quality int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("quality", "text")
    # a doc_id may repeat in docs: the smallest hashes of text bound what is gathered
    rows = texts.mapInArrow(_counted, "quality int, ids binary, counts binary").orderBy(F.xxhash64("ids", "counts"), "quality").limit(sample).collect()
    return trained([tuple(r) for r in rows])


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a column score (or another name), the probability of label 1; only the text decides. Null text: as empty.

    All columns stay as they are; one of the new column's name is replaced.
    """
    from pyspark.sql.types import StructType

    short_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != score]
    names = [f.name for f in kept]
    shared = weights.astype(np.float64)

    def run(stream):
        import pyarrow as pa

        for batch in batches(stream, text):
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for bucket, doc in features(batch.column(text)):
                total += np.bincount(doc, shared[bucket], batch.num_rows)
                n += np.bincount(doc, minlength=batch.num_rows)
            odds = total / n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(1 / (1 + np.exp(-np.clip(odds, -700, 700))))], [*names, score])

    return docs.mapInArrow(run, StructType(kept).add(score, "double"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = TRAINING_DOCS, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs; predicted is 1 from the threshold on.

    Without labelled documents every score is 0.5. See fit and scored for nulls and repeated rows.
    """
    weights = fit(docs, labels, sample)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(base, weights)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
