"""Shared pieces of the corpus operators: vectorised word hashing, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.shared import discard, written

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Odd multiplier of the rolling byte hash and its inverse modulo 2**64.
BASE = 0x00000100000001B3 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
SEGMENT_BYTES = 1 << 19


def salt(k: int) -> np.uint64:
    """The k-th step of a Weyl sequence."""
    return np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = "_" + name
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift multiply)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_table() -> np.ndarray:
    """True for bytes inside a word: ASCII letters and digits, and every byte of a non-ASCII character."""
    t = np.zeros(256, bool)
    for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        t[a : b + 1] = True
    return t


WORD = word_table()
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        m = max(n, SEGMENT_BYTES + 4096)
        for k, b in (("p", BASE), ("q", BASE_INV)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of every word, and the number of words of every text.

    table tells the bytes inside a word. The bytes are handled in segments cut between words, so memory doesn't grow with the longest text.
    """
    n = len(data)
    inside = table[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + SEGMENT_BYTES, "right")))
        stop = ends[to - 1]
        p, q = powers(stop - begin + 1)
        h = np.zeros(stop - begin + 1, np.uint64)
        np.cumsum((data[begin:stop].astype(np.uint64) + np.uint64(1)) * p[: stop - begin], out=h[1:])
        s, e = starts[at:to] - begin, ends[at:to] - begin
        hashes[at:to] = mix64((h[e] - h[s]) * q[s] + (e - s).astype(np.uint64) * GOLDEN)
        at = to
    docs = (np.searchsorted(offsets, starts, "right") - 1).astype(np.int32)
    return hashes, docs, np.bincount(docs, minlength=len(offsets) - 1)


def shingle_counts(column, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of lower-cased texts: hash, text number and count, ordered by text.

    A text of fewer words than size (but at least one) has one shingle of all of them.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    data, offsets = string_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    words, docs, counts = word_hashes(data, offsets)
    total = len(words)
    acc = np.zeros(total, np.uint64)
    length = np.minimum(counts, size)[docs] if total else np.zeros(0, np.int64)
    firsts = np.zeros(len(counts), np.int64)
    firsts[1:] = np.cumsum(counts)[:-1]
    rest = (firsts + counts)[docs] - np.arange(total) if total else np.zeros(0, np.int64)
    for k in range(size):
        m = max(0, total - k)
        step = mix64(words[k:] + salt(k + 1))
        acc[:m] += np.where(k < length[:m], step, np.uint64(0))
    valid = rest >= length
    acc, docs = mix64(acc[valid]), docs[valid]
    key = mix64(acc + docs.astype(np.uint64) * GOLDEN)
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(key)))
    at = order[at]
    by_doc = np.argsort(docs[at], kind="stable")
    return acc[at][by_doc], docs[at][by_doc], n[by_doc]


#: Bytes of text that are worked on at a time; rows and bytes that travel to Python at a time.
SLICE, ROWS_PER_BATCH, BYTES_PER_BATCH = 1 << 20, 1000, 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Let batches of at most so many rows and bytes travel to Python in this session: rows hold whole texts.

    Smaller numbers that the session has set stay. Both sides of the pipe hold a batch outside the heap.
    """
    for name, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        now = int("".join(c for c in spark.conf.get(f"spark.sql.execution.arrow.{name}") if c.isdigit()))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept between tasks and would hold it while idle."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def batches(stream, *texts: str, limit: int = SLICE):
    """Slices of Arrow batches holding about limit bytes of the named text columns each (at least one row)."""
    import pyarrow.compute as pc

    for batch in stream:
        if not batch.num_rows:
            continue
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(t)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(sizes))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for every node that has an edge.

    Rounds of min-label hooking and pointer jumping, each written to the shared folder; only the count of
    changed labels reaches the driver. Every aggregate combines before its shuffle, so a hub is no hot task.
    """
    spark = edges.sparkSession
    both, kept = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), f"{name}-edges")
    label, path = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{name}-0")
    for turn in range(1, 200):
        of = label.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("of_b").alias("m"))
        seen = label.join(near, "node").select("node", "component", F.least("component", "m").alias("m"))
        # a label's own node learns what any node under it saw, then every node follows its new label once
        hook = seen.groupBy(F.col("component").alias("node")).agg(F.min("m").alias("h"))
        hooked = seen.join(hook, "node", "left").select("node", F.col("component").alias("old"), F.least("m", F.coalesce("h", "m")).alias("new"))
        hooked, mid = written(hooked, f"{name}-h{turn}")
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("up"))
        after = hooked.join(jump, "new").select("node", F.least("new", "up").alias("component"), (F.least("new", "up") != F.col("old")).alias("moved"))
        after, new_path = written(after, f"{name}-{turn}")
        moved = after.filter("moved").limit(1).count()
        discard(spark, path, mid)
        label, path = after.select("node", "component"), new_path
        if not moved:
            discard(spark, kept)
            return label
    raise RuntimeError("components didn't settle in 200 rounds")
