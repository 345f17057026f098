"""Benchmark decontamination by spaced seeds: DataFrame functions only."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import fresh, written

#: Words of a block; an item is cut into blocks from its first word on.
BLOCK = 3
#: A stretch counts its equal words, less so much for each differing one.
MISMATCH = 4
#: A stretch of this score is an overlap; 12 equal words, or 16 with one differing.
ENOUGH = 12
#: So much of a whole item on one diagonal is an overlap too.
SHARE = 0.8
#: Items of fewer words are left out; 1 leaves none out.
LEAST_WORDS = 1
#: Items of so many words have too few blocks. None of up to four words may differ: one mask of them all. Up to eight
#: words: a mask for each word that may differ. 10 and 11 words, of which two may differ: three of the five pairs that
#: the first ten words are cut into.
SHORT = {n: ["1" * n] for n in range(1, 5)}
SHORT |= {n: ["1" * i + "0" + "1" * (n - i - 1) for i in range(n)] for n in range(5, 9)}
SHORT |= {10: ["".join("11" if i in c else "00" for i in range(5)) for c in itertools.combinations(range(5), 3)]}
#: With at most so many seeds the benchmark is broadcast, else both sides are shuffled.
BROADCAST_SEEDS = 1_000_000


def words_of(text: Column) -> Column:
    """The lower-cased words: ASCII letters and digits and all non-ASCII characters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def places(words: Column, span: int) -> Column:
    """A row for every place where span words are left."""
    last = F.size(words) - span
    return F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")))


def hashed(words: Column, at: Column, offsets) -> Column:
    """One hash of the words at these distances from a place."""
    return F.xxhash64(*(F.get(words, at + k) for k in offsets))


def pair_seeds(words: Column, at: Column, gaps: int) -> Column:
    """Seeds of the block at a place with the blocks 1, 2, ... gaps further on; null where the second block is missing.

    Each is a spaced seed: a mask that picks a block at either end and ignores the words between them.
    """
    seed = lambda g: F.when(F.size(words) >= at + BLOCK * (g + 1), F.xxhash64(F.lit(g), *(F.get(words, at + k) for k in (*range(BLOCK), *range(BLOCK * g, BLOCK * (g + 1))))))
    return F.array(*(seed(g) for g in range(1, gaps + 1)))


def anchor(mask: str) -> int:
    """The place of the first two neighbouring words that a mask picks (of a single word: of that)."""
    return max(mask.find("11"), 0)


def mask_seeds(words: Column, at: Column, masks: list[str]) -> Column:
    """(seed, start) of the windows under masks whose anchor lies at a place; seed is null where a picked word is missing.

    Ignored words may lie outside the text.
    """
    found = []
    for m in masks:
        start = at - anchor(m)
        picked = [F.get(words, start + k) for k, c in enumerate(m) if c == "1"]
        fits = (start + m.find("1") >= 0) & (F.size(words) > start + m.rfind("1"))
        found.append(F.struct(F.when(fits, F.xxhash64(F.lit(m), *picked)).alias("seed"), start.alias("start")))
    return F.array(*found)


def needed_gap(n: Column) -> Column:
    """The distance at which any overlap with an item of n words has two equal blocks; null for the lengths of SHORT.

    SHARE lets n // 5 words differ, each in one of the n // 3 blocks; of the others two lie no further apart than
    they do on the average. A stretch of score ENOUGH has two at a distance of at most 2.
    """
    t = F.floor(n / BLOCK)
    clean = t - F.floor(n * (1 - SHARE) + 1e-6)
    return F.when(clean >= 2, F.greatest(F.floor((t - 1) / (clean - 1)), F.lit(2))).cast("int")


def items_of(benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Distinct items (item, item_id, item_words) of at least so many words."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    b = b.select(F.md5(F.concat_ws(":", F.col("item_id").cast("string"), "text")).alias("item"), "item_id", words_of(F.col("text")).alias("item_words"))
    return b.filter(F.size("item_words") >= max(1, least_words))


def overlap(words: Column, item: Column, shift: Column) -> Column:
    """(score, equal): the best stretch's score and all equal words of an item laid on the words at a shift."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("score"), F.lit(0).alias("equal"))

    def step(acc: Column, i: Column) -> Column:
        same = F.coalesce(F.get(words, i + shift) == F.get(item, i), F.lit(False))
        now = F.greatest(acc["now"] + F.when(same, 1).otherwise(-MISMATCH), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["score"], now).alias("score"), (acc["equal"] + same.cast("int")).alias("equal"))

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), zero, step)


def overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(node, item_id, score): verified overlaps of texts (node: md5 of the text) with benchmark items.

    Seeds name an item and a shift: two equal blocks of an item at one distance, or for items of few words the masks
    of SHORT. They miss no stretch of score ENOUGH and no SHARE of an item. Each (text, item, shift) is then
    verified word by word: a stretch of score ENOUGH, or SHARE of the item.

    A benchmark of few seeds is broadcast: then a text's places are only compared where their first block (or two
    words of a mask) occurs in the benchmark, and hits are verified in the row that found them, without a shuffle of
    texts. Of the hits that follow each other block by block on one diagonal, the first is verified.
    """
    size = F.size("item_words")
    items = items_of(benchmark, least_words)
    gap = needed_gap(size)
    short = F.when(gap.isNull(), F.when(size == 11, 10).otherwise(size))
    sizes = items.agg(F.sum(size).alias("words"), F.max(gap).alias("gaps"), F.collect_set(short).alias("short")).first()
    small = (sizes["words"] or 0) * max(sizes["gaps"] or 0, *(len(SHORT[n]) for n in sizes["short"]), 1) <= BROADCAST_SEEDS
    base = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), words_of(F.col("text")).alias("words"))
    words, theirs, at = F.col("words"), F.col("item_words"), F.col("at")

    def met(ours: DataFrame, wanted: DataFrame) -> DataFrame:
        ours = ours.filter("seed is not null")
        if small:
            return ours.join(F.broadcast(wanted), "seed").select("node", "words", "item", "item_words", (F.col("start") - F.col("item_at")).alias("shift"), "start", "item_at", "gap")
        return ours.drop("words").join(wanted.drop("item_words"), "seed").select("node", "item", (F.col("start") - F.col("item_at")).alias("shift"))

    def likely(ours: DataFrame, wanted: DataFrame) -> DataFrame:
        return ours.join(F.broadcast(wanted.distinct()), "key", "left_semi") if small else ours

    found = []
    if sizes["gaps"]:
        long = items.filter(gap.isNotNull()).select("item", "item_words", gap.alias("gaps"), places(theirs, BLOCK).alias("item_at")).filter(F.col("item_at") % BLOCK == 0)
        seeds = long.select("item", "item_words", "item_at", "gaps", F.posexplode(pair_seeds(theirs, F.col("item_at"), sizes["gaps"])).alias("gap", "seed")).filter("seed is not null and gap < gaps").withColumn("gap", F.col("gap") + 1).drop("gaps")
        ours = base.select("node", "words", places(words, BLOCK).alias("at")).withColumn("key", hashed(words, at, range(BLOCK)))
        ours = likely(ours, long.select(hashed(theirs, F.col("item_at"), range(BLOCK)).alias("key")))
        hits = met(ours.select("node", "words", at.alias("start"), F.explode(pair_seeds(words, at, sizes["gaps"])).alias("seed")), seeds)
        if small:
            ahead = lambda k: F.get(words, F.col("start") + k) == F.get(theirs, F.col("item_at") + k)
            both = functools.reduce(lambda a, b: a & b, (ahead(F.lit(k) + far) for k in range(-BLOCK, 0) for far in (F.lit(0), F.col("gap") * BLOCK)))
            hits = hits.filter((F.col("start") < BLOCK) | (F.col("item_at") < BLOCK) | ~F.coalesce(both, F.lit(False)))
        found.append(hits)
    for few in ([n for n in sizes["short"] if n == 1], [n for n in sizes["short"] if n > 1]):
        if few:
            span = min(2, *few) if len(few) > 1 else min(2, few[0])
            masks = [m for n in sorted(few) for m in SHORT[n]]
            of = {n: F.array(*(F.struct(F.xxhash64(F.lit(m), *(F.get(theirs, k) for k, c in enumerate(m) if c == "1")).alias("seed"), hashed(theirs, F.lit(anchor(m)), range(span)).alias("key")) for m in SHORT[n])) for n in few}
            seeds = functools.reduce(DataFrame.unionByName, (items.filter(short == n).select("item", "item_words", F.inline(of[n])) for n in sorted(few))).withColumns({"item_at": F.lit(0), "gap": F.lit(0)})
            ours = base.select("node", "words", places(words, span).alias("at")).withColumn("key", hashed(words, at, range(span)))
            ours = likely(ours, seeds.select("key")).select("node", "words", F.inline(mask_seeds(words, at, masks)))
            found.append(met(ours, seeds.drop("key")))
    if not found:
        return base.limit(0).select("node", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("score"))
    hits = functools.reduce(DataFrame.union, found)
    if small:
        laid = hits.join(F.broadcast(items.select("item", "item_id")), "item")
    else:
        hits, _ = written(hits.distinct(), "overlap-hits")
        texts = base.join(hits.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))
        laid = texts.join(hits, "node").join(items, "item")
    got = laid.select("node", "item_id", F.size("item_words").alias("n"), overlap(F.col("words"), F.col("item_words"), F.col("shift")).alias("o"))
    good = got.filter((F.col("o.score") >= F.least(F.lit(ENOUGH), F.col("n"))) | (F.col("o.equal") >= F.col("n") * SHARE))
    return good.groupBy("node", "item_id").agg(F.max("o.score").cast("long").alias("score"))


def contamination(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, contaminated, n_items, items) per row of docs (doc_id, text); items lists the item_ids in order.

    Null text: as empty, never contaminated. doc_id may be null or repeat; there is a row for each row. Items without
    words say nothing, items of fewer than least_words are left out (by default none); an item without id counts but
    isn't listed.
    """
    found, _ = written(overlaps(docs, benchmark, least_words).groupBy("node").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("item_id")).alias("ids")), "overlaps")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"))
    out = rows.join(found, "node", "left")
    return out.select("doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0).cast("long")).alias("n_items"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs whose text overlaps no benchmark item; all columns stay."""
    node = fresh(docs, "_node")
    bad, _ = written(overlaps(docs, benchmark, least_words).select(F.col("node").alias(node)).distinct(), "overlaps")
    keyed = docs.withColumn(node, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    return keyed.join(bad, node, "left_anti").select(*docs.columns)
