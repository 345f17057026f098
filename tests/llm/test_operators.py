"""Corpus operators against brute force, libraries and exact round trips, with the odd cases of each."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spindrift.llm import bpe, chat_format, common, decontaminate, embedding_dedup, license_scan, minhash, pii, quality, token_counts, url_filter

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "Ünï côdé", "x" * 3000, "one two three four", "\U0001f600 <|endoftext|>'s \x1c\x85　", "1 2  3\n\n\n4\t"]


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def documents(spark, texts, ids=None):
    rows = list(zip(ids if ids is not None else range(len(texts)), texts))
    return spark.createDataFrame(rows, "doc_id long, text string")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


# shared pieces


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["ab cd ab", None, "cd", "éab-ab  x", ""]
    h, d, n = common.word_hashes(*common.string_bytes(pa.array(texts, pa.string()).slice(0)))
    assert n.tolist() == [3, 0, 1, 3, 0] and d.tolist() == [0, 0, 0, 2, 3, 3, 3]
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 4


def test_segments_do_not_change_hashes(monkeypatch):
    import pyarrow as pa

    texts = pa.array([prose(random.Random(1), 500), "x" * 700, prose(random.Random(2), 50)])
    whole = common.word_hashes(*common.string_bytes(texts))
    monkeypatch.setattr(common, "SEGMENT_BYTES", 64)
    assert all((a == b).all() for a, b in zip(whole, common.word_hashes(*common.string_bytes(texts))))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = common.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: r for x, r in root.items() if any(a != b for a, b in pairs if x in (a, b))}


# 1 near-duplicates


def similarity(a, b):
    a, b = (collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (words(a), words(b)))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_dart_collisions_are_weighted_jaccard():
    rng = np.random.default_rng(1)
    element = np.concatenate([np.arange(40), np.arange(20, 60)]).astype(np.uint64)
    weight = rng.integers(1, 6, 80).astype(float)
    sig, _ = minhash.dart_signatures(common.mix64(element), np.repeat([0, 1], 40), weight, 2, 4000)
    w = np.zeros((2, 60))
    w[0, :40], w[1, 20:] = weight[:40], weight[40:]
    assert abs((sig[0] == sig[1]).mean() - np.minimum(*w).sum() / np.maximum(*w).sum()) < 0.03


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [prose(rng, 120) for _ in range(25)]
    texts = []
    for t in base:
        texts += [t, t, t.upper(), " ".join("changed" if i == 50 else w for i, w in enumerate(t.split())), " ".join(t.split()[:70])]
    passage = prose(rng, 60)
    texts += [prose(rng, 80) + " " + passage for _ in range(30)] + ODD + [None, "", "a"]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    root = dict(enumerate(range(len(texts))))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (texts[a] or "") == (texts[b] or "") or (words(texts[a]) and words(texts[b]) and similarity(texts[a], texts[b]) >= 0.8):
            ra, rb = root[a], root[b]
            root = {x: min(ra, rb) if r in (ra, rb) else r for x, r in root.items()}
    assert got == root


def test_blocks_find_what_hubs_miss(spark, monkeypatch):
    rng = random.Random(11)
    base = prose(rng, 100).split()
    near = [" ".join("new" + str(i) + str(k) if k % 40 == i % 40 else w for k, w in enumerate(base)) for i in range(60)]
    far = [" ".join(base[:88] + [f"tail{i}{k}" for k in range(9)]) for i in range(20)]
    texts = [" ".join(base), *near, *far]
    want = minhash.near_duplicates(documents(spark, texts)).select("doc_id", "component_id").collect()
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert sorted(minhash.near_duplicates(documents(spark, texts)).select("doc_id", "component_id").collect()) == sorted(want)


def test_deduplicated_keeps_columns_and_one_row(spark):
    rows = [(2, "same text of some five words", 1), (1, "same text of some five words", 2), (1, "same text of some five words", 2), (None, "alone here", 3), (None, "alone here", 3), (5, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").withColumn("_node", F.lit("x"))
    got = sorted(tuple(r) for r in minhash.deduplicated(docs).fillna(-1, ["doc_id"]).fillna("", ["text"]).collect())
    assert got == [(-1, "alone here", 3, "x"), (1, "same text of some five words", 2, "x"), (5, "", 4, "x")]
    assert minhash.deduplicated(docs.limit(0)).count() == 0


# 2 BPE, 4 token counts


def random_texts(n):
    rng = random.Random(5)
    pool = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    common_parts = [" ", "\n", "'s", "'ll", "<|endoftext|>", "　", "\x1c", "\x85", "a", "B", "7", "é", "word"]
    return ["".join(rng.choice(common_parts) if rng.random() < 0.6 else rng.choice(pool[:0x300]) if rng.random() < 0.9 else rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_deduplicated_keeps_one_row_of_every_group(spark):
    rng = random.Random(8)
    a, b = prose(rng, 80), prose(rng, 80)
    if hashlib.md5(a.encode()).digest() < hashlib.md5(b.encode()).digest():
        a, b = b, a
    # one doc_id with two texts: the text with the larger md5 and its near copy are a group of their own
    kept = minhash.deduplicated(documents(spark, [a, b, a + " more"], [1, 1, 2])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, a), (1, b)])
    near = [a, a + " more", a + " other", a]
    assert minhash.deduplicated(documents(spark, near, [None] * 4)).count() == 1
    assert [r["doc_id"] for r in minhash.deduplicated(documents(spark, near, [None, 7, None, 9])).collect()] == [7]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    texts = ODD + random_texts(2000) + ["ab" * 900, "é" * 700]
    rows = bpe.round_trips(documents(spark, [*texts, None]), BPE).collect()
    for r in rows:
        text = texts[r["doc_id"]] if r["doc_id"] < len(texts) else ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns(spark):
    docs = documents(spark, ["a b", None, ""]).withColumn("ids", F.lit("replaced")).withColumn("rank", F.lit(1))
    back = bpe.decoded(bpe.encoded(docs, BPE).drop("text"), BPE)
    assert sorted((r["doc_id"], r["text"], r["rank"]) for r in back.collect()) == [(0, "a b", 1), (1, "", 1), (2, "", 1)]
    odd = spark.createDataFrame([([None, 99_999_999],), (None,)], "ids array<int>")
    assert [r["text"] for r in bpe.decoded(odd, BPE).collect()] == ["", ""]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.ranked_pieces(path)
    lib = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces], unk_id=0, byte_fallback=False))
    lib.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    texts = ODD + random_texts(1000)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(documents(spark, [*texts, None]), path).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate([*texts, ""])}


# 3 decontamination


def test_decontamination(spark):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (40, 30, 15, 12, 8, 6, 3)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    clean = prose(rng, 60)
    swap = lambda t, *at: " ".join("zzz" if i in at else w for i, w in enumerate(t.split()))
    texts = {
        0: (clean, ""), 1: (f"{clean} {items[0].upper()}, {clean}", "0"), 2: (f"{clean} {swap(items[1], 9, 21)}", "1"), 3: (swap(items[2], 7), "2"), 4: (f"{items[3]} {items[4]}", "3,4"),
        5: (f"{clean} {items[5]}", "5"), 6: (items[6], "6"), 7: (" ".join(items[0].split()[10:23]), "0"), 8: (" ".join(items[0].split()[10:18]), ""), 9: (None, ""), 10: ("", ""),
    }
    docs = documents(spark, [t for t, _ in texts.values()], list(texts)).withColumn("node", F.lit(1)).withColumn("words", F.lit(2))
    assert {r["doc_id"]: r["items"] for r in decontaminate.contamination(docs, bench).collect()} == {k: v for k, (_, v) in texts.items()}
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [k for k, (_, v) in texts.items() if not v]
    assert {r["doc_id"] for r in decontaminate.contamination(docs, bench, least_words=5).filter("contaminated").collect()} == {k for k, (_, v) in texts.items() if v} - {6}
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("most_seeds", [1_000_000, 0])
def test_decontamination_misses_no_share_of_an_item(spark, monkeypatch, most_seeds):
    """Every substitution pattern that leaves 80 % of an item, up to 20 words; some of longer items. Broadcast and shuffled."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", most_seeds)
    rng = random.Random(5)
    texts, expected = [], []
    lengths = [*range(1, 21), *range(21, 41, 3), 47, 64]
    for n in lengths:
        item, most = [f"w{n}x{i}" for i in range(n)], n // 5
        patterns = [c for k in range(most + 1) for c in itertools.combinations(range(n), k)] if n <= 20 else [rng.sample(range(n), most) for _ in range(300)]
        for c in patterns:
            texts.append(" ".join(["so", *("zzz" if i in c else w for i, w in enumerate(item))]))
            expected.append(str(n))
    bench = spark.createDataFrame([(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in lengths], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.contamination(documents(spark, texts), bench).collect()}
    assert collections.Counter(e for i, e in enumerate(expected) if got[i] != e) == {}


def brute_overlaps(text, items):
    """Items with a stretch of 12 points (an equal word 1, a differing one -4) or 80 % of their words on one diagonal."""
    w, out = words(text), []
    for k, item in enumerate(items):
        v = words(item)
        for shift in range(1 - len(v), len(w)):
            same = [0 <= i + shift < len(w) and w[i + shift] == x for i, x in enumerate(v)]
            now = best = 0
            for x in same:
                now = max(0, now + (1 if x else -4))
                best = max(best, now)
            if v and (best >= min(12, len(v)) or sum(same) >= 0.8 * len(v)):
                out.append(k)
                break
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(21)
    pool = [prose(rng, 1) for _ in range(60)]
    items = [" ".join(rng.choice(pool) for _ in range(n)) for n in (*range(3, 41, 2), 60, 100)]
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(0, 3)):
            v = rng.choice(items).split()
            a = rng.randrange(len(v))
            piece = v[a : a + rng.randint(4, 40)] if rng.random() < 0.5 else v
            parts += [rng.choice(pool) if rng.random() < 0.08 else x for x in piece] + [rng.choice(pool) for _ in range(rng.randint(0, 5))]
        texts.append(" ".join(parts))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.contamination(documents(spark, texts), bench).collect()}
    assert got == {i: ",".join(map(str, brute_overlaps(t, items))) for i, t in enumerate(texts)}


# 5 quality


def test_quality_of_long_texts_in_segments():
    """Texts and tokens longer than a segment give the features that one segment gives; 20 MB take little memory beside the text."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    texts = ["", None, " a b", "é ü x" * 50, *("".join(rng.choice("ab \nEé!") for _ in range(rng.randint(0, 2000))) for _ in range(40)), "x" * 5000]

    def counted(segment):
        out = collections.Counter()
        for bucket, doc in quality.features(pa.array(texts), segment):
            out.update(zip(doc.tolist(), bucket.tolist()))
        return out

    whole = counted(1 << 18)
    assert sum(n for (d, _), n in whole.items() if d == 2) == 1 + 2 + 2 * 1  # the text's own feature, two tokens, a 3-gram of each
    assert counted(7) == whole and counted(100) == whole
    for big in ("word " * 4_000_000, "x" * 20_000_000):
        column = pa.array([big])
        tracemalloc.start()
        for _ in quality.features(column):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 150e6


def test_quality(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        t = prose(rng, 60)
        texts.append(t if good else " ".join(w + "!!" for w in t.upper().split()))
        labels.append((i, int(good)))
    docs = documents(spark, [*texts, None, ""]).withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.95 * len(held)
    assert all(got[i]["held_out"] == (i in held) for i, _ in labels)
    assert got[300]["score"] == got[301]["score"] and 0 <= got[300]["score"] <= 1
    none = quality.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in none.collect()} == {0.5}


# 6 licenses


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = sorted((k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    return len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({label for _, label in found}))


def test_licenses(spark):
    texts = [*ODD, None, "MIT License mit-license, MIT\nLICENSE", "GNU General Public License; the Apache License. CC BY-NC", "mitlicense ccby", "Released under the MTI Lisense today", "permission is hereby granted fre of charge to any persn obtaining a copy"]
    rows = {r["doc_id"]: r for r in license_scan.license_scan(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert rows[len(texts) - 1]["labels"] == "mit" and 0.9 < rows[len(texts) - 1]["score"] < 1
    assert rows[len(texts) - 3]["labels"] == ""


# 7 URLs


def test_urls(spark):
    rng = random.Random(6)
    hosts = ["com", "example.com", "a.example.com", "notexample.com", "com.example", "", "example.com.", "net", "x.net"]
    paths = ["", "/", "/en/", "/en/7", "/en/70", "/e"]
    rules = [url_filter.Rule(rng.choice(hosts[:5] + hosts[7:]), rng.choice(paths), rng.choice(("allow", "block"))) for _ in range(25)] + [url_filter.Rule("com", "/en/", "block")]
    urls = [f"http{s}://{h.upper() if s else h}{p}{q}" for s in ("", "s") for h in hosts for p in paths for q in ("", "?a=/en/7", "#x")] + [None, "", "no scheme", "://", "a://b://c/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit(1))
    for r in url_filter.judged(pages, rules).collect():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", urls[r["page_id"]] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: (len(x.host) + len(x.path), len(x.host), x.verdict == "block"), default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best.host + best.path, best.verdict if best else "allow")
    assert url_filter.judged(pages.limit(0), rules).count() == 0
    whole = sorted(map(str, url_filter.judged(pages, rules).collect()))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(url_filter, "PORTION", 4)
        assert sorted(map(str, url_filter.judged(pages, rules).collect())) == whole
    assert {r["verdict"] for r in url_filter.judged(pages, [], "block").collect()} == {"block"}


def test_urls_over_many_ranges(spark):
    """Several ranges that begin inside hosts with rules; repeated and null page ids."""
    rules = [url_filter.Rule("com", "/a", "block"), url_filter.Rule("h7.com", "/a/5", "allow"), url_filter.Rule("h3.com", "", "block")]
    rows = [(i if i % 5 else None, f"https://h{i % 10}.com/a/{i % 50}") for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = url_filter.judged(pages, rules)
        assert out.rdd.getNumPartitions() > 1
        got = collections.Counter(tuple(r) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = collections.Counter()
    for page, url in rows:
        host, path = url[8:].split("/", 1)
        rule = ("h7.com/a/5", "allow") if host == "h7.com" and path.startswith("a/5") else ("com/a", "block")
        if host == "h3.com":
            rule = ("h3.com", "block") if len("h3.com") > len("com/a") else rule
        want[page, host, "/" + path, *rule] += 1
    assert got == want


# 8 embeddings


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for label in (0, 1, None):
        for c in range(12):
            center = rng.standard_normal(32)
            for _ in range(8):
                rows.append((center + rng.standard_normal(32) * rng.choice([0, 0.1, 0.2]), label))
    vectors = [(i, v.tolist(), label) for i, (v, label) in enumerate(rows)]
    n = len(vectors)
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0] * 31 + [None], [float("inf")] + [0.0] * 31, [1.0, 2.0], [2.0, 4.0]]
    vectors += [(n + i, v, 0) for i, v in enumerate(odd)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    fit = [i for i, (_, v, label) in enumerate(vectors) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for a, b in itertools.combinations(fit, 2) if vectors[a][2] == vectors[b][2] and len(vectors[a][1]) == len(vectors[b][1]) and unit(vectors[a][1]) @ unit(vectors[b][1]) >= 0.98]
    root = {i: i for i in range(len(vectors))}
    for _ in range(8):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    degree = collections.Counter(x for p in links for x in p)
    for block in (512, 5):
        got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, block=block).collect()}
        assert {i: got[i]["component_id"] for i in root} == root
        assert {i: got[i]["n_links"] for i in root} == {i: degree[i] for i in root}
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("shared, bits", [(0.0, 12), (0.9, 12), (0.0, 20)])
def test_embedding_recall(spark, shared, bits):
    """Pairs just above the threshold among vectors with and without a common direction, against brute force."""
    rng = np.random.default_rng(3)
    n, d = 1500, 64
    x = rng.standard_normal((n, d)) * np.sqrt(1 - shared) + np.sqrt(shared) * rng.standard_normal(d)
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.standard_normal((n // 3, d))
    near = x[: n // 3]
    noise -= (noise * near).sum(1)[:, None] * near
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    cosine = rng.uniform(0.9801, 0.985, (n // 3, 1))
    x = np.concatenate([x, near * cosine + noise * np.sqrt(1 - cosine**2)])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = sum(r["n_links"] for r in embedding_dedup.near_vectors(df.withColumn("node", F.lit(1)).withColumn("copies", F.lit("x")), bits=bits).collect())
    links = (x @ x.T >= 0.98).sum() - len(x)
    assert links >= 2 * (n // 3) and found <= links and found >= 0.995 * links


def test_embeddings_with_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0], 0), (7, [1.0, 0.0], 0), (7, [2.0, 0.0], 0), (3, [0.0, 1.0], 0), (None, [0.0, 3.0], 1), (None, None, 0)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (3, 0, 3, True), (None, 0, None, True), (None, 0, None, True)]))


# 9 chats


def test_chats(spark):
    texts = ["hi", "<|im_end|>", "<\\|im_end|><<|", "a\nb\\n", "", None, "<|im_start|>assistant\nx<|im_end|>\n", "é\U0001f600"]
    roles = ["user", "assistant", "system", "<|x|>\n\\n", None]
    rng = random.Random(9)
    turns = [(c, t, rng.choice(roles), rng.choice(texts)) for c in (1, 2, None) for t in range(30)] + [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "assistant", "tie")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1))
    final = chat_format.messages(chat_format.events_of_turns(df))
    whole = {r["conv_id"]: r for r in chat_format.formatted(final).collect()}
    for r in chat_format.digests(final).collect():
        own = sorted((t, role or "", text or "") for c, t, role, text in turns if c == r["conv_id"])
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = whole[r["conv_id"]]["text"]
        assert r["formatted_chars"] == len(text)
        assert "".join(chat_format.unescaped(text[s["start"] : s["end"]]) for s in whole[r["conv_id"]]["loss_mask"]) == loss
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(own)


def test_events_fold(spark):
    e = [(1, 0, "message", None, "user", "q"), (1, 1, "delta", "a", "assistant", "he"), (1, 2, "delta", "a", None, "y"), (1, 3, "regenerate", "a", None, None), (1, 4, "delta", "a", None, "hello"), (1, 5, "message", "b", "user", "tpyo"), (1, 9, "edit", "b", None, "typo"), (1, 7, "message", "c", "user", "gone"), (1, 8, "delete", "c", None, None), (2, 1, None, None, None, None)]
    df = spark.createDataFrame(e, "conv_id long, seq long, kind string, message_id string, role string, text string")
    got = sorted(tuple(r) for r in chat_format.messages(df).collect())
    assert got == [(1, 0, "user", "q"), (1, 1, "assistant", "hello"), (1, 5, "user", "typo"), (2, 1, "", "")]
    assert chat_format.messages(df.limit(0)).count() == 0


def test_turns_are_folded_and_nameless_events_stay(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 0, "user", "q"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    events = chat_format.events_of_turns(turns)
    assert events.filter("message_id is not null").select("message_id").distinct().count() == 3
    assert collections.Counter(tuple(r) for r in chat_format.messages(events).collect()) == {(1, 0, "user", "q"): 2, (None, None, "", ""): 1}
    e = [(1, i, k, None, "user", k) for i, k in enumerate(["delta", "edit", "regenerate", "delete", "unknown", "message"])]
    df = spark.createDataFrame(e, "conv_id long, seq long, kind string, message_id string, role string, text string")
    assert sorted(tuple(r) for r in chat_format.messages(df).collect()) == [(1, i, "user", k) for i, k in ((0, "delta"), (1, "edit"), (2, "regenerate"), (5, "message"))]


# 10 personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            check = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and check, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_pii(spark):
    rng = random.Random(10)
    parts = ["a.b@c.de", "a@b.c_d@e.f", "x@y", "@", "1.2.3.4", "999.1.1.1.1.1.1.1", "0001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (555) 010-9999", "+49 30 1234567", "+1", "é", " ", "\n", "\U0001f600", "12", "-", ".", "5555555555554444", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "ssn 123-45-6789"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts += [*ODD, None, "7" * 20000, "1,2," * 3000, "a." * 9000, "a" * 20000 + "@b.c", " ".join(["10.0.0.1"] * 900)]
    docs = documents(spark, texts).withColumn("_all", F.lit("clash"))
    for r in pii.pii_spans(docs).collect():
        want = brute_pii(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), texts[r["doc_id"]][:200]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[3] == k for x in want) for k in PLAIN]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    clean = pii.redacted(documents(spark, ["mail a.b@c.de or +1 (555) 010-9999!", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', None, "nothing", "a.b@c.de"]).withColumn("_all", F.lit("clash")))
    rows = {r["doc_id"]: (r["text"], r["_all"]) for r in clean.collect()}
    assert rows == {0: ("mail [EMAIL] or [PHONE]!", "clash"), 1: ('token = "[SECRET]"', "clash"), 2: (None, "clash"), 3: ("nothing", "clash"), 4: ("[EMAIL]", "clash")}


def brute_spans(text):
    """Base spans, then those of the trees, kind by kind, where nothing that stands there overlaps; by the plain features."""
    text, (trees, cuts) = text or "", pii.model()
    out = [(a, b, pii.KINDS.index(k)) for a, _, b, k in brute_pii(text)]
    java = {k: p.replace("(?:\\G|", "(?:") for k, p in pii.GENERATORS.items()}
    for kind, pattern in java.items():
        new = []
        for m in re.finditer(pattern, text):
            f = pii.plain_features(kind, m.group(), text[max(0, m.start() - pii.WINDOW) : m.start()])
            row = np.array([f[x] for x in pii.FEATURES])
            if sum(pii.SHRINK * pii.value(t, row) for t in trees) >= cuts[kind] and not any(a < m.end() and m.start() < b for a, b, _ in out):
                new.append((m.start(), m.end(), pii.KINDS.index(kind)))
        out += new
    return sorted(out)


def brute_redacted(text):
    out, at, end = [], 0, -1
    for a, b, k in brute_spans(text):
        if a >= end:
            out += [text[at:a], f"[{pii.KINDS[k].upper()}]"]
        end = at = max(end, b)
    return "".join(out) + (text or "")[at:]


def test_tree_spans_and_redaction_equal_brute_force(spark):
    rng = random.Random(31)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makers = [
        lambda: f'token = "{hexa(40)}"', lambda: hexa(rng.randint(14, 70)), lambda: f"commit {hexa(40)}", lambda: f"order {digits(20)}", lambda: f"api key: {digits(24)}", lambda: f"ssn {digits(3)}-{digits(2)}-{digits(4)}", lambda: f"isbn {digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"iban DE{digits(20)}", lambda: f"born 19{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"updated 20{digits(2)}-01-02", lambda: f"card {digits(16)}", lambda: "4111 1111 1111 1111", lambda: "+49 30 1234567", lambda: "10.1.2.3", lambda: "a.b@c.de", lambda: "+4111111111111111", lambda: "plain words", lambda: "\U0001f600 é",
    ]
    texts = ["".join(rng.choice(makers)() + rng.choice(["", " ", ", ", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(400)] + [" ".join(rng.choice(makers)() for _ in range(400)), None, ""]
    docs = documents(spark, texts)
    for r in pii.pii_spans(docs).collect():
        assert r["spans"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for a, b, k in brute_spans(texts[r["doc_id"]]))), texts[r["doc_id"]]
    for r in pii.redacted(docs).collect():
        assert r["text"] == (None if texts[r["doc_id"]] is None else brute_redacted(texts[r["doc_id"]]))


def test_pii_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a.b@c.de", "x"), (1, "a.b@c.de", "y"), (1, "a.b@c.de", "y"), (2, None, None)], "doc_id long, text string, spans string")
    rows = sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in pii.pii_spans(docs).collect())
    assert rows == [("1", 1, "email:0:8"), ("1", 1, "email:0:8"), ("2", 0, ""), ("None", 1, "email:0:8")]
    assert pii.pii_spans(docs.limit(0)).count() == 0 and pii.redacted(docs.limit(0)).columns == docs.columns


def test_long_secrets_are_found(spark):
    secrets = ["04dbebab91ab85687d33eeaaf9ac699e1188f962" * n for n in (3, 4, 25, 250)]
    rows = pii.redacted(documents(spark, [f'token = "{x}"' for x in secrets])).collect()
    assert {r["text"] for r in rows} == {'token = "[SECRET]"'}


# odd tables


def test_text_operators_on_odd_tables(spark):
    """Null and repeated ids, null and empty texts, repeated rows, clashing further columns, empty tables."""
    rows = [(None, "Released under the MIT License"), (4, "a b"), (4, "a b"), (4, "other"), (5, None), (6, "")]
    clash = {c: F.lit("x") for c in ("ids", "n_tokens", "score", "label", "labels", "words", "n_words", "node", "quality", "seq", "held_out")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, 1), (6, 1), (5, 7)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    for run, columns in (
        (lambda d: bpe.round_trips(d, BPE), ("n_tokens", "ids_sha256")), (lambda d: token_counts.token_counts(d, pieces), ("n_tokens",)), (lambda d: license_scan.license_scan(d), ("n_words", "n_base", "labels")),
        (lambda d: quality.quality_scores(d, labels), ("held_out", "score")), (lambda d: minhash.near_duplicates(d), ()),
    ):
        got = collections.Counter((r["doc_id"], *(r[c] for c in columns)) for r in run(docs).collect())
        plain = collections.Counter((r["doc_id"], *(r[c] for c in columns)) for r in run(docs.select("doc_id", "text")).collect())
        assert sum(got.values()) == len(rows) and got == plain
        assert collections.Counter(k[0] for k in got.elements()) == collections.Counter(i for i, _ in rows)
        empty = run(docs.limit(0))
        assert empty.count() == 0 and empty.columns == run(docs).columns
    assert quality.quality_scores(docs, labels.limit(0)).filter("score <> 0.5").count() == 0


def test_digests_of_no_conversation(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.messages(chat_format.events_of_turns(none))).count() == 0


def test_events_fold_equals_a_plain_fold(spark):
    """Random logs with deltas, edits, regenerations and deletions of several messages, interleaved."""
    rng = random.Random(14)
    kinds = ["message", "delta", "delta", "edit", "regenerate", "delete"]
    rows = [(c, seq, rng.choice(kinds), f"m{rng.randint(0, 3)}", rng.choice(["user", "assistant", None]), rng.choice(["a", "bc", "", None, "<|im_end|>"])) for c in range(20) for seq in range(rng.randint(0, 25))]
    rng.shuffle(rows)
    want = collections.Counter()
    for c, m in {(r[0], r[3]) for r in rows}:
        own = sorted((r for r in rows if (r[0], r[3]) == (c, m)), key=lambda r: r[1])
        text, gone = "", False
        for _, _, kind, _, _, t in own:
            text, gone = (text, True) if kind == "delete" else (text + (t or ""), gone) if kind == "delta" else (t or "", False)
        if not gone:
            want[c, own[0][1], next((r[4] for r in own if r[4] is not None), ""), text] += 1
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message_id string, role string, text string").repartition(5)
    assert collections.Counter(tuple(r) for r in chat_format.messages(df).collect()) == want


# the pipeline


def test_stages_on_odd_tables(spark, tmp_path):
    """Each stage but the last returns the columns of its input, with null, empty and repeated rows and further columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(0, "some item of the benchmark with quite a few words in it here"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, "mail a.b@c.de", "en", None, 3, "x", 1), (1, "mail a.b@c.de", "en", None, 3, "x", 1), (None, None, None, None, None, None, None), (3, "", "en", "s", 0, "y", 2), (4, "Some item of the benchmark with quite a few words in it here", "en", "s", 1, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, score int")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept[name] = sorted(str(r["doc_id"]) for r in out.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    # a null text and an empty one are copies; the benchmark's passage goes
    assert kept == {"quality classifier": ["1", "1", "3", "4", "None"], "minhash near-dedup": ["1", "3", "4"], "benchmark decontamination": ["1", "1", "3", "None"], "pii": ["1", "1", "3", "4", "None"]}
    last = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == 5 and pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_token_stage_decodes(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = pipeline.token_stage(spark, documents(spark, [*ODD, None]), "").collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate([*ODD, None])}


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    good = [prose(rng, 80) for _ in range(60)]
    item = prose(rng, 30)
    texts = [*good, good[0], good[1] + " more", good[2] + " " + item, good[3] + " a.b@c.de"]
    texts[3] = prose(rng, 50)
    junk = [" ".join(w + "!!" for w in prose(rng, 60).upper().split()) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + junk)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i < len(texts)), 0) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    # two copies and the contaminated text go, and all junk
    assert set(got) == set(range(len(texts))) - {60, 61, 62}
    t = bpe.tokenizer(BPE)
    assert t.decode(np.array(got[63]["ids"], "<u4").tobytes()) == good[3] + " [EMAIL]"
    assert all(r["n_tokens"] == len(r["ids"]) for r in got.values())


def test_queries_are_registered(spark):
    from spindrift.llm import queries

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_pii_of_a_text_with_many_spans(spark):
    """Spans beyond many blocks of a long text of many code points, where contexts and kept stretches cross block ends."""
    words = ["é𝄞 a.b@c.de", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "1.2.3.4", "plain words", "born 1980-01-02", "x" * 997, "iban DE12345678901234567890", "𝄞" * 4095]
    text = " ".join(words[k % 8 if k % 50 else 7] for k in range(4000))
    want = sorted((a, k, b) for a, b, k in brute_spans(text))
    row = pii.pii_spans(documents(spark, [text])).collect()[0]
    assert len(want) > 2000 and row["spans"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
    out, at = [], 0
    for a, k, b in want:
        if a >= at:
            out += [text[at:a], f"[{pii.KINDS[k].upper()}]"]
        at = max(at, b)
    assert pii.redacted(documents(spark, [text])).collect()[0]["text"] == "".join(out) + text[at:]


def test_round_trips_with_ids_equal_encoding_and_decoding(spark):
    """One worker's round trip gives the ids and the text of the two single steps, also for null, empty and repeated rows."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark, [None, "", "a b", "a b", "é𝄞 " * 300, "x" * 700])
    trips = {r["doc_id"]: r for r in bpe.round_trips(docs, path, ids=True).collect()}
    both = {r["doc_id"]: r for r in bpe.decoded(bpe.encoded(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path).select("doc_id", "ids"), path).collect()}
    assert len(trips) == len(both) == 6
    for k, r in trips.items():
        assert r["ids"] == both[k]["ids"] and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(both[k]["text"].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
